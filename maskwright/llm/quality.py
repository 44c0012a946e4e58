"""Quality by compression: texts that a dictionary of good text helps more are better.

Two zstandard dictionaries are trained, on pieces of good and of bad labelled texts. A
whole text is cut into pieces of a fixed size, and each is compressed with either
dictionary, so that the dictionaries matter as much at the end of a long text as at its
start. The difference of the summed sizes over the text's own size goes through a
logistic curve, which is fitted on labelled texts that the dictionaries have not seen.

A null or empty text has difference zero and gets the score of that. Equal texts get
equal scores. Without labels of both kinds every text gets the score 0.5.
"""

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
import xxhash
import zstandard
from pyspark.sql import functions as F

from maskwright.llm.common import crc_part, labelled_sample, logistic, map_texts, steps, table

#: Labelled rows of each kind that the dictionaries and the curve are fitted on, at most.
SAMPLE = 4000
#: Pieces of a labelled text that go into a dictionary, picked by hash from all of it.
PIECES = 8
PIECE_BYTES = 500
DICTIONARY_BYTES = 112_640
LEVEL = 3
THRESHOLD = 0.3


class QualityModel:
    """Two dictionaries and a curve; a few hundred KB, whatever the corpus."""

    def __init__(self, good, bad, curve):
        self.good, self.bad, self.curve = good, bad, curve

    def scorer(self):
        """A function from texts to scores, for one task."""
        if self.good is None:
            return lambda texts: [0.5] * len(texts)
        differences = comparer(self.good, self.bad)
        slope, offset = self.curve

        def score(texts):
            x = np.array(differences(texts)) * slope + offset
            return (1 / (1 + np.exp(-np.clip(x, -40, 40)))).tolist()

        return score


def _compressor(content):
    known = zstandard.ZstdCompressionDict(content)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False,
                                    write_checksum=False, write_dict_id=False).compress


def comparer(good, bad):
    """A function from texts to (bad size - good size) / own size."""
    good, bad = _compressor(good), _compressor(bad)

    def differences(texts):
        out = []
        for text in texts:
            raw = (text or "").encode("utf-8")
            gain = 0
            for start in range(0, len(raw), PIECE_BYTES):
                piece = raw[start:start + PIECE_BYTES]
                gain += len(bad(piece)) - len(good(piece))
            out.append(gain / len(raw) if raw else 0.0)
        return out

    return differences


def _pieces(rows):
    """(label, piece): pieces of the lines of each text, up to PIECES of them, picked
    by hash from its whole length. A piece that several texts hold says nothing of its text and is left out."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                labels, pieces = [], []
                for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
                    lines = [line.encode("utf-8") for line in text.split("\n")]
                    cuts = sorted({line[i:i + PIECE_BYTES]: None for line in lines for i in range(0, len(line), PIECE_BYTES)}.keys(),
                                  key=lambda c: xxhash.xxh64_intdigest(c))[:PIECES]
                    labels += [label] * len(cuts)
                    pieces += cuts
                yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(pieces, pa.binary())],
                                                 ["label", "piece"])

    found = rows.select("text", "label").mapInArrow(run, "label int, piece binary")
    return found.groupBy("piece").agg(F.count("*").alias("n"), F.min("label").alias("label")).where("n = 1").select("label", "piece")


def fit(docs, labels, key="doc_id", text="text", label="quality", sample=SAMPLE):
    """Learn from at most about `sample` rows of each label (1 good, 0 bad)."""
    rows, counts = labelled_sample(docs, labels, key, label, sample, text)
    rows = rows.withColumnRenamed(text, "text")
    if not (counts.get(0) and counts.get(1)):
        return QualityModel(None, None, None)
    share = F.pmod(F.xxhash64(F.lit("curve"), F.col(key).cast("string")), F.lit(10))
    held = {0: [], 1: []}
    for r in _pieces(rows.where(share < 6)).collect():  # bounded: rows x PIECES x PIECE_BYTES
        if r["label"] in held:
            held[r["label"]].append(bytes(r["piece"]))
    if not (held[0] and held[1]):
        return QualityModel(None, None, None)
    good, bad = (dictionary(sorted(held[k])) for k in (1, 0))

    def differences(batches):
        measure = comparer(good, bad)
        for batch in batches:
            for part in steps(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.array(measure(part.column("text").to_pylist()), pa.float64())],
                    ["label", "x"])

    seen = rows.where(share >= 6).select("text", "label").mapInArrow(differences, "label int, x double").collect()
    seen = [r for r in seen if r["label"] in (0, 1)] or [{"label": 1, "x": 0.1}, {"label": 0, "x": 0.0}]
    x, y = np.array([[r["x"]] for r in seen]), np.array([r["label"] for r in seen])
    slope, offset = logistic(x * 100, y, np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum())), ridge=1e-6)
    return QualityModel(good, bad, (float(slope) * 100, float(offset)))


def dictionary(pieces):
    """A trained dictionary, or, from too few pieces to train on, one with their raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:].ljust(8, b" ")


def score(df, model, text="text"):
    """`df` with `score` (0 to 1, higher is better) and `predicted` (1 at 0.3 or more)."""

    def make():
        work = model.scorer()

        def scored(texts):
            made = work(texts.to_pylist())
            return [made, [int(s >= THRESHOLD) for s in made]]

        return scored

    return map_texts(df, text, [("score", T.DoubleType()), ("predicted", T.IntegerType())], make)


def accepted(df, model, text="text"):
    """The rows of `df` that the model predicts to be good."""

    def make():
        work = model.scorer()
        return lambda texts: [[s >= THRESHOLD for s in work(texts.to_pylist())]]

    return map_texts(df, text, [("kept", T.BooleanType())], make, keep="kept")


def op6_quality(spark, sf_dir):
    """Quality score of every document, learnt from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held = crc_part("doc_id", 5) == 0
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(~held)
    model = fit(docs, labels)
    return score(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), model).drop("text")
