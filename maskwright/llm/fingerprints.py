"""Document fingerprints by locally consistent parsing.

A text is parsed bottom up. On each level deterministic coin tossing compares a symbol
with its left neighbour: the lowest bit in which they differ, and its value there, give
a label, and after two rounds labels come from a tiny alphabet while neighbours still
differ. Local maxima of the labels begin phrases; a phrase's name is a hash of its
symbols, and names are the symbols of the next level. A run of one symbol has no maximum
inside and is one phrase. Where a phrase begins depends on a few symbols around it only:
equal substrings share all interior phrases, wherever they stand.

The fingerprint of a text keeps, of the names of all its phrases on all levels, the
smallest ones as a sketch; the share of common names in the smallest of two sketches
together estimates the share of common phrases, for texts of any two lengths. It is
written as hexadecimal digits.

A null text counts as empty; an empty text's fingerprint is the empty string, and two of
these have likeness 1, one and another 0. Equal texts have equal fingerprints. Documents
with a null id come last, as do repeated ids in the order of their texts' hashes.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import functions as F

from maskwright.llm.common import map_texts, steps, table

SKETCH = 64
LEVELS = 24
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x):
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _toss_table():
    """Label of a byte beside its left neighbour: twice the place of the lowest bit in which
    they differ, plus its value; 0 for equal bytes."""
    own, left = np.arange(256)[:, None], np.arange(256)[None, :]
    low = (own ^ left) & -(own ^ left)
    place = np.log2(np.maximum(low, 1)).astype(int)
    return np.where(low == 0, 0, 1 + 2 * place + ((own & low) != 0)).astype(np.uint8).ravel()


_TOSS = _toss_table()
#: A factor for each place in a phrase, so that a name depends on the order of its symbols.
_PLACE = mixed(np.arange(1, 1025, dtype=np.uint64) * _GOLD) | np.uint64(1)


def tossed(label, first):
    """One round of coin tossing; the first symbol of a text is compared with 0."""
    left = np.empty_like(label)
    left[0] = 0
    left[1:] = label[:-1]
    left[first] = 0
    return _TOSS[(label.astype(np.uint16) << 8) | left]


def parsed(label, symbols, starts):
    """Names of the phrases of one level, and where each text's phrases start.

    `label` holds a byte of each symbol, `starts` the first symbol of each text."""
    for _ in range(2):
        label = tossed(label, starts)
    peak = np.zeros(len(label), bool)
    peak[1:] = label[1:] > label[:-1]
    peak[:-1] &= label[:-1] >= label[1:]
    peak[starts[1:] - 1] = label[starts[1:] - 1] > label[starts[1:] - 2]  # nothing stands to the right
    peak[starts] = True
    begins = np.flatnonzero(peak)
    size = np.diff(np.append(begins, len(label)))
    place = np.arange(len(label), dtype=np.int32)
    place -= np.repeat(begins.astype(np.int32), size)
    place &= 1023
    names = mixed(np.add.reduceat((symbols + _GOLD) * _PLACE[place], begins) + size.astype(np.uint64))
    return names, np.searchsorted(begins, starts)


def phrases(data, starts):
    """[(names, text of each)] by level. A text goes up until one phrase is left of it."""
    symbols, label, texts = data.astype(np.uint64), data, np.arange(len(starts))
    levels = []
    for _ in range(LEVELS):
        names, starts = parsed(label, symbols, starts)
        size = np.diff(np.append(starts, len(names)))
        levels.append((names, np.repeat(texts, size)))
        up = size > 1
        if not up.any():
            break
        symbols = names[np.repeat(up, size)]
        label = (symbols & np.uint64(255)).astype(np.uint8)
        texts, size = texts[up], size[up]
        starts = np.cumsum(size) - size
    return levels


def sketches(texts):
    """For each text the sorted smallest phrase names, as an array of 32-bit numbers."""
    raw = [t.encode("utf-8") for t in texts]
    full = np.flatnonzero([len(r) > 0 for r in raw])
    out = [np.zeros(0, np.uint32)] * len(raw)
    if not len(full):
        return out
    size = np.array([len(raw[i]) for i in full])
    levels = phrases(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size)
    keys = []
    for depth, (names, owner) in enumerate(levels, 1):
        keys.append((owner.astype(np.uint64) << np.uint64(32)) | (mixed(names + np.uint64(depth)) >> np.uint64(32)))
    key = np.unique(np.concatenate(keys))
    begin = np.searchsorted(key >> np.uint64(32), np.arange(len(full) + 1))
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for i, a, b in zip(full, begin[:-1], begin[1:]):
        out[i] = low[a:min(b, a + SKETCH)]
    return out


def written(sketch):
    return sketch.astype(">u4").tobytes().hex()


def read(fingerprint):
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a, b):
    """Estimated share of common phrases of two sketches, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = set(a.tolist()), set(b.tolist())
    both = sorted(a | b)[:SKETCH]
    return len(a & b & set(both)) / len(both)


def fingerprint(df, text="text"):
    """`df` with the `fingerprint` of each whole text."""

    def work(texts):
        return [[written(s) for s in sketches([t or "" for t in texts.to_pylist()])]]

    return map_texts(df, text, [("fingerprint", T.StringType())], lambda: work)


def ordered(docs, key, text):
    """`docs` (key, text) dealt out in descending order of key, so that a task reads runs of
    neighbours, each run followed by the row that comes next.

    Runs begin at keys that are quantiles of all keys. The rows of such a key also go to the
    run before, as `_next`; those of the greatest key go to the last run, for its last row.
    With null keys alone there is one run, and its first row follows its last.
    The columns are `_run`, `_next`, key and text; a task's rows are sorted by run.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = 4 * parts
    ends = docs.agg(F.max(key), F.percentile_approx(key, [i / runs for i in range(runs, 0, -1)], 20 * runs)).first()
    starts = sorted({k for k in [ends[0], *(ends[1] or [])] if k is not None}, reverse=True)
    last = max(len(starts) - 1, 0)
    # the run of a key: how many starts lie above or at it, less one
    falling = F.array(*[F.lit(k) for k in starts]) if starts else F.array().cast("array<long>")
    run = F.when(F.col(key).isNull(), F.lit(last)).otherwise(F.size(F.filter(falling, lambda s: s >= F.col(key))) - 1)
    at = F.coalesce(F.array_position(falling, F.col(key)) - 1, F.lit(-1)).cast("int")
    before = F.when(at == 0, F.lit(last)).when(at > 0, at - 1)
    if not starts:
        least = docs.agg(F.min(F.xxhash64(text))).first()[0]
        before = F.when(F.xxhash64(text) == F.lit(least), F.lit(last))
    places = F.array_compact(F.array(
        F.struct(run.cast("int").alias("_run"), F.lit(False).alias("_next")),
        F.when(before.isNotNull(), F.struct(before.cast("int").alias("_run"), F.lit(True).alias("_next")))))
    spread = docs.select(key, text, F.explode(places).alias("p")).select("p._run", "p._next", key, text)
    return spread.repartition(parts, "_run").sortWithinPartitions(
        "_run", "_next", F.col(key).desc_nulls_last(), F.xxhash64(text))


def with_next(docs, key="doc_id", text="text"):
    """Per document: the key, `n_chars`, its `fingerprint`, that of its edited text, the
    edited text's SHA-256, and the likeness of its fingerprint to either and to the next
    document's. The next document is the one with the next smaller key; the last one's
    next is the first. The edited text has its last third replaced by as many characters
    from the start of the next document."""
    rows = ordered(docs.select(key, text), key, text)
    out = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType())])

    def run(batches):
        held = None  # the last row that still waits for the next: run, key, text, sketch
        closed = False  # whether this run's following row has been seen
        for batch in batches:
            for part in steps(batch, text, 1 << 20):
                runs, nexts = part.column("_run").to_pylist(), part.column("_next").to_pylist()
                texts = [t or "" for t in part.column(text).to_pylist()]
                made, pairs = sketches(texts), []
                keys = part.column(key)
                for i in range(len(texts)):
                    if held is not None and held[0] != runs[i]:
                        held, closed = None, False  # the run before has had its following row
                    if nexts[i]:
                        if not closed and held is not None:
                            pairs.append((held, texts[i], made[i]))
                            held, closed = (runs[i], None, None, None), True
                        continue
                    if held is not None and held[1] is not None:
                        pairs.append((held, texts[i], made[i]))
                    held, closed = (runs[i], keys[i], texts[i], made[i]), False
                if pairs:
                    yield finished(pairs)

    def finished(pairs):
        edited = [edit(own[2], after) for own, after, _ in pairs]
        changed = sketches(edited)
        return pa.RecordBatch.from_arrays([
            pa.array([own[1].as_py() for own, _, _ in pairs], pa.int64()),
            pa.array([len(own[2]) for own, _, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited]),
            pa.array([written(own[3]) for own, _, _ in pairs]),
            pa.array([written(c) for c in changed]),
            pa.array([likeness(own[3], c) for (own, _, _), c in zip(pairs, changed)], pa.float64()),
            pa.array([likeness(own[3], s) for own, _, s in pairs], pa.float64()),
        ], out.names)

    return rows.mapInArrow(run, out)


def edit(text, after):
    """`text` with its last third replaced by as much of the start of `after`, or all of that."""
    n = len(text) // 3
    return text[:len(text) - n] + after[:n]


def op10_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text, and their likeness."""
    return with_next(table(spark, sf_dir, "documents", "doc_id", "text"))
