"""Byte-level BPE encoding and decoding over Arrow batches.

The `tokenizers` library does the merges. Its vocabulary is built from a file of
ranks: a token's bytes are spelt in the printable byte alphabet, and every split of
a token into two tokens is a merge with the token's rank, so that the library picks
the pair whose joined bytes have the lowest rank. A text is cut by the pattern
first, as merges never reach over a match; each distinct match of a worker goes
through the library once and is looked up after that.

Nulls count as empty texts and give no ids. Lone ids outside the vocabulary decode
to nothing. Repeated rows give repeated results, and an empty table an empty one.
"""

import base64
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T

from maskwright.llm.common import map_texts, table

#: Distinct matches that a worker remembers before it starts anew.
REMEMBERED = 400_000
#: Longer matches are not remembered.
REMEMBER_CHARS = 64
#: The default pattern for texts of the plain characters below, where the standard
#: library's classes agree with it; all other texts take the pattern itself.
PLAIN_PATTERN = r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
PLAIN_TEXT = "[\t-\r -~\u00c0-\u024f]*"


def default_vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def byte_alphabet():
    """The printable character that stands for each byte: Latin-1's visible characters
    for themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class ByteBpe:
    """Encoder and decoder of one vocabulary; made once per task."""

    def __init__(self, rank_file, pattern):
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        letter = byte_alphabet()
        spelt = {token: "".join([letter[b] for b in token]) for token in ranks}
        merges = [
            (spelt[token[:i]], spelt[token[i:]])
            for token, _ in sorted(ranks.items(), key=lambda item: item[1])
            for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
        ]
        self.letter = {chr(b): c for b, c in letter.items()}
        self.table = str.maketrans(self.letter)
        self.model = Tokenizer(BPE(vocab={spelt[t]: r for t, r in ranks.items()}, merges=merges))
        self.cut_any = regex.compile(pattern).findall
        self.cut_plain = re.compile(PLAIN_PATTERN).findall
        self.is_plain = re.compile(PLAIN_TEXT).fullmatch if pattern == default_vocabulary()[1] else lambda text: None
        byte_of = {c: b for b, c in letter.items()}
        size = max(ranks.values()) + 1
        pieces = [b""] * size
        for token, rank in ranks.items():
            pieces[rank] = bytes(byte_of[c] for c in spelt[token])
        self.token_size = np.array([len(t) for t in pieces], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.all_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.known = {}

    def cut(self, text):
        """The matches of the pattern, in order; together they are the text."""
        return self.cut_plain(text) if self.is_plain(text) else self.cut_any(text)

    def _spell(self, words):
        return [w.encode("utf-8").decode("latin-1").translate(self.table) for w in words]

    def _learn(self, words):
        """The ids of each distinct word, from memory or from the library."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        found, new = {}, []
        for word in words:
            ids = known.get(word)
            if ids is None:
                new.append(word)
            else:
                found[word] = ids
        for start in range(0, len(new), 1000):
            part = new[start:start + 1000]
            spelt = self._spell(part)
            made = self.model.encode_batch_fast([spelt], is_pretokenized=True, add_special_tokens=False)[0].ids
            ids = np.array(made, "<u4")
            stops = np.searchsorted(np.cumsum(self.token_size[ids]), np.cumsum([len(s) for s in spelt])) + 1
            raw, begin = ids.tobytes(), 0
            for word, stop in zip(part, (4 * stops).tolist()):
                found[word] = raw[begin:stop]
                begin = stop
                if len(word) <= REMEMBER_CHARS:
                    known[word] = found[word]
        return found

    def encode(self, texts):
        """Little-endian 32-bit ids of each text, as bytes."""
        cut = [self.cut(t) for t in texts]
        ids = self._learn(set().union(*cut) if cut else ())
        return [b"".join(map(ids.__getitem__, words)) for words in cut]

    def decode(self, encoded):
        """The bytes that each sequence of ids stands for; ids are given as bytes."""
        sizes = np.fromiter((len(e) // 4 for e in encoded), np.int64, len(encoded))
        ids = np.frombuffer(b"".join(encoded), "<u4").astype(np.int64)
        ids, lost = np.where(ids < len(self.token_size), ids, 0), ids >= len(self.token_size)
        length = np.where(lost, 0, self.token_size[ids])
        stop = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(self.token_start[ids] - stop[:-1], length) + np.arange(stop[-1])
        raw = self.all_bytes[at].tobytes()
        cuts = stop[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def offsets(self, text, ids):
        """First and last-plus-one character of each token. A token that holds a part
        of a character reaches over the whole of it."""
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum(self.token_size[ids])
        begin = end - self.token_size[ids]
        return char[begin].astype(np.int32), (char[end - 1] + 1).astype(np.int32)


def as_text(raw, errors="replace"):
    """Decoded bytes as text: characters that a cut between tokens has split come out
    whole where all their bytes are there, else as U+FFFD."""
    return raw.decode("utf-8", errors)


def _ids_column(encoded):
    sizes = np.fromiter((len(e) // 4 for e in encoded), np.int64, len(encoded))
    # 64-bit offsets do not fit a Spark array; the steps keep a column far below the limit
    places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(places), pa.array(values))


def encode(df, text="text", rank_file=None, pattern=None, offsets=False):
    """`df` with `ids` (array of int) of each whole text, and, if asked for, the
    characters `starts` and `ends` of each token."""
    rank_file, pattern = _vocabulary(rank_file, pattern)
    ints = T.ArrayType(T.IntegerType())
    fields = [("ids", ints)] + ([("starts", ints), ("ends", ints)] if offsets else [])

    def make():
        bpe = ByteBpe(rank_file, pattern)

        def work(texts):
            texts = [t or "" for t in texts.to_pylist()]
            encoded = bpe.encode(texts)
            out = [_ids_column(encoded)]
            if offsets:
                spans = [bpe.offsets(t, np.frombuffer(e, "<u4").astype(np.int64)) if e else ((), ())
                         for t, e in zip(texts, encoded)]
                out += [[s[0] for s in spans], [s[1] for s in spans]]
            return out

        return work

    return map_texts(df, text, fields, make)


def decode(df, ids="ids", rank_file=None, pattern=None):
    """`df` with `decoded` (binary) and `decoded_text`, from a column of ids."""
    rank_file, pattern = _vocabulary(rank_file, pattern)
    out = T.StructType([f for f in df.schema.fields if f.name.lower() not in ("decoded", "decoded_text")]
                       + [T.StructField("decoded", T.BinaryType()), T.StructField("decoded_text", T.StringType())])
    names = [f.name for f in out.fields[:-2]]

    def run(batches):
        bpe = ByteBpe(rank_file, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256).select(names)
                raw = bpe.decode([np.array([i for i in x or () if i is not None], "<i4").tobytes()
                                  for x in part.column(ids).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(raw, pa.binary()), pa.array([as_text(r) for r in raw], pa.string())],
                    [*names, "decoded", "decoded_text"])

    return df.mapInArrow(run, out)


def round_trip(df, text="text", rank_file=None, pattern=None):
    """`df` with `n_tokens`, `ids_sha256` and `decoded_sha256`: encoding, then decoding
    of the ids, in one pass that moves neither ids nor bytes out of the task."""
    rank_file, pattern = _vocabulary(rank_file, pattern)
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]

    def make():
        bpe = ByteBpe(rank_file, pattern)

        def work(texts):
            encoded = bpe.encode([t or "" for t in texts.to_pylist()])
            digest = [hashlib.sha256(e).hexdigest() for e in encoded]
            back = [hashlib.sha256(raw).hexdigest() for raw in bpe.decode(encoded)]
            return [[len(e) // 4 for e in encoded], digest, back]

        return work

    return map_texts(df, text, fields, make)


def _vocabulary(rank_file, pattern):
    if rank_file and pattern:
        return rank_file, pattern
    given = default_vocabulary()
    return rank_file or given[0], pattern or given[1]


def op8_byte_bpe(spark, sf_dir):
    """Encoded and decoded digests of every document."""
    return round_trip(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
