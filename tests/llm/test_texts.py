"""Token counts, fingerprints and archives against plain versions."""

import gzip
import hashlib
import random

import numpy as np
import pyarrow.fs
from tokenizers import Tokenizer, models

from maskwright.llm import fingerprints as fp
from maskwright.llm import token_counts as tc
from maskwright.llm import warc


def test_counts_are_the_tokenizers():
    dice = random.Random(1)
    letters = "abc▁"
    for turn in range(60):
        pieces = {"".join(dice.choice(letters) for _ in range(dice.randint(1, 4))) for _ in range(15)}
        vocabulary = [(p, float(-dice.randint(1, 4))) for p in sorted(pieces)]
        counter = tc.UnigramCounter(vocabulary + [("<unk>", 0.0)])
        lib = Tokenizer(models.Unigram([("<unk>", 0.0)] + vocabulary, unk_id=0, byte_fallback=False))
        for _ in range(20):
            text = "".join(dice.choice("abc ") for _ in range(dice.randint(1, 25)))
            marked = tc.MARK + text.replace(" ", tc.MARK)
            if set(marked) <= {c for p, _ in vocabulary if len(p) == 1 for c in p}:
                want = len(lib.encode(marked).tokens)
                assert counter.divide(marked) == want
                if counter.split:
                    assert counter.count(text) == want


def test_public_vocabulary_and_odd_rows(spark):
    vocabulary = tc.default_vocabulary()
    pad = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", -1e9) for b in range(256)]
    lib = Tokenizer(models.Unigram(pad + vocabulary, unk_id=0, byte_fallback=True))
    texts = ["Plain words here", "naïve 日本 \U0001F600\n\nx", "   ", None, "", "Plain words here", "a" * 30_000, "den und der " * 9000]
    frame = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, N_TOKENS int")
    got = [r["n_tokens"] for r in tc.token_counts(frame).orderBy("doc_id").collect()]
    assert got == [len(lib.encode(tc.MARK + t.replace(" ", tc.MARK)).tokens) if t else 0 for t in texts]
    assert tc.token_counts(frame.limit(0)).count() == 0


def test_sketches_do_not_depend_on_neighbours():
    dice = random.Random(2)
    texts = ["", "a", "aaaa" * 500, "ab" * 700, "日本語" * 40] + [
        " ".join("".join(dice.choice("etaoinsr") for _ in range(dice.randint(1, 9))) for _ in range(dice.randint(1, 900))) for _ in range(40)]
    together = fp.sketches(texts)
    for text, sketch in zip(texts, together):
        assert fp.sketches([text])[0].tolist() == sketch.tolist()


def test_equal_substrings_share_interior_phrases():
    dice = random.Random(3)
    word = lambda: "".join(dice.choice("etaoinsrhld ") for _ in range(3000))
    shared = word()
    near = fp.likeness(*fp.sketches([word()[:17] + shared, word()[:40] + shared]))
    apart = fp.likeness(*fp.sketches([word(), word()]))
    assert near > 0.8 and apart < 0.1


def test_likeness_of_any_two_lengths():
    dice = random.Random(5)
    words = ["".join(dice.choice("etaoinsrhld") for _ in range(dice.randint(2, 9))) for _ in range(3000)]

    def named(text):
        levels = fp.phrases(np.frombuffer(text.encode(), np.uint8), np.array([0]))
        return {(depth, int(n)) for depth, (names, _) in enumerate(levels, 1) for n in names}

    for size in [1, 3, 10, 30, 60, *range(80, 400, 10), 1000, 5000]:
        whole = " ".join(dice.choice(words) for _ in range(size))
        for part in (0.5, 0.7, 0.9, 0.97):  # with the number of phrases on either side of any bound
            other = whole[:int(len(whole) * part)]
            a, b = named(whole), named(other)
            exact = len(a & b) / max(1, len(a | b))
            spread = (exact * (1 - exact) / fp.SKETCH) ** 0.5
            assert abs(fp.likeness(*fp.sketches([whole, other])) - exact) <= 4.5 * spread + 0.02, (size, part)


def slow(docs):
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        n = len(text) // 3
        edited = (text[:len(text) - n] if n else text) + after[:n]
        a, b, c = fp.sketches([text, edited, after])
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.written(a), fp.written(b), fp.likeness(a, b), fp.likeness(a, c))
    return out


def test_next_document(spark):
    dice = random.Random(4)
    docs = [(i * 3 - 50, dice.choice([None, "", "a", " ".join(dice.choice(["red", "grün", "日本", "x1"]) for _ in range(dice.randint(1, 200)))]))
            for i in range(200)]
    for some in (docs, docs[:1], docs[:2], docs[5:12]):
        frame = spark.createDataFrame([(i, t, "z") for i, t in some], "doc_id long, text string, fingerprint string").repartition(3)
        got = {r[0]: tuple(r)[1:] for r in fp.with_next(frame).collect()}
        assert got == slow(some)
    ties = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, "four five six"), (None, "seven"), (None, None)], "doc_id long, text string")
    assert fp.with_next(ties).count() == 5
    assert fp.with_next(ties.where("doc_id is null")).count() <= 2
    assert fp.with_next(ties.limit(0)).count() == 0


def test_null_ids_alone_lose_no_row(spark):
    for texts in (["seven"], [None], ["seven", None], ["one two", "one two", "three four five"], ["a b c"] * 5):
        frame = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(3)
        got = [tuple(r) for r in fp.with_next(frame).collect()]
        assert sorted(r[3] for r in got) == sorted(fp.written(s) for s in fp.sketches([t or "" for t in texts]))
        assert all(r[0] is None for r in got)
        assert len(texts) > 1 or got[0][6] == 1.0  # the only row is its own next


def test_archives(spark, tmp_path):
    big = "<p>" + "x" * 1200
    pages = [(1, "http://a/1", big), (2, "http://a/2\r\nEvil: 1", big), (5, None, big), (3, "http://b", "small"), (4, "http://b", "small"),
             (6, "http://c", None), (7, "http://d", "ünï\r\n\r\nWARC/1.1 " + "y" * 400_000), (5, None, big), (None, "http://n", big)]
    frame = spark.createDataFrame([(*p, "m") for p in pages], "page_id long, url string, html string, record_type string").repartition(3)
    folder = f"file://{tmp_path}/warc"
    manifest = warc.archive(frame, folder)
    rows = sorted([tuple(r) for r in warc.resolve(warc.read_archives(manifest, f"{folder}/archives")).collect()], key=str)
    want = []
    for i, _, text in pages:
        raw = (text or "").encode()
        again = text == big and i in (1, 2)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 5 if again else None))
    assert rows == sorted(want, key=str)
    files, path = pyarrow.fs.FileSystem.from_uri(f"{folder}/archives")
    for info in files.get_file_info(pyarrow.fs.FileSelector(path)):
        whole = gzip.decompress(open(info.path, "rb").read())
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: ") and whole.endswith(b"\r\n\r\n") and b"\r\nEvil" not in whole
    assert files.get_file_info(f"{tmp_path}/warc/raw").type == pyarrow.fs.FileType.NotFound
    assert warc.resolve(warc.read_archives(warc.archive(frame.limit(0), f"{folder}2"), f"{folder}2/archives")).count() == 0
