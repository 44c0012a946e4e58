"""Periodic runs against a search of all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

from maskwright.llm import periodic_runs as pr

SF = "/root/testdata/sf0.001"


def plain(words):
    """Runs by comparing every word with those before, for all lags; smallest periods alone."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        at = 0
        while at < n - q:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end < n - q and words[end] == words[end + q]:
                end += 1
            if end - at + q >= max(24, 3 * q):
                found.setdefault((at, end + q), q)  # smaller lags come first
            at = end
    return sorted((a, e - a, q) for (a, e), q in found.items())


def kept(words, runs):
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(dice):
    """Words with repetitions of many kinds, nested and broken ones among them."""
    words = []
    for _ in range(dice.randint(0, 6)):
        kind = dice.random()
        block = [dice.choice("abcd"[:dice.randint(1, 4)]) for _ in range(dice.randint(1, 40))]
        if kind < 0.3:
            block = block[:dice.randint(1, 5)] * dice.randint(1, 6) + block
        block = block * dice.randint(1, 7)
        cut = dice.randint(0, len(block))
        words += block[:cut] if dice.random() < 0.5 else block
        words += [dice.choice(["x", "y", f"w{dice.randint(0, 9)}"]) for _ in range(dice.randint(0, 3))]
    return words


def test_runs_are_those_of_a_plain_search():
    dice = random.Random(5)
    texts = [made(dice) for _ in range(400)]
    texts += [["a"] * n for n in (1, 23, 24, 25, 200)] + [list("ab") * 12, list("ab") * 11 + ["a"], list("abcdefgh") * 3]
    texts += [["v%d" % (i % q) for i in range(n)] for q, n in ((15, 45), (16, 47), (16, 48), (17, 51), (31, 93), (32, 96), (33, 98), (100, 1000))]
    lists, best, collapsed = pr.analysed([" ".join(t).encode() for t in texts])
    some = 0
    for words, found, top, left in zip(texts, lists, best, collapsed):
        want = plain(words)
        assert found == sorted(want, key=lambda r: (r[0], r[2]))
        assert left.decode() == kept(words, want)
        assert top == (max(want, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if want else None)
        some += bool(want)
    assert some > 100


def test_texts_do_not_meet_in_a_step():
    one = ("p q r " * 7).split()
    lists, _, _ = pr.analysed([" ".join(one).encode()] * 3 + [b"", b"p q r"])
    assert lists == [[]] * 5  # 21 words each: too short alone


def want_of(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain(words), key=lambda r: (r[0], r[2]))
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(kept(words, runs)))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = pr.op13_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    rows = {r["doc_id"]: tuple(r) for r in got.collect()}
    picked = [r for r in docs.collect() if len(r["text"] or "") < 20_000]
    assert len(rows) == docs.count() and len(picked) > 150
    assert sum(r[1] > 0 for r in rows.values()) > 10
    for r in picked:
        assert rows[r["doc_id"]] == want_of(r["doc_id"], r["text"])


def test_odd_rows(spark):
    long = "lorem ipsum dolor " * 60_000
    mixed = "a b\tc\x0b\x0cd\x85e　f\n" * 30  # only ASCII white space divides
    rows = [(1, None, 7), (2, "", 7), (3, " \t\n ", 7), (None, "a b " * 40, 7), (4, long, 7), (4, long, 7), (5, mixed, 7),
            (6, "\U0001F600 x " * 50, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, RUNS int")
    got = pr.periodic_runs(frame).collect()
    assert got[0].asDict().keys() == {"doc_id", "runs", "best", "collapsed"}
    assert [(r["runs"], r["best"], r["collapsed"]) for r in got[:3]] == [([], None, "")] * 3
    assert got[3]["collapsed"] == "a b" and tuple(got[3]["best"]) == (0, 80, 2)
    assert tuple(got[4]["best"]) == (0, 180_000, 3) and got[4]["collapsed"] == got[5]["collapsed"] == "lorem ipsum dolor"
    assert [tuple(r) for r in got[6]["runs"]] == plain_runs(mixed) and got[7]["collapsed"] == "\U0001F600 x"
    assert pr.periodic_runs(frame.limit(0)).count() == 0
    tails = {(r["doc_id"], r["text"]) for r in pr.with_repeated_tail(frame).collect()}
    assert {(1, None), (2, ""), (3, " \t\n "), (None, "a b " * 40)} <= tails


def plain_runs(text):
    return sorted(plain(re.findall(r"[^\x20\x09-\x0D]+", text)), key=lambda r: (r[0], r[2]))
