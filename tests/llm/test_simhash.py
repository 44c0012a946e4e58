"""Fingerprints and components against brute force."""

import random
import re

import xxhash
from pyspark.sql import types as T

from maskwright.llm import simhash
from maskwright.llm.components import connected_components

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("fingerprint", T.StringType()), T.StructField("simhash", T.LongType())])


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    runs = [words[i:i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode("utf-8"), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_random_graphs(spark):
    dice = random.Random(4)
    for count, links in ((40, 30), (60, 200), (50, 49)):
        edges = [(dice.randrange(count), dice.randrange(count)) for _ in range(links)]
        if links == 49:  # a long chain in random order of names
            names = dice.sample(range(1000), 50)
            edges = list(zip(names, names[1:]))
        frame = spark.createDataFrame(edges + [(None, 1), (7, 7)], "a long, b long")
        got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
        nodes = {x for e in edges for x in e} | {7}
        assert got == roots(nodes, edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_links_give_all_links_of_two_bits(spark):
    dice = random.Random(5)
    base = [dice.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for b in base:
        for _ in range(6):
            b ^= 1 << dice.randrange(64)
            if dice.random() < 0.5:
                b ^= 1 << dice.randrange(64)
            prints.add(b)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "simhash long"))
    found = [(r["a"], r["b"]) for r in links.collect()]
    assert all((a ^ b & (1 << 64) - 1).bit_count() <= 64 for a, b in found)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in found)
    true = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    want, got = roots(signed, true), roots(signed, found)
    assert want == got


def test_documents_of_all_kinds(spark):
    long = " ".join(f"word{i % 700}" for i in range(60_000))
    texts = [None, "", " \t\n", "One two three", "one TWO three", "one two", "É é É", long, long + " x", "one two", "x y z w v"]
    rows = [(i, t, "mine", 5) for i, t in enumerate(texts)] + [(3, "One two three", "mine", 5), (None, "lonely text here now", "m", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        assert by[i][0]["fingerprint"] == f"{slow_fingerprint(t):016x}"
    prints = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {i: by[i][0]["component_id"] for i in prints} == roots(prints, linked)
    assert len(by[3]) == 2 and by[None][0]["component_id"] is None


def test_representatives_keep_one_of_each_group(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words stand here now"), (3, "other words stand here now"), (None, "a b c d e f")]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3]
    assert kept.where("doc_id is null").count() == 1 and kept.columns == ["doc_id", "text"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.representatives(empty).count() == 0
