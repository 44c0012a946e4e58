"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits have a common neighbour at distance
one or less, and so meet if each is sent to all values within one bit of itself. Only
distinct fingerprints are sent out: 65 rows each, one of which says which bit was
turned. A meeting place then holds at most 65 fingerprints; its members come back out
of a sum of bits, so that no list is ever gathered and sums start before the shuffle.
All members of a place are linked to its smallest, found links are made distinct and
verified, and components are formed over fingerprints. Documents join at the end, by
fingerprint.

A null text counts as empty. A text without words has fingerprint zero and is linked
like any other. Equal texts have equal fingerprints and so one component. Rows with a
null id get a fingerprint and the component of the others, but no null is ever a
component's name unless all its rows have null ids. Repeated rows stay.
"""

import re

import numpy as np
import pyspark.sql.types as T
import xxhash
from pyspark.sql import functions as F

from maskwright.llm.common import map_texts, table, written
from maskwright.llm.components import connected_components

BITS = 64
RADIUS = 2
SEED = 42
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_FOLD = bytes.maketrans(_UPPER, _LOWER)
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(raw, size):
    """Space-joined runs of `size` words of UTF-8 bytes; one run of all if there are fewer."""
    words = _WORDS.findall(raw.translate(_FOLD))
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [line]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [line[a:b] for a, b in zip(starts.tolist(), ends[size - 1:].tolist())]


def fingerprint(raw, size=3):
    """The fingerprint as a signed 64-bit integer: a bit is set if over half the hashes have it."""
    runs = shingles(raw, size)
    if not runs:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(run, SEED) for run in runs], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[start:start + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprints(df, text="text", size=3):
    """`df` with `simhash`, a long."""

    def make():
        def work(texts):
            return [[fingerprint((t or "").encode("utf-8"), size) for t in texts.to_pylist()]]

        return work

    return map_texts(df, text, [("simhash", T.LongType())], make)


def near_links(distinct, fp="simhash"):
    """(a, b): links between distinct fingerprints that differ in one or two bits, enough
    to give the components that all such links give."""
    turned = F.posexplode(F.transform(
        F.sequence(F.lit(-1), F.lit(BITS - 1)),
        lambda i: F.when(i < 0, F.col(fp)).otherwise(F.col(fp).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))),
    )).alias("bit", "place")
    places = (
        distinct.select(turned)
        .groupBy("place").agg(
            F.bit_or(F.when(F.col("bit") > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") - 1)).otherwise(0)).alias("bits"),
            F.max(F.when(F.col("bit") == 0, 1).otherwise(0)).alias("own"),
        )
        .where(F.bit_count("bits") + F.col("own") > 1)
    )
    one = F.lit(1).cast("long")
    around = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.when(
            F.col("bits").bitwiseAND(F.call_function("shiftleft", one, i)) != 0,
            F.col("place").bitwiseXOR(F.call_function("shiftleft", one, i)))),
        lambda x: x.isNotNull())
    members = F.when(F.col("own") == 1, F.concat(F.array("place"), around)).otherwise(around)
    met = places.select(members.alias("members")).select(
        F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a != b").distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(docs, key="doc_id", text="text", size=3):
    """One row per document: the key, `fingerprint` (16 hex digits) and `component_id`, the
    smallest key that links of at most two bits lead to."""
    marked = written(fingerprints(docs.select(F.col(key), F.col(text)), text, size).drop(text))
    distinct = written(marked.groupBy("simhash").agg(F.min(key).alias("first")))
    comps = connected_components(near_links(distinct))
    named = (
        distinct.join(comps, distinct.simhash == comps.node, "left")
        .select("simhash", "first", F.coalesce("component", "simhash").alias("component"))
    )
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    # most components are one fingerprint: only the others need their least key
    final = named.join(least, "component").select(F.col("simhash").alias("_fp"), "component_id")
    return (
        marked.join(final, marked.simhash == F.col("_fp"))
        .select(key, F.lower(F.lpad(F.hex("simhash"), BITS // 4, "0")).alias("fingerprint"), "component_id")
    )


def representatives(docs, key="doc_id", text="text", size=3):
    """`docs` less all but one row of each near-duplicate group: that with the smallest key.

    Rows are told apart by key; of rows that repeat the smallest key one stays. Rows
    with a null key have no name to be kept or dropped by, and stay.
    """
    groups = near_duplicates(docs, key, text, size)
    keep = groups.where(F.col(key) == F.col("component_id")).select(F.col(key).alias("_keep")).distinct()
    named = docs.where(F.col(key).isNotNull()).dropDuplicates([key])
    return named.join(keep, F.col(key) == F.col("_keep"), "left_semi").unionByName(docs.where(F.col(key).isNull()))


def op2_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
