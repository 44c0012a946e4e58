"""Equi joins that hold up when one key has a large share of the rows."""

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

DEFAULT_SALTS = 16

# A key is hot with more rows than HOT_ROWS, and is split into parts of about that size.
HOT_ROWS = 100_000
#: Blocks of 64 bits in a table of bits that rows have to pass before a join: a bound on what is broadcast.
FILTER_BLOCKS = 1 << 20
# Null keys match nothing and are only spread.
NULL_SALTS = 4096


def _salt(spread_by, salts):
    return F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")


def _right_only_broadcast(right, how):
    """Only `right` may be broadcast, by adaptive execution and once its size has
    been measured. An inner join is asked to sort and merge instead: there the
    planner could also broadcast the left side, whose size it guesses far too low
    when its rows come out of an explode."""
    return right.hint("merge") if how == "inner" else right


def salted_join(left, right, keys, spread_by, how="left", salts=DEFAULT_SALTS):
    """`left.join(right, keys, how)` with every key split over `salts` tasks.

    For a `right` that is small next to `left`, as it is repeated once per salt:
    a dictionary, or the phrases to look for. `left` is read once. Rows of `left`
    are spread by the columns `spread_by`. `how` is `left`, `inner` or `left_semi`.
    """
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = left.withColumn("_salt", _salt(spread_by, salts))
    return salted.join(_right_only_broadcast(repeated, how), [*keys, "_salt"], how).drop("_salt")


def hot_keys(counts, keys):
    """The hot ones of `counts(keys…, n)` with `_parts`, the number of tasks that each is
    split over: as many as its rows ask for."""
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    return counts.filter(known & (F.col("n") > HOT_ROWS)).select(
        *keys, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("_parts"))


def skew_join(left, right, keys, spread_by, how="left", counts=None):
    """`left.join(right, keys, how)` that no large key holds up.

    Rows of `left` with a null key, which match nothing, are kept apart: a left join
    passes them on, any other drops them. The rest is an ordinary sort-merge join, whose
    large partitions adaptive execution splits by measured size, with no pass over `left`
    before. Where `counts(keys…, n)` of `left` are known, hot keys are split by them
    instead: rows of such a key go by `spread_by` to as many tasks as it fills, and its
    rows of `right` to each of these; all other keys keep one place.
    """
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    if counts is None:
        null = F.when(~known, _salt(spread_by, NULL_SALTS)).otherwise(F.lit(-1))
        spread = left.withColumn("_salt", null)
        fixed = right.withColumn("_salt", F.lit(-1))
        return spread.join(_right_only_broadcast(fixed, how), [*keys, "_salt"], how).drop("_salt")
    hot = hot_keys(counts, keys)
    parts = F.coalesce(F.col("_parts"), F.when(known, F.lit(1)).otherwise(F.lit(NULL_SALTS)))
    spread = left.join(hot, keys, "left").withColumn("_salt", _pmod_salt(spread_by, parts)).drop("_parts")
    repeated = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return spread.join(_right_only_broadcast(repeated, how), [*keys, "_salt"], how).drop("_salt")


def _pmod_salt(spread_by, parts):
    return F.pmod(F.xxhash64(*spread_by), parts.cast("long")).cast("int")


def _block_and_bit(keys):
    place = F.xxhash64(*keys)
    return (
        F.pmod(place, F.lit(FILTER_BLOCKS)).cast("int"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(place, 32), F.lit(64)).cast("int")),
    )


def with_may_match(left, right, keys):
    """`left` with `_may`, false where `right` has no row with these keys; it may be true of few
    others as long as `right` has far fewer rows than the table of bits. The table is an
    aggregate of `FILTER_BLOCKS` rows at most and broadcast, so `left` is not moved."""
    block, bit = _block_and_bit(keys)
    table = right.dropna(subset=keys).select(block.alias("_block"), bit.alias("_bit")).groupBy("_block").agg(
        F.bit_or("_bit").alias("_bits"))
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    marked = left.withColumn("_block", F.when(known, block)).withColumn("_bit", bit)
    joined = marked.join(F.broadcast(table), "_block", "left")
    may = F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    return joined.withColumn("_may", may).drop("_block", "_bit", "_bits")


def that_may_match(left, right, keys):
    """The rows of `left` that may have a match; the others are left out where they are scanned."""
    return with_may_match(left, right, keys).where("_may").drop("_may")
