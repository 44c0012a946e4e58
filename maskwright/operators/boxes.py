"""Positioned words: find phrases on pages and turn them into rectangles to draw."""

from pyspark.sql import functions as F

from maskwright.functions.text import is_blank
from maskwright.operators.joins import salted_join, skew_join, that_may_match
from maskwright.session import durable

START_BLOCK = 1024


def _phrase_tokens(phrases, key):
    """One row per word of each phrase, with the phrase's length and whether the
    phrase can overlap itself (some proper start of it is also its end)."""
    tokens = F.filter(F.split(F.lower("phrase"), "[ \t\r\n]+"), lambda t: F.length(t) > 0)
    sized = (
        phrases.filter(~is_blank(F.col("phrase")))
        .select(key, "phrase").distinct()
        .withColumn("_tokens", tokens)
        .withColumn("_n", F.size("_tokens"))
    )
    overlaps = F.when(
        F.col("_n") > 1,
        F.exists(
            F.sequence(F.lit(1), F.greatest(F.col("_n") - 1, F.lit(1))),
            lambda d: F.slice("_tokens", F.lit(1), F.col("_n") - d)
            == F.slice("_tokens", d + 1, F.col("_n") - d),
        ),
    ).otherwise(F.lit(False))
    return sized.withColumn("_overlaps", overlaps).select(
        key, "phrase", "_n", "_overlaps", F.posexplode_outer("_tokens").alias("_k", "_token")
    )


def phrase_boxes(words, phrases, key="doc_id"):
    """Boxes `(doc_id, phrase, page, start, x, y, w, h)` of a document's phrases.

    `words` is `(doc_id, page, pos, word, x, y, w, h)` with consecutive `pos` on a
    page; `phrases` is `(doc_id, phrase)`. Words are compared without case; a match
    stays on its page; matches of a phrase are taken left to right and do not
    overlap.

    Words that are in no phrase of their document are left out before any shuffle. Word k
    of a phrase votes for the start `pos - k`; a start with all votes is a match. A long page is spread over its starts, and no page or document is held
    in one task. The matches, few next to the words, are written to the shared
    folder once, as phrases that can overlap themselves take a second look at them.
    """
    parts = durable(words.sparkSession, _phrase_tokens(phrases, key), "tokens")
    some = that_may_match(words.withColumn("_token", F.lower("word")), parts, [key, "_token"])
    votes = salted_join(some, parts, [key, "_token"], ["page", "pos"], "inner")
    k, n = F.col("_k"), F.col("_n")
    matches = (
        votes.groupBy(key, "phrase", "page", (F.col("pos") - k).alias("start"), "_n", "_overlaps")
        .agg(
            F.count(F.lit(1)).alias("_votes"),
            F.max(F.when(k == 0, F.col("x"))).alias("_left"),
            F.max(F.when(k == n - 1, F.col("x") + F.col("w"))).alias("_right"),
            F.min("y").alias("_bottom"),
            F.max(F.col("y") + F.col("h")).alias("_top"),
        )
        .filter(F.col("_votes") == n)
    )
    matches = durable(words.sparkSession, matches, "matches")
    keys = [key, "phrase", "page"]
    chained = matches.filter("_overlaps")
    kept = chained.join(_without_overlaps(chained, keys), [*keys, "start"], "left_semi")
    return (
        matches.filter("not _overlaps")
        .unionByName(kept)
        .select(
            *keys, "start",
            F.col("_left").alias("x"), F.col("_bottom").alias("y"),
            (F.col("_right") - F.col("_left")).alias("w"),
            (F.col("_top") - F.col("_bottom")).alias("h"),
        )
    )


def _without_overlaps(matches, keys):
    """Starts that a scan from the left takes, skipping what overlaps the last one.

    The scan runs in blocks of positions. Where a block may begin depends on the
    last match before it, which reaches at most n - 1 positions into it: each block
    says for all of these where it would end up, the blocks of a page are chained
    by that, and then each block is scanned once more from its true beginning.
    """
    n, start = F.col("_n"), F.col("start")
    blocks = (
        matches.groupBy(*keys, "_n", F.floor(start / START_BLOCK).alias("_block"))
        .agg(F.array_sort(F.collect_list(start)).alias("_starts"))
        .withColumn("_base", F.col("_block") * START_BLOCK)
    )

    def step(free, s):
        return F.when(s >= free, s + n).otherwise(free)

    starts = F.transform("_starts", lambda s: s.cast("long"))
    exits = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda into: F.aggregate(starts, (F.col("_base") + into).cast("long"), step),
    )
    described = blocks.select(*keys, F.struct("_block", "_base", exits.alias("exits")).alias("b"))

    def enter(state, b):
        into = F.greatest(state["free"] - b["_base"], F.lit(0).cast("long")).cast("int")
        entry = F.struct(b["_block"].alias("_block"), (b["_base"] + into).cast("long").alias("_free"))
        return F.struct(
            F.get(b["exits"], into).alias("free"), F.concat(state["seen"], F.array(entry)).alias("seen")
        )

    begin = F.struct(
        F.lit(-(2**62)).cast("long").alias("free"),
        F.array().cast("array<struct<_block:bigint,_free:bigint>>").alias("seen"),
    )
    entries = (
        described.groupBy(*keys).agg(F.array_sort(F.collect_list("b")).alias("bs"))
        .select(*keys, F.explode(F.aggregate("bs", begin, enter)["seen"]).alias("e"))
        .select(*keys, F.col("e._block").alias("_block"), F.col("e._free").alias("_free"))
    )

    def pick(state, s):
        taken = s >= state["free"]
        return F.struct(
            F.when(taken, s + n).otherwise(state["free"]).alias("free"),
            F.when(taken, F.concat(state["taken"], F.array(s))).otherwise(state["taken"]).alias("taken"),
        )

    scan = F.aggregate(
        starts,
        F.struct(F.col("_free").alias("free"), F.array().cast("array<bigint>").alias("taken")),
        pick,
    )
    return blocks.join(entries, [*keys, "_block"]).select(
        *keys, F.explode(scan["taken"]).alias("start")
    )


def page_boxes(boxes, page_dim, key="doc_id"):
    """Boxes measured from the top of the page instead of its bottom.

    Boxes on a page that `page_dim(doc_id, page, height)` does not list are out of
    range and dropped. Drawing needs them by page: sort or partition by `page`.
    """
    joined = skew_join(
        boxes, page_dim.select(key, "page", "height"), [key, "page"], ["x", "y"], "inner"
    )
    return joined.withColumn("y", F.col("height") - F.col("y") - F.col("h")).drop("height")
