"""Masking of documents, text runs and cells."""

from pyspark.sql import functions as F

from maskwright.functions.entities import apply_masks, entities_distinct, mask_cell, mask_pairs
from maskwright.operators.joins import skew_join, with_may_match
from maskwright.session import durable

#: Bytes of lists of masks that are sent to all tasks, with PAIR_BYTES for the rest of each pair and row.
BROADCAST_BYTES, PAIR_BYTES = 64 * 1024 * 1024, 64


def redact_documents(docs, text="text", values="values"):
    """Add `masked_text`. The replacement list is built once per document."""
    return (
        docs.withColumn("_pairs", mask_pairs(F.col(values)))
        .withColumn("masked_text", apply_masks(F.col(text), F.col("_pairs")))
        .drop("_pairs")
    )


def redact_segments(segments, text="text", values="values"):
    """Mask each text run on its own with the list in its row.

    A value that is split over two runs stays, as each run is looked at alone.
    Adds `masked_text` and `changed`.
    """
    masked = redact_documents(segments, text, values)
    changed = F.coalesce(F.col("masked_text") != F.col(text), F.lit(False))
    return masked.withColumn("changed", changed)


def redact_segments_by_list(segments, lists, key="path", spread_by=("part", "para", "seg"), broadcast_bytes=BROADCAST_BYTES):
    """The same with the lists in a table `(key, values)`, one row per document.

    Only documents that have values take part, with their masks ready made. These are
    written and measured: up to `BROADCAST_BYTES` they go to where the runs are, and no run
    is moved. Beyond that a table of bits says which runs may belong to one of them; only
    these are joined, the runs of a very large document spread over several tasks, and all
    others pass by.
    """
    pairs = durable(segments.sparkSession, lists.select(key, mask_pairs(F.col("values")).alias("_pairs")).filter(
        F.size("_pairs") > 0), "masks")
    texts = F.aggregate("_pairs", F.lit(0), lambda n, p: n + F.octet_length(p["value"]) + F.octet_length(p["mask"]) + PAIR_BYTES)
    if (pairs.agg(F.sum(texts + PAIR_BYTES)).first()[0] or 0) <= broadcast_bytes:
        joined = segments.join(F.broadcast(pairs), key, "left")
    else:
        marked = with_may_match(segments, pairs, [key])
        hit = skew_join(marked.where("_may").drop("_may"), pairs, [key], spread_by)
        rest = marked.where("not _may").drop("_may")
        joined = hit.unionByName(rest.withColumn("_pairs", F.lit(None).cast(pairs.schema["_pairs"].dataType)))
    masked = joined.withColumn("masked_text", apply_masks(F.col("text"), F.col("_pairs")))
    changed = F.coalesce(F.col("masked_text") != F.col("text"), F.lit(False))
    return masked.withColumn("changed", changed).drop("_pairs")


def mask_cells(cells, text="text", values="values"):
    """A cell that holds any value becomes `[MASKED]`. Adds `masked_text`, `changed`."""
    masked = cells.withColumn(
        "masked_text", mask_cell(F.col(text), entities_distinct(F.col(values)))
    )
    changed = F.coalesce(F.col("masked_text") != F.col(text), F.lit(False))
    return masked.withColumn("changed", changed)


def changed_parts(segments, keys=("path", "part")):
    """Which parts have a changed run, so that only those are written anew."""
    return segments.groupBy(*keys).agg(F.bool_or("changed").alias("changed"))
