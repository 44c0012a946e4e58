"""Entity tables: long form, splits and counts."""

from pyspark.sql import functions as F

from maskwright.functions.entities import entities_all, entities_distinct
from maskwright.schema import KINDS


def with_values(docs, pii="pii"):
    """Add `values`, the distinct values of all kinds, first seen first."""
    return docs.withColumn("values", entities_distinct(entities_all(F.col(pii))))


def entities_long(docs, id_col="doc_id", pii="pii"):
    """Long form `(doc_id, kind, ord, value)`, one row per mention."""
    lists = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(pii)[k].alias("items")) for k in KINDS]
    )
    # One pass over the five lists, so that detection is not repeated per kind.
    flat = F.flatten(
        F.transform(
            lists,
            lambda one: F.transform(
                one["items"],
                lambda v, i: F.struct(one["kind"].alias("kind"), i.alias("ord"), v.alias("value")),
            ),
        )
    )
    return docs.select(id_col, F.explode(flat).alias("e")).select(
        id_col, F.col("e.kind").alias("kind"), F.col("e.ord").alias("ord"),
        F.col("e.value").alias("value"),
    )


def docs_with_pii(docs, values="values"):
    return docs.filter(F.size(values) > 0)


def docs_without_pii(docs, values="values"):
    return docs.filter(F.coalesce(F.size(values), F.lit(0)) <= 0)


def count_columns(pii):
    """One count per kind, before distinct."""
    return [F.coalesce(F.size(pii[k]), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]


def entity_counts(docs, id_col="doc_id", text="text", pii="pii"):
    """Per document: mentions of each kind and text length."""
    return docs.select(
        id_col, *count_columns(F.col(pii)), F.length(text).cast("long").alias("text_len")
    )


def entity_counts_from_long(entities, id_col="doc_id"):
    """The same counts from the long form; documents without mentions have no row."""
    counts = [
        F.count(F.when(F.col("kind") == k, F.lit(1))).alias(f"n_{k}") for k in KINDS
    ]
    return entities.groupBy(id_col).agg(*counts)


def corpus_summary(entities):
    """Per kind: mentions, distinct values, documents.

    Counts are taken per value first, which combines a hot value before the shuffle
    and spreads a kind over its values. Every document has one mention with
    `ord = 0` per kind it holds, so documents need no distinct count.
    """
    per_value = entities.groupBy("kind", "value").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.count(F.when(F.col("ord") == 0, F.lit(1))).alias("documents"),
    )
    return per_value.groupBy("kind").agg(
        F.sum("mentions").alias("mentions"),
        F.count(F.lit(1)).alias("distinct_values"),
        F.sum("documents").alias("documents"),
    )


def input_counts(inputs, by="ext"):
    """Number of inputs per extension (or any other column)."""
    return inputs.groupBy(by).agg(F.count(F.lit(1)).alias("n_inputs"))
