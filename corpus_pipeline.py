"""A corpus pipeline of five stages; each works on all that the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a table; `run` writes it as Parquet in
the folder of `spark.checkpoint.dir` and reads it back for the next. All but the last
return the columns of `documents`. An empty table gives empty tables all through.
"""

import os

from maskwright.llm import byte_bpe, decontamination, language, quality, simhash
from maskwright.session import ship_packages, work_path

ROOT = os.path.dirname(os.path.abspath(__file__))


def language_stage(spark, docs, sf_dir):
    """Drops documents that the language model rejects: no letters, or far from all centroids."""
    ship_packages(spark, ROOT, ("maskwright",))
    return language.accepted(docs, language.fit(docs))


def quality_stage(spark, docs, sf_dir):
    """Drops documents that the quality model, learnt from labels of these documents, rejects."""
    ship_packages(spark, ROOT, ("maskwright",))
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark, docs, sf_dir):
    """Keeps one document, that with the smallest id, of each near-duplicate group."""
    ship_packages(spark, ROOT, ("maskwright",))
    return simhash.representatives(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Drops documents that hold a benchmark item within its budget of edits."""
    ship_packages(spark, ROOT, ("maskwright",))
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark, docs, sf_dir):
    """Token counts, and digests of the ids and of the decoded bytes."""
    ship_packages(spark, ROOT, ("maskwright",))
    return byte_bpe.round_trip(docs.select("doc_id", "text")).drop("text")


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", encoding_stage),
]

#: Learnt models and edit distances are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = work_path(spark, f"pipeline-{name}")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
