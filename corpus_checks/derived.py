"""Inputs of the operators, derived by Spark from the given tables.

Every one covers its whole table: lines of a document play runs, slides, cells and
words, and documents become files of a type that follows from their language.
"""

import pyarrow as pa
from pyspark.sql import functions as F

from corpus_checks import office_files
from maskwright.plans.mask_documents import detect_values
from maskwright.session import small_batches, work_path
from maskwright.sources.sinks import write_files
from maskwright.sources.tables import documents_source

SLIDE_LINES = office_files.SLIDE_LINES
SHARED_FROM = office_files.SHARED_FROM


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir, *keep):
    return documents_source(spark, f"{sf_dir}/documents.parquet", keep=keep)


def detected(spark, sf_dir, *keep):
    return detect_values(documents(spark, sf_dir, *keep))


def doc_path(ext):
    """`/c/<source>/<doc_id><ext>`"""
    return F.concat(F.lit("/c/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ext)


def ext_by_language():
    lang = F.col("lang")
    return (
        F.when(lang == "de", ".docx").when(lang == "fr", ".pptx").when(lang == "es", ".xlsx")
        .otherwise(".TXT")
    )


def lines(docs, *keep):
    """`(doc_id, keep..., line, text)`, one row per line."""
    return docs.select("doc_id", *keep, F.posexplode_outer(F.split("text", "\n")).alias("line", "text"))


def docx_rows(docs, *keep):
    """Lines as paragraphs, sentences as runs; an empty line is a row without run."""
    cut = F.split("text", r"\. ")
    runs = F.transform(
        cut, lambda run, i: F.when(i < F.size(cut) - 1, F.concat(run, F.lit(". "))).otherwise(run)
    )
    runs = F.when(F.length("text") > 0, runs)
    return lines(docs, *keep).select(
        "doc_id", *keep, F.lit(0).alias("part"), F.col("line").alias("para"),
        F.posexplode_outer(runs).alias("seg", "text"),
    )


def pptx_rows(docs, *keep):
    """Lines as runs, SLIDE_LINES of them per slide."""
    return lines(docs, *keep).select(
        "doc_id", *keep,
        (F.floor(F.col("line") / SLIDE_LINES) + 1).cast("int").alias("part"),
        F.lit(0).alias("para"),
        (F.col("line") % SLIDE_LINES).alias("seg"), "text",
    )


def cell_rows(docs, *keep):
    """Lines as cells; long ones are shared strings found by the number of the line."""
    shared = F.length("text") >= SHARED_FROM
    return lines(docs, *keep).select(
        "doc_id", *keep, F.lit(1).alias("sheet"), F.col("line").alias("cell_ord"),
        F.when(shared, F.lit("s")).otherwise(F.lit("inlineStr")).alias("dtype"),
        F.when(shared, F.col("line").cast("string")).otherwise(F.col("text")).alias("raw"),
    )


def word_rows(docs, *keep):
    """Blank-separated words, one page per SLIDE_LINES lines, on a grid of boxes."""
    page = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.transform(
            F.split(line, " "),
            lambda w: F.struct((F.floor(i / SLIDE_LINES) + 1).cast("int").alias("page"),
                               i.alias("line"), w.alias("word")),
        ),
    )
    words = F.filter(F.flatten(page), lambda w: F.length(w["word"]) > 0)
    rows = docs.select("doc_id", *keep, F.posexplode_outer(words).alias("pos", "w"))
    rows = rows.filter(F.col("pos").isNotNull())
    return rows.select(
        "doc_id", *keep, F.col("w.page").alias("page"), "pos", F.col("w.word").alias("word"),
        (F.col("pos") * 10).cast("double").alias("x"),
        (F.col("w.line") * 12).cast("double").alias("y"),
        (F.length("w.word") * 0.5).cast("double").alias("w"),
        F.lit(8.0).alias("h"),
    )


def file_rows(spark, sf_dir, ext=None):
    """`(path, ext, modificationTime, length, content)` with each document as a file,
    of the type `ext` (a string or a column)."""
    small_batches(spark)
    docs = documents(spark, sf_dir, "lang", "source")
    kind = ext_by_language() if ext is None else F.lit(ext)

    @F.arrow_udf("binary")
    def build(kinds: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array(
            [office_files.build(k.as_py(), t.as_py()) for k, t in zip(kinds, texts)], pa.binary()
        )

    made = docs.select("doc_id", "lang", "source", "text", kind.alias("_ext"))
    return made.select(
        "doc_id", "lang", "source", "text",
        doc_path(F.col("_ext")).alias("path"),
        F.lower("_ext").alias("ext"),
        F.lit(None).cast("timestamp").alias("modificationTime"),
        build("_ext", "text").alias("content"),
    ).withColumn("length", F.length("content").cast("long"))


def folder(spark, rows):
    """Write `(path, content)` rows as files into a fresh shared folder."""
    root, report = work_path(spark, "files"), work_path(spark, "report")
    write_files(rows.select("path", F.col("path").alias("out_path"), "content"), root, report)
    return root


def below(root):
    """The part of a scanned path below `root`, as `/...`."""
    return F.regexp_replace("path", f"^.*/{root.rstrip('/').rsplit('/', 1)[-1]}/", "/")


def dictionary(spark, sf_dir):
    """The benchmark passages as a dictionary: with a comma companies, else names."""
    kind = F.when(F.contains(F.col("text"), F.lit(",")), "company_name").otherwise("human_name")
    return table(spark, sf_dir, "benchmark").select(kind.alias("kind"), F.col("text").alias("value"))
