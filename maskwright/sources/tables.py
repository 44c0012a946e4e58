"""Tables of texts as input: any string column is a document."""

from pyspark.sql import functions as F


def documents_source(spark, path, id_col="doc_id", text_col="text", keep=()):
    """Read `(doc_id, text)` and the columns in `keep` from parquet.

    Only those columns are read. Input of a few file splits (one small file, say) is
    spread by its key; larger input already comes in many splits and is left as it lies.
    """
    df = spark.read.parquet(path).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep
    )
    return spread_small(spark, df, "doc_id")


#: Fewer splits than this are too few for a cluster, and little enough to be shuffled.
FEW_SPLITS = 32


def spread_small(spark, df, key):
    """Repartition input that comes in fewer than FEW_SPLITS splits, if that is less than
    one per core; else no shuffle, however many cores there are."""
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < min(cores, FEW_SPLITS) else df
