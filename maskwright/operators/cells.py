"""Shared-string lookup of cells."""

from pyspark.sql import functions as F

from maskwright.operators.joins import skew_join
from maskwright.schema import FAILED

_SPREAD = ["sheet", "cell_ord"]


def resolve_cells(cells, sst):
    """Add `text`, and `status` = `failed` where an index points nowhere.

    A shared-string cell takes the text of its index; any other cell, and every
    cell of a file without a shared-string table, keeps its raw inner text. The
    lookup is one equi join on file and index.

    A missing text is wrong only where the file has a table at all: the column
    `has_sst` of `cells` says so; without it the table is asked in a join of its own.
    """
    columns = [c for c in cells.columns if c != "has_sst"]
    if "has_sst" not in cells.columns:
        tables = sst.select("path").distinct().withColumn("has_sst", F.lit(True))
        cells = skew_join(cells, tables, ["path"], _SPREAD)
    index = F.when(F.col("dtype") == "s", F.col("raw").try_cast("int"))
    # Cells that look nothing up get numbers below all indexes, spread by position.
    elsewhere = -1 - F.pmod(F.xxhash64(*_SPREAD), F.lit(1 << 20)).cast("int")
    asked = cells.withColumn("_asks", index.isNotNull()).withColumn(
        "_idx", F.when(index >= 0, index).otherwise(elsewhere)
    )
    lookup = sst.select(
        "path", F.col("idx").alias("_idx"), F.coalesce("text", F.lit("")).alias("_shared")
    )
    joined = skew_join(asked, lookup, ["path", "_idx"], _SPREAD)
    broken = F.col("_asks") & F.col("_shared").isNull() & F.coalesce("has_sst", F.lit(False))
    return joined.select(
        *columns,
        F.when(~broken, F.coalesce("_shared", "raw")).alias("text"),
        F.when(broken, F.lit(FAILED)).alias("status"),
    )
