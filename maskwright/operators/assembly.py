"""Put text together again from rows of runs, cells or words.

The result is one string per document, so it has to fit in a row. It is joined in
three steps: first neighbours that follow one another where they lie, so that a shuffle moves
texts and not a row for each word, then blocks of up to BLOCK neighbours, then the blocks of a
document, so that a document, or a page of it, with very many rows is not sorted in one task
row by row.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions.text import is_blank
from maskwright.session import small_batches

BLOCK = 1024


def _differ(column):
    """Whether each value but the first is another than the one before."""
    a, b = column[1:], column[:-1]
    other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return other | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def _join_neighbours(batches):
    """Rows `(key, group, _block, _at, _piece)` that lie next to each other in a block, with `_at`
    one more each time, as `(key, group, _block, _at, _sizes, _text)`. To cut such a run anywhere
    changes nothing, so it ends with its batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, group, block, at, piece = batch.columns
        place = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
        begins = np.ones(batch.num_rows, bool)
        begins[1:] = _differ(key) | _differ(group) | _differ(block) | (np.diff(place) != 1)
        unplaced = at.is_null().to_numpy(zero_copy_only=False)
        begins |= unplaced
        begins[1:] |= unplaced[:-1]
        first = np.flatnonzero(begins)
        bounds = pa.array(np.append(first, batch.num_rows).astype(np.int32))
        piece = piece.cast(pa.string())
        ends = np.frombuffer(piece.buffers()[1], np.int32)[piece.offset:piece.offset + len(piece) + 1]
        text = pa.StringArray.from_buffers(
            len(first), pa.py_buffer(np.append(ends[first], ends[-1]).astype(np.int32).tobytes()), piece.buffers()[2])
        taken = [column.take(pa.array(first)) for column in (key, group, block, at)]
        sizes = pa.ListArray.from_arrays(bounds, pc.utf8_length(piece))
        yield pa.RecordBatch.from_arrays([*taken, sizes, text], names=[*batch.schema.names[:4], "_sizes", "_text"])


def _in_order(runs):
    """The text of a block's sorted runs. Where runs overlap, as rows repeat or lie in several places,
    their pieces are sorted one by one."""
    clash = F.exists(
        F.zip_with(runs, F.slice(runs, F.lit(2), F.size(runs)), lambda a, b: F.when(
            b.isNotNull(), ~F.coalesce(b["_at"] >= a["_at"] + F.size(a["_sizes"]), F.lit(False)))),
        lambda hit: F.coalesce(hit, F.lit(False)))

    def pieces(run):
        def piece(size, i):
            before = F.aggregate(F.slice(run["_sizes"], F.lit(1), i), F.lit(0), lambda n, m: n + m)
            return F.struct((run["_at"] + i).alias("at"), F.substr(run["_text"], before + 1, size).alias("p"))

        return F.transform(run["_sizes"], piece)

    one_by_one = F.array_sort(F.flatten(F.transform(runs, pieces)))
    return F.when(clash, F.array_join(F.transform(one_by_one, lambda row: row["p"]), "")).otherwise(
        F.array_join(F.transform(runs, lambda run: run["_text"]), ""))


def _assemble(rows, key, group, at, piece, end=""):
    """`(key, text)`: pieces in the order of `group` and `at`, and `end` after each
    group. `at` counts up within a group; rows without one stand for an empty group."""
    small_batches(rows.sparkSession)
    block = F.coalesce(F.floor(F.col(at) / BLOCK), F.lit(0)).cast("long").alias("_block")
    ready = rows.select(key, group, block, F.col(at).cast("long").alias("_at"), F.coalesce(piece, F.lit("")).alias("_piece"))
    made = T.StructType([*ready.drop("_piece").schema.fields, T.StructField("_sizes", T.ArrayType(T.IntegerType())),
                         T.StructField("_text", T.StringType())])
    blocks = (
        ready.mapInArrow(_join_neighbours, made).groupBy(key, group, "_block")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_text", "_sizes"))).alias("_runs"))
        .select(key, group, "_block", _in_order(F.col("_runs")).alias("_text"))
    )
    whole = blocks.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(group, "_block", "_text"))).alias("_blocks")
    )

    def with_end(row, i):
        following = F.get("_blocks", i + 1)
        closes = following.isNull() | (following[group] != row[group])
        return F.concat(row["_text"], F.when(closes, F.lit(end)).otherwise(F.lit("")))

    return whole.select(key, F.array_join(F.transform("_blocks", with_end), "").alias("text"))


def _spaced(text):
    return F.when(~is_blank(text), F.concat(text, F.lit(" ")))


def assemble_docx(segments, key="path"):
    """Runs of a paragraph joined with nothing; newline after every paragraph."""
    return _assemble(segments, key, "para", "seg", F.col("text"), "\n")


def assemble_pptx(segments, key="path"):
    """Non-blank runs each followed by one space; newline after each slide.
    `seg` counts the runs of a slide."""
    return _assemble(segments, key, "part", "seg", _spaced(F.col("text")), "\n")


def assemble_xlsx(cells, key="path"):
    """Non-blank cell texts each followed by one space, all sheets."""
    return _assemble(cells, key, "sheet", "cell_ord", _spaced(F.col("text")))


def assemble_words(words, key="doc_id"):
    """Each word followed by one space; newline after each page."""
    return _assemble(words, key, "page", "pos", F.concat("word", F.lit(" ")), "\n")
