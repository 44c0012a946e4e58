"""Pieces that the operators of this subpackage share."""

import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.types as T
import xxhash
from pyspark.sql import functions as F

from maskwright.session import work_root

#: Bytes of text that one numpy or Python step takes at a time; a longer text is a step of its own.
STEP_BYTES = 4 << 20


def table(spark, sf_dir, name, *columns):
    """The columns of a given table, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def crc_part(key, parts):
    """The part from 0 to `parts` - 1 that a row falls in, by the CRC-32 of its id as text."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def without(df, *names):
    """`df` less its own columns of these names: an operator's results take their place."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def steps(batch, column, limit=STEP_BYTES):
    """Slices of a record batch that hold about `limit` bytes of text each."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield batch.slice(start)


def arrow_column(values, kind):
    return values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values, kind)


def map_texts(df, text, fields, make, keep=None):
    """`df` with columns computed from one text column, batch after batch.

    `fields` is a list of (name, Spark type). `make()` runs once per task and
    returns a function from an Arrow array of texts to a list of columns. Columns
    of `df` with the names of results give way to these. `keep`, if given, names a
    boolean among the results: only its true rows go on, and the results are left
    out, so that `df` keeps its columns.
    """
    inner = [f"_result_{i}" for i in range(len(fields))] if keep is not None else [f[0] for f in fields]
    base = df if keep is not None else without(df, *[f[0] for f in fields if f[0].lower() != text.lower()])
    if keep is None and any(f[0].lower() == text.lower() for f in fields):
        raise ValueError("the text column cannot be a result too")
    arrow_types = [_arrow_type(kind) for _, kind in fields]
    pick = [f[0] for f in fields].index(keep) if keep is not None else None

    def run(batches):
        work = make()
        for batch in batches:
            for part in steps(batch, text):
                made = [arrow_column(v, k) for v, k in zip(work(part.column(text)), arrow_types)]
                if pick is not None:
                    yield part.filter(made[pick])
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *inner])

    kept = list(base.schema.fields)
    added = [] if keep is not None else [T.StructField(n, k) for n, k in fields]
    return base.mapInArrow(run, T.StructType(kept + added))


def _arrow_type(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def even_sample(df, key, limits, by):
    """A bounded sample of labelled rows, the same rows however the table is dealt out.

    One pass counts the rows of each value of `by`; then rows stay whose hashed
    `key` falls below `limit / count`. `limits` maps every value to its limit or is
    one limit for all.
    """
    counts = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count("*").alias("n")).collect()}
    return sampled(df, key, limits, by, counts), counts


def sampled(df, key, limits, by, counts):
    share = F.lit(0.0)
    for value, n in counts.items():
        limit = limits[value] if isinstance(limits, dict) else limits
        share = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, limit / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    return df.where(place < share)


def work_folder(spark):
    """Checkpoints go to the folder of `spark.checkpoint.dir`.

    Where the session has no such folder, as in tests, it gets the one of
    `maskwright.session.work_root`, which a cluster refuses to guess.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_root(spark))


def written(df):
    """`df` written once to the folder of `spark.checkpoint.dir`, and read from there."""
    work_folder(df.sparkSession)
    return df.checkpoint()


def labelled_sample(docs, labels, key, label, limit, text="text"):
    """(key, text, label) of at most about `limit` rows of each label.

    `labels` holds the keys and labels to learn from; rows without a label or text are
    left out, and of near copies one stays. The rows are picked by a hash of the key, so their number is bounded in
    expectation by `limit` times the number of labels; that is why their keys may be
    broadcast.
    """
    known = labels.select(F.col(key), F.col(label).cast("int").alias("label")).where(
        F.col(label).isNotNull() & F.col(key).isNotNull())
    picked, counts = even_sample(known, key, limit, "label")
    rows = docs.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(picked), key)
    for seed in (1, 2, 3):
        rows = _one_of_alike(rows, key, text, seed)
    return rows.select(key, text, "label"), counts


def _one_of_alike(rows, key, text, seed):
    """One row of those of a label whose texts share the least hash of five-word runs: a large
    group of near copies must not teach its own words."""
    from maskwright.llm.simhash import shingles

    def least(texts: pa.Array) -> pa.Array:
        return pa.array([min((xxhash.xxh64_intdigest(run, seed) for run in shingles(t.encode("utf-8"), 5)), default=0) >> 1
                         for t in texts.to_pylist()], pa.int64())

    marked = rows.withColumn("_alike", F.arrow_udf(least, "long")(F.col(text)))
    return marked.groupBy("_alike", "label").agg(
        F.min_by(F.struct(*rows.columns), F.xxhash64(key)).alias("row")).select("row.*")


def logistic(x, y, weight=None, ridge=1e-3, rounds=50):
    """Weights of a ridge logistic regression by Newton's steps; the last one is the intercept."""
    import numpy as np

    x = np.hstack([np.asarray(x, float), np.ones((len(x), 1))])
    y, weight = np.asarray(y, float), np.ones(len(x)) if weight is None else np.asarray(weight, float)
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w)) * max(1.0, weight.sum())
    penalty[-1, -1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)),
                               x.T @ (weight * (p - y)) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w
