"""Approximate nearest neighbours by cosine with a forest of hash prefixes.

A tree gives a vector a string of 64 bits: the sides of 64 random planes that it lies on,
the first plane first. The strings of a block of vectors are a sorted array per tree. A
query descends in each tree to its longest prefix match: the array's neighbours of its own
string say how many bits that has. From the longest match of all trees it ascends in all of
them together, a bit at a time, until the strings with its prefix are enough: a share of the
block, and so many that there have to be more than k vectors. These are its candidates, a
range of each sorted array. They are scored in double precision against the
vectors themselves, and the nearest of all blocks are the answer.

Rows are dealt out over blocks by a hash of their keys, so that blocks are of one size
whatever the vectors are: a group of equal or nearly equal vectors is spread like others.
Every query goes to every block; what counts as enough is a share of the block, the same
for blocks and tables of all sizes. Every candidate of a query is scored where it lives, so
no pair of rows is shuffled, and a task holds one block and a small batch of queries.

Vectors that are null, zero, or hold null or non-finite components take no part, and
neither do rows with a null key, nor vectors of another length than most have (of several
such lengths the longest). Rows that share a key count once, by their least vector. Equal
scores go by key. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Window
from pyspark.sql import functions as F

from maskwright.llm.common import table, written
from maskwright.llm.vector_codes import common_length, usable

TREES, BITS, SEED = 32, 64, 12
#: Rows of a block, on average.
BLOCK = 4096
#: Strings met in all trees together, as a share of the block's vectors, that end the ascent.
ENOUGH = 1.0
#: Queries that are looked up at a time.
BATCH = 256


def planes(dims, trees=TREES, seed=SEED):
    """Normals of all planes, tree after tree; the same wherever they are made."""
    return np.random.default_rng([seed, dims]).standard_normal((trees * BITS, dims))


def matrix(vectors):
    """Arrow lists of numbers of one length -> matrix, each row scaled by a power of two so
    that its squares neither vanish nor overflow. This does not change a cosine."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    rows = flat.reshape(len(vectors), -1)
    _, power = np.frexp(np.abs(rows).max(axis=1, initial=0))
    return np.ldexp(rows, -power[:, None])


def cosines(rows, query):
    """Cosine of each row and the query; equal rows have equal ones, whatever stands around."""
    norm = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum())
    return (rows * query).sum(axis=1) / norm


class Forest:
    """Sorted arrays of the hash strings of one block of vectors."""

    def __init__(self, keys, rows, normals):
        self.keys, self.rows, self.normals = np.asarray(keys), rows, normals
        self.unit = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
        strings = self.strings(rows)
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(strings, self.order, axis=0).T)
        self.order = np.ascontiguousarray(self.order.T)

    def strings(self, rows):
        """(row, tree) -> 64 bits as a number, the first plane highest."""
        sides = (rows @ self.normals.T > 0).reshape(len(rows), -1, BITS)
        return np.packbits(sides, axis=2).view(">u8")[:, :, 0].astype(np.uint64)

    def longest(self, strings):
        """Bits of the longest prefix that a query shares with any string, by query and tree."""
        best = np.zeros(strings.shape, np.int64)
        for t, own in enumerate(self.sorted):
            at = np.searchsorted(own, strings[:, t])
            for near in (np.minimum(at, len(own) - 1), np.maximum(at - 1, 0)):
                best[:, t] = np.maximum(best[:, t], BITS - _length(own[near] ^ strings[:, t]))
        return best

    def range(self, strings, bits):
        """(first, past the last) of the strings that share so many bits, by query and tree."""
        free = np.uint64(2 ** (BITS - bits) - 1)
        first, last = np.empty(strings.shape, np.int64), np.empty(strings.shape, np.int64)
        for t, own in enumerate(self.sorted):
            low = strings[:, t] & ~free
            first[:, t], last[:, t] = np.searchsorted(own, low), np.searchsorted(own, low | free, "right")
        return first, last

    def candidates(self, rows, enough):
        """Row numbers of the candidates of each query, by a descent and a synchronous ascent."""
        strings = self.strings(rows)
        start = self.longest(strings).max(axis=1)
        found = [None] * len(rows)
        open_ = np.arange(len(rows))
        for bits in range(int(start.max(initial=0)), -1, -1):
            here = open_[start[open_] >= bits]
            if not len(here):
                continue
            first, last = self.range(strings[here], bits)
            done = ((last - first).sum(axis=1) >= enough) | (bits == 0)
            for i in np.flatnonzero(done):
                met = np.zeros(len(self.rows), bool)
                for t in range(len(self.order)):
                    met[self.order[t, first[i, t]:last[i, t]]] = True
                found[here[i]] = np.flatnonzero(met)
            open_ = np.setdiff1d(open_, here[done])
            if not len(open_):
                break
        return found

    def nearest(self, keys, rows, k, enough):
        """(query, key, score) of the k nearest candidates of each query, itself left out."""
        unit = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
        for i, met in enumerate(self.candidates(rows, enough)):
            met = met[self.keys[met] != keys[i]]
            if len(met) > k:
                # all that may be among the k nearest, rounding allowed for; then exactly
                about = self.unit[met] @ unit[i]
                met = met[about >= np.partition(about, -k)[-k] - 1e-9]
            score = cosines(self.rows[met], rows[i])
            for j in np.lexsort((self.keys[met], -score))[:k]:
                yield keys[i], self.keys[met[j]], score[j]


def _length(x):
    """Bits of each 64-bit number up to its highest one."""
    high, low = (x >> np.uint64(32)).astype(np.int64), (x & np.uint64(0xFFFFFFFF)).astype(np.int64)
    _, a = np.frexp(high.astype(np.float64))
    _, b = np.frexp(low.astype(np.float64))
    return np.where(high > 0, a.astype(np.int64) + 32, b)


def search(df, is_query, k=5, key="vec_id", vector="embedding", trees=TREES, block=BLOCK, enough=ENOUGH, batch=BATCH):
    """The `k` nearest rows of `df` found for each of its rows that `is_query`, a condition on
    the key, names: `query_id`, `rank` from 1, `key` and `score`, the cosine."""
    if not isinstance(df.schema[key].dataType, T.LongType):
        raise TypeError("keys have to be longs")
    name = f"{key}_" if key in ("query_id", "rank", "score") else key
    fit = df.where(F.col(key).isNotNull() & usable(F.col(vector)) & F.exists(vector, lambda x: x != 0))
    dims = common_length(fit, vector)
    shape = T.StructType([T.StructField("query_id", T.LongType()), T.StructField(name, T.LongType()), T.StructField("score", T.DoubleType())])
    if not dims:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, " + f"`{name}` long, score double")
    rows = written(fit.where(F.size(vector) == F.lit(dims)).groupBy(F.col(key).alias("id")).agg(F.min(vector).alias("v")))
    blocks = max(1, -(-rows.count() // block))
    # a block's own rows come first, then all queries
    own = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "v")
    asking = rows.where(F.coalesce(is_query(F.col("id")), F.lit(False))).select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "id", "v")
    dealt = own.unionByName(asking).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks", "id")

    def run(batches):
        normals, forest, held = planes(dims, trees), None, []
        at = None
        for part in batches:
            for first, last, number, asks in _stretches(part):
                if number != at:
                    at, forest, held = number, None, []
                ids = part.column("id").slice(first, last - first).to_numpy()
                vectors = matrix(part.column("v").slice(first, last - first))
                if not asks:
                    held.append((ids, vectors))
                    continue
                if forest is None:
                    if not held:
                        continue  # no row of the table fell into this block
                    forest = Forest(*(np.concatenate(x) for x in zip(*held)), normals)
                for i in range(0, len(ids), batch):
                    least = max(enough * len(forest.keys), (k + 1) * trees)
                    got = list(forest.nearest(ids[i:i + batch], vectors[i:i + batch], k, least))
                    columns = list(zip(*got)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(c, t)) for c, t in zip(columns, (np.int64, np.int64, np.float64))], shape.names)

    met = dealt.mapInArrow(run, shape)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), name))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", name, "score")


def _stretches(batch):
    """(first, past the last, block, asks) of the rows of a batch that share block and kind."""
    number = batch.column("block").to_numpy(zero_copy_only=False)
    asks = batch.column("asks").to_numpy(zero_copy_only=False)
    cut = np.flatnonzero((number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
    ends = [0, *cut.tolist(), len(number)]
    return [(a, b, number[a], asks[a]) for a, b in zip(ends, ends[1:]) if b > a]


def op12_neighbours(spark, sf_dir):
    """The five nearest vectors found for every fiftieth vector, among all others."""
    return search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), lambda i: i % 50 == 0)
