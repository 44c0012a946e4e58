"""Vector code compression by Lloyd's rounds over members that stay where they are.

A vector becomes integers and is cut into equal parts; each part position has a codebook of
entries, and a vector's code is the nearest entry of each of its parts. Members (parts of
all vectors) are dealt out by (position, entry, salt). In a round the tasks that own an
entry sum up its resident members, the sums give the new entries, and every member is
compared with these where it lives. Members whose entry stays are not moved; the others go
to their new owner in the next shuffle. A member keeps its salt for life, so where it goes
depends on itself alone, and a task that runs again sends the same members.

An entry, however many members it has, is spread over the salts. Equal members of a batch
are one, with a count, before anything is shuffled. The driver sees sums by entry, and the
codebooks; the members of a round are kept by the executors, on disk where memory ends, and
are written to the folder of `spark.checkpoint.dir` every few rounds.

Rows whose vector is null, or holds null or non-finite components, are left out, and so are
those of another length than most have (of several such lengths the longest) or of a length
that is no multiple of the parts. Components beyond 2**26 in either direction count as that,
so that all sums of squares are exact. A null key is never among the smallest. Of rows that
share a key the least vector stands for it in the first codebooks; all of them get codes.
With fewer keys than entries there are as many entries as keys. An empty table gives an
empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark import StorageLevel
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from maskwright.llm.common import table, without, work_folder, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest component either way.
BOUND = 1 << 26
#: Components that one step takes at a time, and those gathered before members are dealt out.
STEP, GATHER = 1 << 20, 1 << 22
#: Rounds between two written states.
CUT = 3
#: Sums by label are broadcast up to so many labels; beyond, they are joined by a shuffle.
BROADCAST_LABELS = 100_000


def usable(vector):
    """True for arrays without null, NaN or infinite components."""
    inf = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))


def common_length(df, vector):
    """The length that most vectors have, the longest of several; null if there is none."""
    row = df.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return row["size"] if row else None


def integers(vectors, scale):
    """Arrow lists of numbers of one length -> matrix of floor(scale * x)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(flat * scale), -BOUND, BOUND)
    return flat.astype(np.int64).reshape(len(vectors), -1)


def slices(batch, width):
    rows = max(1, STEP // width)
    for start in range(0, len(batch), rows):
        yield batch.slice(start, rows)


def nearest(members, book):
    """(index, squared distance) of the nearest entry of each member, the first of several."""
    most = max(int(np.abs(members).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * members.shape[1] * most * most < 1 << 53:
        # all sums are integers that doubles hold exactly
        m, b = members.astype(np.float64), book.astype(np.float64)
        off = (b * b).sum(axis=1) - 2 * (m @ b.T)
        best = off.argmin(axis=1)
        least = off[np.arange(len(m)), best] + (m * m).sum(axis=1)
        return best, least.astype(np.int64)
    best = np.zeros(len(members), np.int64)
    least = np.full(len(members), np.iinfo(np.int64).max)
    for e, entry in enumerate(book):
        off = ((members - entry) ** 2).sum(axis=1)
        closer = off < least
        best[closer], least[closer] = e, off[closer]
    return best, least


def packed(members, counts):
    """Members and how many of each, as bytes; 16 bits a component where these do."""
    small = len(members) == 0 or (members.min() >= -32768 and members.max() <= 32767)
    return members.astype("<i2" if small else "<i4").tobytes(), counts.astype("<i8").tobytes()


class Codebooks:
    """Entries of every part position, as an integer array (position, entry, component)."""

    def __init__(self, entries):
        self.entries = np.asarray(entries, np.int64)

    @property
    def width(self):
        return self.entries.shape[2]

    def digest(self):
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def moved(self, sums):
        """The entries after a round: floors of the means; entries without members stay."""
        made = self.entries.copy()
        for (position, entry), (n, total) in sums.items():
            made[position, entry] = [t // n for t in total]
        return Codebooks(made)


def first_books(kept, key, vector, dims, parts, entries, scale):
    """Codebooks of the smallest keys' vectors: the least few of each task, then of all."""
    batch_kind = to_arrow_type(kept.schema[key].dataType)
    shape = T.StructType([kept.schema[key], T.StructField("v", T.ArrayType(T.LongType()))])

    def least(batches):
        held = {}
        for batch in batches:
            for part in slices(batch, dims):
                ids, rows = part.column(0).to_pylist(), integers(part.column(1), scale)
                for i, k in enumerate(ids):
                    if k is not None and (len(held) < entries or k <= max(held)):
                        row = rows[i].tolist()
                        held[k] = min(row, held.get(k, row))
                        if len(held) > entries:
                            del held[max(held)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), batch_kind), pa.array(list(held.values()), pa.list_(pa.int64()))], [key, "v"])

    rows = kept.select(key, vector).mapInArrow(least, shape).groupBy(key).agg(
        F.min("v").alias("v")).orderBy(key).limit(entries).collect()
    if not rows:
        return None
    books = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), parts, dims // parts)
    return Codebooks(books.transpose(1, 0, 2))


def place(group):
    """Where the members of (position, entry, salt) live: any number, taken modulo the tasks."""
    position, entry, salt = group
    return ((position * 1_000_003 + entry) * 1_000_003 + salt) * 0x9E3779B1 % 0xFFFFFFFB >> 3


def dealt(position, salts, members, counts, entry):
    """((position, entry, salt), chunk) of members by where they go; equal ones are joined."""
    order = np.lexsort((*members.T, salts, entry))
    members, counts, salts, entry = members[order], counts[order], salts[order], entry[order]
    group = np.flatnonzero(np.concatenate([[True], (entry[1:] != entry[:-1]) | (salts[1:] != salts[:-1])]))
    new = np.concatenate([[True], (members[1:] != members[:-1]).any(axis=1)])
    new[group] = True
    at = np.flatnonzero(new)
    counts = np.add.reduceat(counts, at)
    members, salts, entry = members[at], salts[at], entry[at]
    begin = np.searchsorted(at, group)
    for a, b in zip(begin, np.append(begin[1:], len(at))):
        yield (position, int(entry[a]), int(salts[a])), packed(members[a:b], counts[a:b])


def read_chunk(chunk, width):
    members, counts = chunk
    counts = np.frombuffer(counts, "<i8")
    kind = "<i2" if len(members) == 2 * width * len(counts) else "<i4"
    return np.frombuffer(members, kind).astype(np.int64).reshape(len(counts), width), counts


def members_of(kept, key, vector, books, parts, scale, salts):
    """Chunks of members by (position, entry, salt), entries by the first codebooks."""
    shape = T.StructType([T.StructField(n, T.IntegerType()) for n in ("position", "entry", "salt")] + [
        T.StructField(n, T.BinaryType()) for n in ("members", "counts")])
    salt = F.pmod(F.xxhash64(F.col(key).cast("string"), vector), F.lit(salts)).cast("int")
    dims = parts * books.width

    def chunks(held):
        rows, own = (np.concatenate(x) for x in zip(*held))
        one = np.ones(len(rows), np.int64)
        for position in range(parts):
            members = rows[:, position * books.width:(position + 1) * books.width].astype(np.int64)
            entry, _ = nearest(members, books.entries[position])
            out = [(*k, *chunk) for k, chunk in dealt(position, own, members, one, entry)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], pa.int32() if i < 3 else pa.binary()) for i in range(5)], shape.names)

    def deal(batches):
        held = []
        for batch in batches:
            for part in slices(batch, dims):
                held.append((integers(part.column("v"), scale).astype(np.int32), part.column("salt").to_numpy(zero_copy_only=False)))
                if sum(len(rows) for rows, _ in held) * dims >= GATHER:
                    yield from chunks(held)
                    held = []
        if held:
            yield from chunks(held)

    return kept.select(F.col(vector).alias("v"), salt.alias("salt")).mapInArrow(deal, shape).rdd.map(
        lambda r: ((r[0], r[1], r[2]), (bytes(r[3]), bytes(r[4]))))


def sums_of(residents, width):
    """{(position, entry): (members, sum by component)}: the owners' sums, joined over salts."""
    def own(chunks):
        held = {}
        for (position, entry, _), chunk in chunks:
            members, counts = read_chunk(chunk, width)
            n, total = held.get((position, entry), (0, [0] * width))
            held[position, entry] = n + int(counts.sum()), [a + b for a, b in zip(total, (members * counts[:, None]).sum(axis=0).tolist())]
        return held.items()

    return residents.mapPartitions(own).reduceByKey(
        lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1])])).collectAsMap()


def settled(residents, books):
    """(stay, move): chunks of members whose nearest entry is still their owner's, and of
    those that have to go to another."""
    def split(staying):
        def run(chunks):
            for (position, entry, salt), chunk in chunks:
                members, counts = read_chunk(chunk, books.width)
                now, _ = nearest(members, books.entries[position])
                pick = (now == entry) if staying else (now != entry)
                if pick.all() and staying:
                    yield (position, entry, salt), chunk
                elif pick.any():
                    own = np.full(int(pick.sum()), salt, np.int64)
                    yield from dealt(position, own, members[pick], counts[pick], now[pick])
        return run

    return residents.mapPartitions(split(True), preservesPartitioning=True), residents.mapPartitions(split(False))


def codebooks(df, key="vec_id", vector="embedding", parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE):
    """Codebooks after so many rounds over all usable vectors; None without any."""
    kept = df.where(usable(F.col(vector)) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    dims = common_length(kept, vector)
    kept = kept.where(F.size(vector) == F.lit(dims))
    books = first_books(kept, key, vector, dims, parts, entries, scale) if dims else None
    if books is None:
        return None
    spark = df.sparkSession
    work_folder(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # so many that each group of an entry with all members of its position is one task's share
    salts = max(1, -(-tasks // parts))
    residents = members_of(kept, key, vector, books, parts, scale, salts).partitionBy(tasks, place)
    held = []
    for turn in range(rounds):
        residents.persist(StorageLevel.MEMORY_AND_DISK)
        if turn % CUT == CUT - 1:
            residents.checkpoint()
        held.append(residents)
        books = books.moved(sums_of(residents, books.width))
        stay, move = settled(residents, books)
        residents = stay.union(move.partitionBy(tasks, place))  # the same partitions, so those who stay do so
        if len(held) > 2:
            held.pop(0).unpersist()
    for rest in held:
        rest.unpersist()
    return books


def encode(df, books, vector="embedding", parts=PARTS, scale=SCALE):
    """The rows of `df` that have usable vectors, with `code` (two hex digits a part) and `error`
    (squared distances to the entries, summed over parts) in place of the vector."""
    fields = [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    base = without(df, "code", "error")
    rest = [c for c in base.columns if c != vector]
    shape = T.StructType([base.schema[c] for c in rest] + fields)
    if books is None:
        return df.sparkSession.createDataFrame([], shape)
    kept = base.where(usable(F.col(vector)) & (F.size(vector) == parts * books.width))

    def run(batches):
        for batch in batches:
            for part in slices(batch, parts * books.width):
                rows = integers(part.column(vector), scale)
                code, error = np.zeros((len(rows), parts), np.int64), np.zeros(len(rows), np.int64)
                for p in range(parts):
                    code[:, p], off = nearest(rows[:, p * books.width:(p + 1) * books.width], books.entries[p])
                    error += off
                digits = np.array([f"{i:02x}" for i in range(books.entries.shape[1])], object)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in rest] + [pa.array(["".join(r) for r in digits[code]]), pa.array(error)], shape.names)

    return kept.mapInArrow(run, shape)


def with_sums(coded, label="label", value="error", name="label_error"):
    """`coded` with `value` summed over the rows of equal labels, nulls together; null where the
    sum needs more than 64 bits."""
    sums = coded.groupBy(F.col(label).alias("_label")).agg(F.try_sum(value).alias(name))
    sums = written(sums)
    few = sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    sums = F.broadcast(sums) if few else sums.hint("merge")
    return coded.join(sums, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")


def op11_vector_codes(spark, sf_dir):
    """Codes and errors of all usable vectors, by codebooks learnt from all of them."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    books = codebooks(rows)
    coded = with_sums(encode(rows, books))
    digest = F.lit(books.digest() if books else None).cast("string")
    return coded.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
