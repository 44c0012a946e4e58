"""Detection by dictionary: which entries of `(kind, value)` occur in which text.

A value counts when the text contains it literally. Texts are searched where they are
scanned, a batch at a time (`gram_scan`): a table of bits says which grams of a text are
worth a look, so the cost hardly depends on the number of values. A dictionary up to
`VALUES_BYTES`, measured, goes to the tasks as a whole, which find its values without any
shuffle; so this works on streams too. Of a larger one only the table of bits does: grams
that pass it meet the values filed under them in an equi join, and the candidates are
checked against the whole text. Candidates belong to a text, not to an id, so equal texts
share theirs. The rows are the same either way, also where ids are null or repeated.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from maskwright.functions.entities import empty_list, pii_struct
from maskwright.operators import gram_scan
from maskwright.operators.joins import salted_join, skew_join
from maskwright.schema import KINDS
from maskwright.session import durable

#: Bytes of values, and for the rest of each, that go to the tasks as a whole.
VALUES_BYTES, VALUE_BYTES = 16 * 1024 * 1024, 96
#: Bound on what is broadcast in a join: the values' bytes, and ANCHOR_BYTES for the rest of each row.
BROADCAST_BYTES, ANCHOR_BYTES = 64 * 1024 * 1024, 64
#: Places in the table of bits of a large dictionary, as a power of 2, and in one of its blocks.
FILTER_BITS, BLOCK_BITS = 26, 16
#: Bytes of text that are searched at a time.
STEP_BYTES = 1 << 21

_GRAMS = "array<struct<size:int,gram:long>>"
_GRAM = pa.struct([("size", pa.int32()), ("gram", pa.int64())])


def _entries(dictionary):
    known = F.col("kind").isin(KINDS) & (F.length("value") > 0)
    return dictionary.select("kind", "value").filter(known).distinct()


def detect_gazetteer(docs, dictionary, id_col="doc_id", text_col="text", values_bytes=VALUES_BYTES):
    """Add `pii` with the dictionary values each text contains, by first occurrence, then value.

    `id_col` only spreads rows; it may be null or repeated. A dictionary of more than
    `values_bytes` is looked up by joins instead of in the scan.
    """
    entries = _entries(dictionary)
    size = entries.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("b")
    ).first()
    if size["n"] == 0:
        return docs.withColumn("pii", pii_struct())
    if size["b"] + size["n"] * VALUE_BYTES <= values_bytes:
        return _in_scan(docs, entries, text_col)
    small = size["b"] + size["n"] * ANCHOR_BYTES <= BROADCAST_BYTES
    return _by_join(docs, entries, id_col, text_col, small)


def _steps(texts):
    """Bytes of the texts of a batch (null: empty), in steps of about STEP_BYTES."""
    held, size = [], 0
    for text in pc.fill_null(texts.cast(pa.binary()), b"").to_pylist():
        if held and size + len(text) > STEP_BYTES:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _in_scan(docs, entries, text_col):
    # at most `values_bytes`, measured just before
    rows = entries.collect()
    values = sorted({row["value"].encode() for row in rows})
    place = {value: i for i, value in enumerate(values)}
    kinds = [[] for _ in values]
    for row in rows:
        kinds[place[row["value"].encode()]].append(KINDS.index(row["kind"]))
    sent = docs.sparkSession.sparkContext.broadcast((gram_scan.Values(values), kinds))

    @F.arrow_udf("array<array<string>>")
    def search(texts: pa.Array) -> pa.Array:
        known, of = sent.value
        names = [value.decode() for value in known.values]
        out = []
        for step in _steps(texts):
            lists = [[[] for _ in KINDS] for _ in step]
            for text, value, _ in known.find(step).tolist():
                for kind in of[value]:
                    lists[text][kind].append(names[value])
            out += lists
        return pa.array(out, pa.list_(pa.list_(pa.string())))

    found = docs.withColumn("_found", search(text_col))
    lists = {kind: F.col("_found")[i] for i, kind in enumerate(KINDS)}
    return found.withColumn("pii", pii_struct(**lists)).drop("_found")


def _spelled(entries):
    """`(kind, value, size, gram)`: each value with every gram it may be filed under."""
    def spell(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                values = [v.encode() for v in part.column(1).to_pylist()]
                for value, size, number, _ in gram_scan.grams_of_values(values):
                    rows = part.take(pa.array(value))
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(np.full(len(value), size, np.int32)), pa.array(number.view(np.int64))],
                        ["kind", "value", "size", "gram"])

    return entries.mapInArrow(spell, "kind string, value string, size int, gram long").distinct()


def anchors(entries):
    """`(size, gram, kind, value)`: each value with the gram of its own that fewest values share."""
    spelled = _spelled(entries)
    shared = spelled.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("shared"))
    counted = skew_join(spelled, shared, ["size", "gram"], ["kind", "value"], "inner", shared.withColumnRenamed("shared", "n"))
    return counted.groupBy("size", "kind", "value").agg(
        F.min(F.struct("shared", "gram"))["gram"].alias("gram")
    )


def _filter(filed):
    """The table of bits of all anchors. Tasks give the places, blocks of which are packed where
    they meet; the driver gets `2 ** FILTER_BITS` bits for each size of gram at most."""
    @F.arrow_udf("long")
    def slot(sizes: pa.Array, numbers: pa.Array) -> pa.Array:
        sizes, numbers = sizes.to_numpy(zero_copy_only=False), numbers.to_numpy(zero_copy_only=False).view(np.uint64)
        out = np.zeros(len(sizes), np.int64)
        for size in gram_scan.SIZES:
            out[sizes == size] = gram_scan.slots(numbers[sizes == size], size, FILTER_BITS)
        return pa.array(out)

    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        out = []
        for places in lists:
            bits = np.zeros(1 << BLOCK_BITS, bool)
            bits[places.values.to_numpy(zero_copy_only=False)] = True
            out.append(np.packbits(bits, bitorder="little").tobytes())
        return pa.array(out, pa.binary())

    places = filed.select("size", "gram").distinct().select("size", slot("size", "gram").alias("at")).distinct()
    blocks = places.groupBy("size", F.shiftright("at", BLOCK_BITS).alias("block")).agg(
        F.collect_list(F.col("at").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")).alias("places"))
    tables, width = {}, 1 << BLOCK_BITS - 3
    for row in blocks.select("size", "block", pack("places").alias("bits")).collect():
        table = tables.setdefault(row["size"], np.zeros(1 << FILTER_BITS - 3, np.uint8))
        table[row["block"] * width:(row["block"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return gram_scan.Filter(FILTER_BITS, tables)


def _by_join(docs, entries, id_col, text_col, small):
    filed = durable(docs.sparkSession, anchors(entries), "anchors")
    sent = docs.sparkSession.sparkContext.broadcast(_filter(filed))
    text = F.col(text_col)

    @F.arrow_udf(_GRAMS)
    def passing(texts: pa.Array) -> pa.Array:
        known, out = sent.value, []
        for step in _steps(texts):
            data, begin = gram_scan.joined(step)
            lists = [[] for _ in step]
            for size, place, number in known.passing(data) if len(data) else ():
                own = np.searchsorted(begin, place, "right") - 1
                inside = place + size <= begin[own + 1]
                pairs = np.unique(np.stack([own[inside], number[inside].view(np.int64)], axis=1), axis=0)
                for i, gram in pairs.tolist():
                    lists[i].append({"size": size, "gram": gram})
            out += lists
        return pa.array(out, pa.list_(_GRAM))

    # Rows without a text have no candidates; their keys differ, so they stay apart.
    keyed = docs.withColumn("_key", F.coalesce(
        F.sha2(text, 256), F.concat(F.lit("-"), F.xxhash64(id_col).cast("string"))))
    # Outer, or the optimizer would search every text twice to filter by list size.
    spelled = keyed.select("_key", F.explode_outer(passing(text)).alias("g")).select(
        "_key", F.col("g.size").alias("size"), F.col("g.gram").alias("gram")
    ).filter("gram is not null")
    if small:
        pairs = spelled.join(F.broadcast(filed), ["size", "gram"])
    else:
        pairs = salted_join(spelled, filed, ["size", "gram"], ["_key"], "inner")
    candidates = pairs.groupBy("_key").agg(
        F.collect_set(F.struct("kind", "value")).alias("_candidates")
    )
    # Written first: with its true size known, few candidates are broadcast and the
    # documents stay where they are.
    joined = keyed.join(durable(docs.sparkSession, candidates, "candidates"), "_key", "left")
    found = F.filter(F.col("_candidates"), lambda c: F.contains(text, c["value"]))

    def of_kind(kind):
        placed = F.transform(
            F.filter(F.col("_found"), lambda c: c["kind"] == kind),
            lambda c: F.struct(F.position(c["value"], text).alias("at"), c["value"].alias("value")))
        return F.coalesce(F.transform(F.array_sort(placed), lambda hit: hit["value"]), empty_list())

    return (
        joined.withColumn("_found", found)
        .withColumn("pii", pii_struct(**{kind: of_kind(kind) for kind in KINDS}))
        .drop("_key", "_candidates", "_found")
    )
