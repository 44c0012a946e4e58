"""Benchmark decontamination by pigeonhole edit matching.

An item may occur in a text with up to a tenth of its length in edits. With k edits
allowed an item is cut into k + 1 pieces, of which one must occur unchanged; an
Aho-Corasick automaton finds all pieces of a block of items in one pass over a text.
A hit is verified from the piece upwards, over ever longer runs of neighbouring pieces
(a run of r pieces may hold r - 1 edits), and at last over the whole item, by Myers'
bit-parallel edit distance. Nothing is missed: an occurrence within k edits has a piece
whose runs all keep to their share.

Texts and items are compared in lower case with single blanks for white space. The items
are the query set; they are taken in blocks of bounded size, each against all rows, so
no product of rows is ever formed. Null or empty texts and items match nothing. Equal
items are matched once for each id. Repeated rows give repeated results.
"""

import math

import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import functions as F

from maskwright.llm.common import map_texts, steps, table

#: Edits allowed, as a share of an item's length.
BUDGET = 0.1
#: Characters of item text that one task holds at once.
BLOCK_CHARS = 1 << 20


def plain(text):
    return " ".join(text.lower().split()) if text else ""


def bits_of(pattern):
    """For each character, the places of the pattern that hold it."""
    out = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def least_distance(bits, size, text):
    """The least edit distance of a pattern to any substring of `text`, and where the first
    such substring ends."""
    full, high = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best, end = size, 0
    get = bits.get
    for at, c in enumerate(text, 1):
        same = get(c, 0)
        rows = same | down
        cols = (((same & up) + up) ^ up) | same
        plus = down | (full & ~(cols | up))
        minus = up & cols
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
            if score < best:
                best, end = score, at
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | (full & ~(rows | plus))
        down = plus & rows
    return best, end


class Item:
    """One item: its pieces, and the runs above each piece with their share of edits."""

    def __init__(self, key, text, budget):
        self.key, self.text = key, text
        self.edits = min(int(len(text) * budget), len(text) - 1)
        n = self.edits + 1
        self.cuts = [len(text) * i // n for i in range(n + 1)]
        self.bits = {}
        self.paths = [[] for _ in range(n)]
        self._runs(0, n)

    def _runs(self, first, last):
        for piece in range(first, last):
            self.paths[piece].append((self.cuts[first], self.cuts[last], last - first - 1))
        if last - first > 1:
            middle = (first + last) // 2
            self._runs(first, middle)
            self._runs(middle, last)

    def pieces(self):
        return [(self.text[a:b], a) for a, b in zip(self.cuts, self.cuts[1:])]

    def distance(self, text, piece, at):
        """The item's distance around a hit of a piece at `at`, or None if it is over budget.

        The last window is wide enough to stand for all hits that lie up to `edits` aside."""
        origin = at - self.cuts[piece]
        best = None
        for begin, stop, share in reversed(self.paths[piece][:-1]):
            slack = share if stop - begin < len(self.text) else 2 * self.edits
            window = text[max(0, origin + begin - slack): origin + stop + slack]
            if (begin, stop) not in self.bits:
                self.bits[begin, stop] = bits_of(self.text[begin:stop])
            best, _ = least_distance(self.bits[begin, stop], stop - begin, window)
            if best > share:
                return None
        return best if best is not None else 0


class Matcher:
    """The items of one block and their automaton; built once per task."""

    def __init__(self, items, budget=BUDGET):
        import ahocorasick

        self.items = [Item(k, plain(t), budget) for k, t in items if plain(t)]
        places = {}
        for i, item in enumerate(self.items):
            for p, (piece, _) in enumerate(item.pieces()):
                places.setdefault(piece, []).append((i, p))
        self.automaton = ahocorasick.Automaton()
        for piece, refs in places.items():
            self.automaton.add_word(piece, (len(piece), refs))
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def find(self, text, first=False):
        """{item key: least distance} of the items that a text holds; the first one only, if asked."""
        found = {}
        text = plain(text)
        if not text or not self.any:
            return found
        tried = {}
        for end, (size, refs) in self.automaton.iter(text):
            at = end + 1 - size
            for i, piece in refs:
                item = self.items[i]
                origin = at - item.cuts[piece]
                last = tried.get(i)
                if last is not None and abs(origin - last) <= item.edits:
                    continue
                got = item.distance(text, piece, at)
                if got is not None:
                    tried[i] = origin
                    if first:
                        return {item.key: got}
                    found[item.key] = min(got, found.get(item.key, got))
        return found


def blocks(items, key="item_id", text="text", limit=BLOCK_CHARS):
    """The items as lists of (key, text), each of about `limit` characters."""
    items = items.select(key, text).where(F.length(text) > 0).distinct()
    total = items.agg(F.sum(F.length(text))).first()[0] or 0
    count = max(1, math.ceil(total / limit))
    for b in range(count):
        part = items.where(F.pmod(F.xxhash64(F.col(text), F.col(key).cast("string")), F.lit(count)) == b)
        yield sorted([(r[0], r[1]) for r in part.collect()], key=lambda r: (str(r[0]), r[1]))


def matches(docs, items, key="doc_id", text="text", item_key="item_id", item_text="text", budget=BUDGET):
    """(key, item, distance): every item that a document holds within its budget of edits,
    with the least distance of its occurrences."""
    kinds = {f.name: f.dataType for f in docs.schema.fields} | {}
    item_kind = items.schema[item_key].dataType
    out = T.StructType([T.StructField(key, kinds[key]), T.StructField(item_key, item_kind), T.StructField("distance", T.IntegerType())])
    rows = docs.select(key, text)

    def against(block):
        def run(batches):
            matcher = Matcher(block, budget)
            for batch in batches:
                for part in steps(batch, text):
                    at, hit, distance = [], [], []
                    for i, value in enumerate(part.column(text).to_pylist()):
                        for item, d in matcher.find(value).items():
                            at.append(i)
                            hit.append(item)
                            distance.append(d)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(key).take(pa.array(at, pa.int64())), pa.array(hit, _arrow(item_kind)), pa.array(distance, pa.int32())],
                        [key, item_key, "distance"])

        return rows.mapInArrow(run, out)

    found = None
    for block in blocks(items, item_key, item_text):
        found = against(block) if found is None else found.union(against(block))
    return found


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def clean(docs, items, text="text", item_key="item_id", item_text="text", budget=BUDGET):
    """The rows of `docs` that hold no item."""
    for block in blocks(items, item_key, item_text):
        def make(block=block):
            matcher = Matcher(block, budget)
            return lambda texts: [[not matcher.find(t, first=True) for t in texts.to_pylist()]]

        docs = map_texts(docs, text, [("kept", T.BooleanType())], make, keep="kept")
    return docs


def op7_decontamination(spark, sf_dir):
    """Every benchmark item that a document holds, with its edit distance."""
    return matches(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
