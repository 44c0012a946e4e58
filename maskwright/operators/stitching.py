"""Long texts in pieces, and whole values from what is found in pieces.

A text is cut at white space into pieces that overlap. Where values may be longer than
the overlap, the place around each cut is a piece of its own (a seam). What is found in a
piece gets its place in the text. A hit whose word reaches a cut may be part of a value: it
does not count, and a piece that holds it inside decides. Where there is none yet, one
twice as wide around that cut is asked for, until no hit is left open. A hit that lies
inside another one of its kind, which its own piece could not see whole, is a part too.

So a value is found whole wherever it stands if it is at most as long as the reach, and a
longer one wherever a part of it is found as well.
"""

import bisect

import pyarrow as pa
from pyspark.sql import functions as F

from maskwright.schema import KINDS

PIECE = "struct<begin:int,end:int,size:int,text:string>"
HIT = "struct<kind:int,value:string,at:int,end:int,open:int,begin:int,until:int>"
_PIECE = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("size", pa.int32()), ("text", pa.string())])
_HIT = pa.struct([("kind", pa.int32()), ("value", pa.string()), ("at", pa.int32()), ("end", pa.int32()),
                  ("open", pa.int32()), ("begin", pa.int32()), ("until", pa.int32())])
#: Characters of pieces that go to the next step at a time.
STEP_CHARS = 1 << 20


def _back(text, at, least):
    """The last place in (least, at] that follows white space; `at` if there is none."""
    for i in range(at, least, -1):
        if text[i - 1].isspace():
            return i
    return at


def cuts(text, size, overlap, reach):
    """(begin, end) of the pieces of a text, seams included."""
    if not 0 <= overlap < size:
        raise ValueError("overlap has to be smaller than the chunk")
    begin, margin, out = 0, max(1, size // 4), []
    while True:
        end = min(begin + size, len(text))
        if end < len(text):
            end = _back(text, end, begin + max(size // 2, overlap + 1))
        out.append((begin, end))
        if end == len(text):
            return out
        begin = _back(text, end - overlap, max(begin, end - overlap - margin))
        if reach > overlap:
            out.append((max(0, end - reach - margin), min(len(text), begin + reach + margin)))


def pieces(texts, key, size, overlap, reach):
    """`texts(key, text)` -> `(key, begin, end, size, text)`, one row per piece."""
    return _pieces(texts.select(key, "text", F.lit(None).cast("array<struct<begin:int,end:int>>").alias("wanted")), key,
                   lambda text, wanted: cuts(text, size, overlap, reach))


def wider_pieces(texts, key, wanted):
    """The pieces of `wanted(key, begin, end)`, cut out of `texts(key, text)`."""
    lists = wanted.groupBy(key).agg(F.collect_set(F.struct("begin", "end")).alias("wanted"))
    return _pieces(texts.join(lists, key).select(key, "text", "wanted"), key,
                   lambda text, wanted: sorted((w["begin"], w["end"]) for w in wanted))


def _pieces(rows, key, places):
    def cut(batches):
        for batch in batches:
            keys = batch.column(0)
            held, owner, chars = [], [], 0
            for i, (text, wanted) in enumerate(zip(batch.column(1), batch.column(2))):
                text = text.as_py()
                for begin, end in places(text, wanted.as_py()):
                    held.append({"begin": begin, "end": end, "size": len(text), "text": text[begin:end]})
                    owner.append(i)
                    chars += end - begin
                    if chars >= STEP_CHARS:
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), pa.array(held, _PIECE)], [key, "piece"])
                        held, owner, chars = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), pa.array(held, _PIECE)], [key, "piece"])

    made = rows.mapInArrow(cut, f"`{key}` string, piece {PIECE}")
    return made.select(key, "piece.*")


def _places(text, value):
    at = text.find(value)
    while at >= 0:
        yield at, at + len(value)
        at = text.find(value, at + len(value))


def _open_sides(text, at, end, begin, until, size):
    """1 if the word of a hit reaches the cut before it, 2 for the cut behind it, 3 for both."""
    before, after = text[:at], text[end:]
    left = begin > 0 and len(before.split()) <= (0 if before[-1:].isspace() else 1)
    right = until < size and len(after.split()) <= (0 if after[:1].isspace() else 1)
    return left + 2 * right


def _alone(text, at, end):
    """Whether a place begins and ends no word in its middle."""
    return not (
        at > 0 and text[at - 1].isalnum() and text[at].isalnum()
        or end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


def placed_in(text, begin, size, lists):
    """The hits of one piece. A value counts where it stands neither inside another value of
    the answer nor inside a word, if there are such places. One that is not in the text
    stands at its start."""
    until = begin + len(text)
    found = {}
    for kind, values in enumerate(lists):
        for value in dict.fromkeys(values or ()):
            if value:
                found[kind, value] = list(_places(text, value))
    spans = sorted({p for own in found.values() for p in own}, key=lambda p: (p[0], -p[1]))
    inner, far = set(), -1
    for a, b in spans:
        if b <= far:
            inner.add((a, b))
        far = max(far, b)
    out = []
    for (kind, value), own in found.items():
        own = [p for p in own if p not in inner] or own
        for at, end in [p for p in own if _alone(text, *p)] or own:
            sides = _open_sides(text, at, end, begin, until, size)
            out.append((kind, value, begin + at, begin + end, sides, begin, until))
        if not own:
            out.append((kind, value, begin, begin, 0, begin, until))
    return out


def placed(answered, key):
    """`answered(key, begin, size, text, pii, …)` with `hits`, what its lists say and where."""
    names = [f[0] for f in _HIT_FIELDS]

    @F.arrow_udf(f"array<{HIT}>")
    def place(texts: pa.Array, begins: pa.Array, sizes: pa.Array, lists: pa.Array) -> pa.Array:
        rows = [
            [dict(zip(names, hit)) for hit in placed_in(t, b, n, v)]
            for t, b, n, v in zip(texts.to_pylist(), begins.to_pylist(), sizes.to_pylist(), lists.to_pylist())
        ]
        return pa.array(rows, pa.list_(_HIT))

    every = F.array(*[F.coalesce(F.col("pii")[kind], F.array().cast("array<string>")) for kind in KINDS])
    return answered.withColumn("hits", place("text", "begin", "size", every))


_HIT_FIELDS = [(field.name, field.type) for field in _HIT]


def open_places(hits, asked, key, size):
    """`(key, begin, end)` of the pieces to ask about next: around each cut that an open hit
    reaches, unless a piece of `asked(key, begin, end, size)` holds that hit inside.

    Hits meet pieces by stretches of `size` characters, so that a text with many of either
    costs no more than these lie near each other."""
    touched = hits.where("open > 0")
    inside = (
        touched.drop("size").withColumn("stretch", F.floor(F.col("at") / size))
        .join(
            asked.select(key, F.col("begin").alias("b"), F.col("end").alias("e"), "size")
            .withColumn("stretch", F.explode(F.sequence(F.floor(F.col("b") / size), F.floor(F.col("e") / size)))),
            [key, "stretch"],
        )
        # by the widths of the two a hit that was open once lies a word or more inside a wider piece
        .where(((F.col("b") == 0) | (F.col("b") + F.lit(size // 4) <= F.col("at")))
               & ((F.col("e") == F.col("size")) | (F.col("e") - F.lit(size // 4) >= F.col("end"))))
        .select(key, "at", "end").distinct()
    )
    left = touched.select(key, "at", "end", "open", "begin", "until", "size").distinct().join(inside, [key, "at", "end"], "left_anti")
    width = F.col("until") - F.col("begin")
    around = F.array_compact(F.array(
        F.when(F.col("open") % 2 == 1, F.col("begin")), F.when(F.col("open") >= 2, F.col("until"))))
    return (
        left.select(key, "size", width.alias("width"), F.explode(around).alias("cut"))
        .select(key, F.greatest(F.col("cut") - F.col("width"), F.lit(0)).alias("begin"),
                F.least(F.col("cut") + F.col("width"), F.col("size")).alias("end"))
        .distinct()
    )


def whole_values(hits):
    """Lists by kind of the values that are whole, by their first places. `hits` are those of a text."""
    sure, out = [h for h in hits if not h["open"]], []
    for kind in range(len(KINDS)):
        own = [h for h in sure if h["kind"] == kind]
        spans = sorted({(h["at"], h["end"]) for h in own})
        starts = [a for a, _ in spans]
        longest = max((b - a for a, b in spans), default=0)
        first = {}
        for h in own:
            # spans that hold this one begin at most the longest span before its end
            near = range(bisect.bisect_left(starts, h["end"] - longest), bisect.bisect_right(starts, h["at"]))
            part = any(
                spans[i][1] >= h["end"] and spans[i] != (h["at"], h["end"])
                and not (h["begin"] <= spans[i][0] and spans[i][1] <= h["until"]) for i in near)
            if not part:
                first[h["value"]] = min(h["at"], first.get(h["value"], h["at"]))
        out.append(sorted(first, key=lambda v: (first[v], v)))
    return out


def stitched(hits, key):
    """`(key, <kind>…)`: the whole values of each text, of all its pieces' hits."""

    @F.arrow_udf("array<array<string>>")
    def join(lists: pa.Array) -> pa.Array:
        return pa.array([whole_values(hits) for hits in lists.to_pylist()], pa.list_(pa.list_(pa.string())))

    lists = hits.groupBy(key).agg(F.collect_list(F.struct(*[n for n, _ in _HIT_FIELDS])).alias("hits"))
    joined = lists.select(key, join("hits").alias("lists"))
    return joined.select(key, *[F.col("lists")[i].alias(kind) for i, kind in enumerate(KINDS)])
