"""Periodic runs of words by seeds that are extended along diagonals.

A run is a stretch of words with smallest period q that no neighbouring word extends and
that is at least `max(LEAST_LENGTH, REPEATS * q)` words long. Its words equal those q
further on over at least `max(LEAST_LENGTH - q, (REPEATS - 1) * q)` places: the overlap
that each period guarantees. Lags are dealt with in classes, 1 to 15, 16 to 31, 32 to 63
and so on, and a class has seeds as long as all its lags guarantee: 16, 32, 64 … words.

A seed is as long as its lags at least, so within a run two neighbouring occurrences of it
are one period apart: of all pairs of occurrences in a text only neighbouring ones need a
look, and a seed that occurs n times makes n - 1 pairs. A run holds such a pair at every
place, so pairs of a lag that follow each other in too small a number are passed over.
The others are extended along their diagonal word by word, and a table of the furthest
place that each lag has been followed to passes over seeds that lie inside. Longer seeds
are made of two that occur twice themselves, so most texts are done after the first class.

A text is one row, and a step takes several texts or one long one. A null or empty text has
no words and no runs. Equal texts have equal runs. Other columns stay; those with names of
results give way.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.types as T
from pyspark.sql import functions as F

from maskwright.llm.common import STEP_BYTES, steps, table, without

LEAST_LENGTH, REPEATS = 24, 3
#: Words of the shortest seeds; lags below it make the first class.
SEED = 16
#: Words of a text, as a pattern for Spark.
WORDS = r"[^\x20\x09-\x0D]+"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
RUNS = T.ArrayType(RUN, False)


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _joined(left, right):
    """Names of grams made of two halves."""
    return _mixed(left * _STEP + right + np.uint64(1))


def pairs(ids, text):
    """(least lag, places, lags) by class of lags: neighbouring occurrences of one seed in one
    text whose distance lies in the class. `ids` numbers words, `text` the text of each, rising."""
    names, width = _mixed(ids.astype(np.uint64) + _STEP), 1
    while width < SEED:
        if len(names) <= width:
            return
        names, width = _joined(names[:-width], names[width:]), 2 * width
    at = np.flatnonzero(text[:len(names)] == text[width - 1:]) if width > 1 else np.arange(len(names))
    # a text's number in the name keeps seeds of different texts apart
    names = _joined(names[at], text[at].astype(np.uint64))
    least = 1
    while len(at):
        order = np.argsort(names, kind="stable")
        same = np.flatnonzero(names[order[1:]] == names[order[:-1]])
        first, second = order[same], order[same + 1]
        lag = at[second] - at[first]
        mine = (lag >= least) & (lag < width)
        yield least, at[first[mine]], lag[mine]
        # a seed twice as long occurs twice only where both its halves do
        twice = np.zeros(len(at), bool)
        twice[first] = twice[second] = True
        at, names = at[twice], names[twice]
        half = np.searchsorted(at, at + width)
        half[half == len(at)] = 0
        whole = (at[half] == at + width) & (text[at[half]] == text[at]) if len(at) else np.zeros(0, bool)
        at, names = at[whole], _joined(names[whole], names[half[whole]])
        least, width = width, 2 * width


def extended(ids, at, lag, low, high):
    """The widest stretch of `low` to `high` around place `at` where words equal those `lag` on."""
    def reach(begin, end, backward):
        # places from `begin` up to `end` that agree, in windows that grow
        seen, window = 0, 64
        while seen < end - begin:
            size = min(window, end - begin - seen)
            a = end - seen - size if backward else begin + seen
            differ = np.flatnonzero(ids[a:a + size] != ids[a + lag:a + lag + size])
            if len(differ):
                return seen + (size - 1 - differ[-1] if backward else differ[0])
            seen, window = seen + size, 2 * window
        return seen

    left = at - reach(low, at, True)
    right = at + reach(at, high - lag, False)
    return left, right + lag


def runs(ids, starts):
    """[(text, start, length, period)] of all runs, sorted. `starts` holds the first word of
    each text; the words of all are numbered in `ids`."""
    ends = np.append(starts[1:], len(ids))
    text = np.repeat(np.arange(len(starts)), ends - starts)
    found = {}
    for _, places, lags in pairs(ids, text):
        order = np.lexsort((places, lags))
        places, lags = places[order], lags[order]
        if not len(places):
            continue
        # seeds of a run follow each other: pass over those with too few of their lag in a row
        head = np.flatnonzero(np.concatenate(
            [[True], (lags[1:] != lags[:-1]) | (places[1:] != places[:-1] + 1) | (text[places[1:]] != text[places[:-1]])]))
        count = np.diff(np.append(head, len(places)))
        lag = lags[head]
        width = max(SEED, 1 << int(lag.max()).bit_length())
        enough = count + width - 1 >= np.maximum(LEAST_LENGTH - lag, (REPEATS - 1) * lag)
        furthest = {}
        for at, q in zip(places[head[enough]].tolist(), lag[enough].tolist()):
            if at < furthest.get(q, -1):
                continue
            t = int(text[at])
            start, end = extended(ids, at, q, int(starts[t]), int(ends[t]))
            furthest[q] = end - q
            if end - start >= max(LEAST_LENGTH, REPEATS * q):
                key = (t, start, end)
                found[key] = min(q, found.get(key, q))
    return sorted((t, start - int(starts[t]), end - start, q) for (t, start, end), q in found.items())


def numbered(words):
    """A number for each word, equal for equal words."""
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


def analysed(texts):
    """For byte strings: the runs of each as (start, length, period), the one with the greatest
    share of periods, and the text without repetitions, words joined by blanks."""
    words = [t.split() for t in texts]  # bytes are split at white space of ASCII only
    size = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(size) - size
    full = np.flatnonzero(size)
    lists = [[] for _ in words]
    if len(full):
        every = numbered([w for own in words for w in own])
        for t, start, length, period in runs(every, starts[full]):
            lists[full[t]].append((start, length, period))
    best, kept = [], []
    for own, found in zip(words, lists):
        top = None
        drop = np.zeros(len(own) + 1, np.int64) if found else None
        for start, length, period in found:  # by start, then period: the first of equals stays
            if top is None or length * top[2] > top[1] * period:
                top = (start, length, period)
            drop[start + period] += 1
            drop[start + length] -= 1
        if found:
            own = [own[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
        best.append(top)
        kept.append(b" ".join(own))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in lists], best, kept


def periodic_runs(df, text="text"):
    """`df` with `runs`, an array of all (start, length, period) by start and period; `best`,
    the run with most periods (the first of several, null if none); and `collapsed`, the words
    that remain if each run keeps its first period alone, joined by blanks.

    The text column goes; `text="collapsed"` is not possible.
    """
    fields = [T.StructField("runs", RUNS), T.StructField("best", RUN), T.StructField("collapsed", T.StringType())]
    base = without(df, *[f.name for f in fields])
    shape = T.StructType([f for f in base.schema.fields if f.name != text] + fields)
    run_kind = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def structs(found):
        return [None if r is None else dict(zip(("start", "length", "period"), r)) for r in found]

    def work(batches):
        as_text = pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True)
        for batch in batches:
            for part in steps(batch, text, STEP_BYTES):
                raw = part.column(text).cast(pa.binary()).to_pylist()
                lists, best, kept = analysed([t or b"" for t in raw])
                rest = [(n, c) for n, c in zip(part.schema.names, part.columns) if n != text]
                yield pa.RecordBatch.from_arrays(
                    [c for _, c in rest] + [
                        pa.array([structs(f) for f in lists], pa.list_(run_kind)), pa.array(structs(best), run_kind),
                        pc.cast(pa.array(kept, pa.binary()), options=as_text)],
                    [n for n, _ in rest] + ["runs", "best", "collapsed"])

    return base.mapInArrow(work, shape)


def with_repeated_tail(df, key="doc_id", text="text"):
    """`df` whose texts repeat themselves wherever the CRC-32 h of the decimal key is a multiple
    of 10: from word a = g mod n on, g = h / 10, the words are the p from there over and over,
    p = 1 + (n - a) / (3 + g mod 8). Such texts become their words joined by blanks. Texts
    without words, and rows with a null key, stay."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p)))
        return F.when(n > 0, F.array_join(turned, " ")).otherwise(F.col(text))

    # one element, so that the words are found once
    found = F.transform(F.array(F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0))), tail)
    return df.withColumn(text, F.when((h % 10 == 0) & F.col(text).isNotNull(), F.get(found, F.lit(0))).otherwise(F.col(text)))


def op13_periodic_runs(spark, sf_dir):
    """Periodic runs of every document, a tenth of them with repeated tails."""
    docs = with_repeated_tail(table(spark, sf_dir, "documents", "doc_id", "text"))
    listed = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return periodic_runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
