"""Literal search for many values at once: grams against a filter, then exact checks.

A value is filed under one of its own grams, a run of 8, 4, 2 or 1 bytes of its UTF-8 form, the
longest that fits; of these the one that fewest values share. All grams of a text are numbers
that a few shifts give, and a table of bits says which of them can be a value's. Only what
passes is looked up, and the text around it compared with the value.
"""

import numpy as np

#: Bytes of grams, longest first.
SIZES = (8, 4, 2, 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Base of the sums that compare stretches of text with values before their bytes are.
_BASE = np.uint64(0x100000001B3)


def size_of(length):
    return next(s for s in SIZES if s <= length)


def grams(data, size):
    """The numbers of all runs of `size` bytes."""
    run, width = data.astype(np.uint64), 1
    while width < size and len(run) > width:
        run = run[:-width] | (run[width:] << np.uint64(8 * width))
        width *= 2
    return run if width == size else run[:0]


def slots(numbers, size, bits):
    """The place of each gram in a table of 2 ** bits."""
    return ((numbers + np.uint64(size)) * _SPREAD >> np.uint64(64 - bits)).astype(np.int64)


def joined(texts):
    """(bytes of all texts, where each begins, and the end)."""
    size = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(size)])


def grams_of_values(values):
    """(value, size, gram, place in the value) of all grams that values may be filed under."""
    data, begin = joined(values)
    length = np.diff(begin)
    kind = np.array([size_of(n) for n in length], np.int64)
    for size in SIZES:
        mine = np.flatnonzero(kind == size)
        if len(mine):
            count = length[mine] - size + 1
            value = np.repeat(mine, count)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            yield value, size, grams(data, size)[begin[value] + place], place


class Filter:
    """A table of bits for each size of grams: which grams are worth a look."""

    def __init__(self, bits, tables):
        self.bits, self.tables = bits, tables

    def passing(self, data):
        """(size, places, grams) of what may be a value's."""
        for size, table in self.tables.items():
            numbers = grams(data, size)
            at = slots(numbers, size, self.bits)
            place = np.flatnonzero(table[at >> 3] >> (at & 7) & 1)
            yield size, place, numbers[place]


def filter_of(found, bits):
    """A filter of (size, grams) pairs."""
    tables = {}
    for size, numbers in found:
        at = slots(numbers, size, bits)
        whole = tables.setdefault(size, np.zeros(1 << bits, bool))
        whole[at] = True
    return Filter(bits, {size: np.packbits(whole, bitorder="little") for size, whole in tables.items()})


class Values:
    """Values to look for, filed under their grams; `find` says where each first stands."""

    def __init__(self, values):
        self.values = list(values)
        self.length = np.array([len(v) for v in self.values], np.int64)
        self.filed, kept = {}, []
        for value, size, number, place in grams_of_values(self.values) if self.values else ():
            _, of, shared = np.unique(number, return_inverse=True, return_counts=True)
            order = np.lexsort((place, number, shared[of], value))
            first = order[np.flatnonzero(np.concatenate([[True], value[order][1:] != value[order][:-1]]))]
            by_gram = first[np.argsort(number[first], kind="stable")]
            self.filed[size] = number[by_gram], value[by_gram], place[by_gram]
            kept.append((size, number[first]))
        bits = max(16, int(32 * max(1, len(self.values))).bit_length())
        self.filter = filter_of(kept, min(bits, 29))
        self.sums = np.array([self._sum(np.frombuffer(v, np.uint8)) for v in self.values], np.uint64)

    @staticmethod
    def _sum(data):
        return (data * _powers(len(data))).sum(dtype=np.uint64)

    def find(self, texts):
        """(text, value, place) of the first place of every value in every text, in order of texts
        and places."""
        data, begin = joined(texts)
        if not len(data) or not self.values:
            return np.zeros((0, 3), np.int64)
        power = _powers(len(data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * power[:-1], dtype=np.uint64)])
        out = []
        for size, place, number in self.filter.passing(data):
            filed, value, offset = self.filed[size]
            low, high = np.searchsorted(filed, number), np.searchsorted(filed, number, "right")
            count = high - low
            each = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            value, start = value[each], np.repeat(place, count) - offset[each]
            end = start + self.length[value]
            own = np.searchsorted(begin, np.repeat(place, count), "right") - 1
            fits = (start >= begin[own]) & (end <= begin[own + 1])
            own, value, start, end = own[fits], value[fits], start[fits], end[fits]
            same = total[end] - total[start] == self.sums[value] * power[start]
            out.append(np.stack([own[same], value[same], start[same] - begin[own[same]]], axis=1))
        found = np.concatenate(out)
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        new = np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])[:len(found)]
        sure = [[t, v, p if texts[t].startswith(self.values[v], p) else texts[t].find(self.values[v])] for t, v, p in found[new].tolist()]
        sure = np.array([r for r in sure if r[2] >= 0], np.int64).reshape(-1, 3)
        return sure[np.lexsort((sure[:, 1], sure[:, 2], sure[:, 0]))]


def _powers(n):
    power = np.full(n, _BASE)
    power[:1] = 1
    return np.cumprod(power, dtype=np.uint64)
