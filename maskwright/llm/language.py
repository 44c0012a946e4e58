"""Language identification by nearest centroid over TF-IDF vectors of n-grams.

A text is folded to lower case, with one blank for each run of ASCII characters that are
no letters; runs of one to three of its bytes are counted in hashed places. Weights are logarithmic counts times the inverse document
frequency over all learning rows, scaled to length one. Each language has several
centroids, clustered on a bounded sample of its rows. A text gets the language of the
centroid with the highest cosine, its score, and is rejected where that cosine falls
below the least that its language's own rows of about as many different n-grams show:
short and repetitive texts have low cosines, and do not lower the bound of others. Own
rows are all learning rows of that language that are also found to be of it, but for odd
ones, whose cosine is below a fixed share of the median of such rows: a text of another
kind under a language's name is rejected itself, and neither lowers the bound nor gets a
centroid, unless many rows are like it. A text of a word or two is not rejected, as its
cosine says too little.

A text that is null or has no letter is `und`, with score 0, and rejected. Equal texts
get equal results; of centroids with equal cosine the first counts, languages in
alphabetical order. With no learning rows at all every text is `und`.
"""

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import functions as F

from maskwright.llm.common import crc_part, map_texts, steps, sampled, table

PLACES = 4096
CENTROIDS = 4
#: Rows of each language that the centroids are clustered on, at most.
SAMPLE = 600
#: Rejection bound: the least cosine of so many own rows at least that it is below this share of them.
REJECT_QUANTILE = 0.001
#: A row is odd if its cosine is below this share of the median of own rows of its class.
ODD_SHARE = 0.35
#: Cosines are counted in so many bins; a median needs so many rows.
BINS = 100
MEDIAN_ROWS = 20
#: Clusters with a smaller share of the clustered rows give no centroid.
LEAST_CLUSTER = 0.05
#: Classes of texts by number of different n-grams, two for each doubling.
CLASSES = 2 * 12 + 1
#: A text of a lower class, with fewer than 32 different n-grams, is a word or two, which a
#: cosine cannot tell from another language: it is not rejected.
LEAST_CLASS = 10
ROWS = 512
UNKNOWN = "und"
#: ASCII bytes that are no letters become blanks.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text):
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(texts):
    """Counts of hashed n-grams, a row per text, and whether a text has a letter."""
    raw = [f" {t.lower()} ".encode("utf-8").translate(_LETTERS) if t else b" " for t in texts]
    row = np.repeat(np.arange(len(raw), dtype=np.int32), [len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    kept = np.ones(len(data), bool)
    kept[1:] = (data[1:] != 32) | (data[:-1] != 32) | (row[1:] != row[:-1])
    data, row = data[kept].astype(np.uint32), row[kept].astype(np.int64) * PLACES
    counts = np.zeros(len(raw) * PLACES, np.int64)
    code = np.zeros(len(data), np.uint32)
    for n in (1, 2, 3):
        code = code[: len(data) - n + 1] * np.uint32(0x01000193) ^ (data[n - 1:] + np.uint32(n << 16))
        place = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)
        place = row[: len(place)] + place
        if n > 1:
            place = place[row[: len(place)] == row[n - 1:]]
        counts += np.bincount(place, minlength=len(counts))
    return counts.reshape(len(raw), PLACES), np.fromiter(map(has_letter, texts), bool, len(texts))


def weighted(counts, idf):
    """TF-IDF rows of length one."""
    rows = (np.log1p(counts, dtype=np.float32) * idf).astype(np.float32)
    length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.maximum(length, 1e-12)[:, None]


def gram_class(counts):
    return np.floor(2 * np.log2(np.maximum((counts > 0).sum(axis=1), 1))).astype(int)


def blocks(texts):
    for start in range(0, len(texts), ROWS):
        yield texts[start:start + ROWS]


def gram_frequencies(df, text):
    """(place, n): the number of rows of `df` whose text has a gram of that place."""

    def run(batches):
        seen = np.zeros(PLACES, np.int64)
        for batch in batches:
            for part in steps(batch, text):
                for some in blocks(part.column(text).to_pylist()):
                    seen += (gram_counts(some)[0] > 0).sum(axis=0)
        place = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(seen[place])], ["place", "n"])

    return df.select(text).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def cosine_bin(cosine):
    return np.clip((cosine * BINS).astype(int), 0, BINS)


def odd_below(counts):
    """Per language and class the bin below which cosines are those of odd rows: `ODD_SHARE` of
    the median of the own rows of that class and its two neighbours, from `counts` by language,
    class and bin. Where these are too few, the rows of all languages count, then the bin of the
    next shorter class, as cosines grow with the class. At most half of a language is odd."""
    out, together = np.zeros(counts.shape[:2], int), counts.sum(axis=0)
    for i, own in enumerate(counts):
        for c in range(CLASSES):
            around = slice(max(0, c - 1), c + 2)
            near = next((n for n in (own[around].sum(axis=0), together[around].sum(axis=0)) if n.sum() >= MEDIAN_ROWS), None)
            if near is not None:
                out[i, c] = int(ODD_SHARE * np.searchsorted(np.cumsum(near), near.sum() / 2))
            elif c:
                out[i, c] = out[i, c - 1]
        if 2 * own[np.arange(BINS + 1) < out[i][:, None]].sum() > own.sum():
            out[i] = 0
    return out


def without_odd(groups):
    """The rows of each language that are not odd by their cosine with the mean of all."""
    counts, places = np.zeros((len(groups), CLASSES, BINS + 1), np.int64), []
    for rows, n in zip(groups, counts):
        mean = rows.sum(axis=0)
        places.append((gram_class(rows), cosine_bin(rows @ (mean / max(np.linalg.norm(mean), 1e-12)))))
        np.add.at(n, places[-1], 1)
    return [rows[near >= odd[at]] for rows, (at, near), odd in zip(groups, places, odd_below(counts))]


def cluster(rows, k, rounds=12, tries=4):
    """Spherical k-means from starts spread far apart, but for the farthest rows, which may be
    odd; returns unit centroids. Rows of small clusters are left out and the others clustered
    again."""
    found = None
    for _ in range(tries):
        picked = [0]
        near = rows @ rows[0]
        while len(picked) < min(k, len(rows)):
            far = int(np.argsort(near, kind="stable")[int(LEAST_CLUSTER * len(rows))])
            picked.append(far)
            near = np.maximum(near, rows @ rows[far])
        centres = rows[picked]
        for _ in range(rounds):
            own = np.argmax(rows @ centres.T, axis=1)
            sums = np.stack([rows[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
            centres = (sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]).astype(np.float32)
        own = np.argmax(rows @ centres.T, axis=1)
        large = np.bincount(own, minlength=len(centres)) >= max(2, LEAST_CLUSTER * len(rows))
        if large.all() or not large.any():
            return centres if large.all() or found is None else found
        found, rows = centres[large], rows[large[own]]
    return found


class LanguageModel:
    """Weights, centroids and bounds, at most a few hundred KB for each language."""

    def __init__(self, languages, idf, centroids, owner, bound):
        self.languages, self.idf, self.centroids, self.owner, self.bound = languages, idf, centroids, owner, bound

    def predict(self, texts):
        """(language, score, rejected) lists."""
        names, scores, out = [], [], []
        for some in blocks(texts):
            counts, letters = gram_counts(some)
            if not self.languages:
                names += [UNKNOWN] * len(some)
                scores += [0.0] * len(some)
                out += [True] * len(some)
                continue
            cosine = weighted(counts, self.idf) @ self.centroids.T
            best = np.argmax(cosine, axis=1)
            top = np.clip(cosine[np.arange(len(some)), best], 0, 1)
            owner = self.owner[best]
            names += [self.languages[o] if ok else UNKNOWN for o, ok in zip(owner, letters)]
            scores += np.where(letters, top, 0.0).astype(float).tolist()
            out += (~letters | (top < self.bound[owner, gram_class(counts)])).tolist()
        return names, scores, out


def own_cosines(rows, text, lang, model):
    """The number and the least cosine of each language's own rows, by class and bin: two arrays."""
    names, idf, centroids, owner = model.languages, model.idf, model.centroids, model.owner
    shape = (len(names), CLASSES, BINS + 1)

    def run(batches):
        least, n = np.full(shape, np.inf), np.zeros(shape, np.int64)
        number = {name: i for i, name in enumerate(names)}
        for batch in batches:
            for part in steps(batch, text):
                for start in range(0, part.num_rows, ROWS):
                    some = part.slice(start, ROWS)
                    counts, letters = gram_counts(some.column(text).to_pylist())
                    cosine = weighted(counts, idf) @ centroids.T
                    found, top = owner[np.argmax(cosine, axis=1)], cosine.max(axis=1)
                    own = letters & (found == [number[x] for x in some.column(lang).to_pylist()])
                    place = (found[own], gram_class(counts)[own], cosine_bin(top[own]))
                    np.minimum.at(least, place, top[own])
                    np.add.at(n, place, 1)
        at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(n[at]), pa.array(least[at])],
                                         ["language", "class", "bin", "n", "least"])

    least, n = np.full(shape, np.inf), np.zeros(shape, np.int64)
    made = rows.select(text, lang).mapInArrow(run, "language long, class long, bin long, n long, least double")
    for r in made.groupBy("language", "class", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least")).collect():
        place = r["language"], r["class"], r["bin"]  # CLASSES * (BINS + 1) for each language at most
        n[place], least[place] = r["n"], r["least"]
    return n, least


def least_left_out(groups, centres, owner, odd):
    """The least cosine of each language's own clustered rows, by class, each row taken out of
    its own cluster: a centroid that follows a row says nothing of the next such row. Bins below
    `odd` do not count."""
    least, stacked = np.full((len(groups), CLASSES), np.inf), np.concatenate(centres)
    for i, data in enumerate(groups):
        cosine, columns = data @ stacked.T, np.flatnonzero(owner == i)
        mine = np.argmax(cosine[:, columns], axis=1)
        for c, column in enumerate(columns):
            some = np.flatnonzero(mine == c)
            rest = data[some].sum(axis=0) - data[some]
            cosine[some, column] = (data[some] * rest).sum(axis=1) / np.maximum(np.linalg.norm(rest, axis=1), 1e-6)
        at, top = gram_class(data), cosine.max(axis=1)
        own = (owner[np.argmax(cosine, axis=1)] == i) & (data > 0).any(axis=1) & (cosine_bin(top) >= odd[i, at])
        np.minimum.at(least[i], at[own], top[own])
    return least


def rounded_down(cosine):
    """To thousandths, since the last bits of a cosine depend on the rows beside it."""
    return np.maximum(np.floor((cosine - 1e-5) * 1000) / 1000, 0)


def bounds(least, n):
    """Per language and class the least cosine of the own rows of that class and its neighbours,
    as many on either side as hold 1 / REJECT_QUANTILE rows. Languages that have fewer than
    that in all share the rows of all languages."""
    enough = 1 / REJECT_QUANTILE
    out = np.zeros(least.shape, np.float32)
    for i in range(len(least)):
        some = slice(i, i + 1) if n[i].sum() >= enough else slice(None)
        low, many = least[some].min(axis=0), n[some].sum(axis=0)
        for c in range(LEAST_CLASS, CLASSES):
            reach = 1
            while reach < CLASSES and many[max(0, c - reach):c + reach + 1].sum() < enough:
                reach += 1
            out[i, c] = low[max(0, c - reach):c + reach + 1].min()
    return np.where(np.isfinite(out), rounded_down(out), 0).astype(np.float32)


def robust_bounds(n, least, groups, centres, owner):
    """Bounds from the own rows that are not odd; from `LEAST_CLASS` on never below what is odd."""
    odd = odd_below(n)
    common = np.arange(BINS + 1) >= odd[:, :, None]
    seen = np.where(common, least, np.inf).min(axis=2)
    out = bounds(np.minimum(seen, least_left_out(groups, centres, owner, odd)), np.where(common, n, 0).sum(axis=2))
    out[:, LEAST_CLASS:] = np.maximum(out, rounded_down(odd / BINS))[:, LEAST_CLASS:]
    return out


def fit(rows, key="doc_id", text="text", lang="lang", sample=SAMPLE, centroids=CENTROIDS):
    """Learn from all rows with a non-null text and language: document frequencies over
    every row, clusters on at most `sample` rows of each language, bounds over every row."""
    rows = rows.select(key, text, lang).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    idf = np.full(PLACES, np.log((1 + total) / 1) + 1, np.float32)
    for r in gram_frequencies(rows, text).collect():  # PLACES rows at most
        idf[r["place"]] = np.log((1 + total) / (1 + r["n"])) + 1

    def vectors(batches):
        for batch in batches:
            for part in steps(batch, text):
                for start in range(0, part.num_rows, ROWS):
                    some = part.slice(start, ROWS)
                    made = weighted(gram_counts(some.column(text).to_pylist())[0], idf)
                    yield pa.RecordBatch.from_arrays(
                        [some.column(lang), pa.array([v.tobytes() for v in made.astype(np.float16)])], ["lang", "v"])

    taken = sampled(rows, key, sample, lang, counts).select(text, F.col(lang).alias(lang)).mapInArrow(
        vectors, "lang string, v binary")
    groups = {}
    for r in taken.collect():  # `sample` rows of a fixed size for each language, in expectation
        groups.setdefault(r["lang"], []).append(bytes(r["v"]))
    names = sorted(groups)
    centres, owner, known = [], [], []
    for name in names:
        known.append(np.stack([np.frombuffer(v, np.float16) for v in sorted(groups[name])]).astype(np.float32))
    for i, data in enumerate(without_odd(known)):
        made = cluster(data, centroids)
        centres.append(made)
        owner += [i] * len(made)
    stacked = np.concatenate(centres) if centres else np.zeros((0, PLACES), np.float32)
    model = LanguageModel(names, idf, stacked, np.array(owner, np.int64), np.zeros((len(names), CLASSES), np.float32))
    if names:
        n, least = own_cosines(rows.where(F.col(lang).isin(names)), text, lang, model)
        model.bound = robust_bounds(n, least, known, centres, model.owner)
    return model


def identify(df, model, text="text"):
    """`df` with `lang_pred`, `score` (cosine, 0 to 1) and `rejected`."""
    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())]
    return map_texts(df, text, fields, lambda: lambda texts: list(model.predict(texts.to_pylist())))


def accepted(df, model, text="text"):
    """The rows of `df` that the model does not reject."""
    def make():
        return lambda texts: [[not r for r in model.predict(texts.to_pylist())[2]]]

    return map_texts(df, text, [("kept", T.BooleanType())], make, keep="kept")


def op5_language(spark, sf_dir):
    """Language of every document, learnt from three quarters of them."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = crc_part("doc_id", 4) == 2
    model = fit(docs.where(F.coalesce(~held, F.lit(False))))
    return identify(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), model).drop("text")
