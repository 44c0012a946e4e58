"""Toxicity by weak supervision: voters, a label model, and a classifier on its posteriors.

Voters look at a text's words. Lexicon voters hold one term each, a word or the first
letters of one word or of two different ones, mined where labelled toxic texts have it far
more often than others; of terms that begin alike the shortest of the most telling ones
stands for all. Equal texts
count once. Pattern voters look for shouting, repeated marks and repeated words, and one
voter says that no term is there.

The label model is generative: every voter fires with a rate of its own in either class and
otherwise abstains. Voters that agree more than the classes explain (their residual
correlation) share their weight. Known labels are held: expectation maximisation estimates
the rates from these and from the posteriors of unlabelled rows, which it estimates in turn.
A linear classifier learns all posteriors from presence of terms and patterns, and scores
all texts.

Votes are kept as lists of what fires and correlations are summed a block of voters at a
time, so memory grows with the votes and not with the square of the terms.

A null or empty text, or one that no voter fires on, gets the score of the intercept. Equal
texts get equal scores. Without labels of both kinds, or without any term, all scores are 0.
Rows with a null key and labels without a key teach nothing, and neither does a key that is
labelled both ways. Texts are read whole, however long.
"""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import functions as F

from maskwright.llm.common import crc_part, labelled_sample, logistic, map_texts, sampled, table, written

#: Labelled rows of each kind, and unlabelled rows, to learn from, at most.
SAMPLE = 4000
PREFIXES = (4, 5, 6, 7)
#: Texts that a term has to occur in, and the share that its rate in toxic texts has to
#: have of its rates in both kinds.
LEAST_TEXTS, LEAST_SHARE = 3, 0.8
#: Chance that any term at all passes the test of its counts though it says nothing.
CHANCE = 0.05
#: Pull of the classifier's weights towards 0.
RIDGE = 0.2
#: Voters whose correlations with all others are summed at a time.
BLOCK = 128
THRESHOLD = 0.3
_WORDS = re.compile(r"[^\W\d_]+").findall
_MARKS = re.compile(r"[!?]{2,}").search
PATTERNS = 3


def folded(words):
    """The distinct words, in lower case."""
    return {w.lower() for w in set(words)}


def terms_of(text):
    """The distinct words of a text and their first letters, marked with `*`, or with `**` if
    several words have them."""
    words = folded(_WORDS(text or ""))
    found = set(words)
    for n in PREFIXES:
        begin = [w[:n] for w in words if len(w) > n]
        once = set(begin)
        found.update([b + "*" for b in once])
        if len(once) < len(begin):
            found.update([b + "**" for b, k in Counter(begin).items() if k > 1])
    return found


def patterns(text, words):
    """Votes of the pattern voters on a text and its words: shouting, runs of marks, runs of one
    word."""
    loud = sum(map(str.isupper, words))
    return [
        len(words) >= 5 and loud > 0.7 * len(words),
        _MARKS(text) is not None,
        any(a == b == c == d for a, b, c, d in zip(words, words[1:], words[2:], words[3:]) if len(a) > 1),
    ]


class Lexicon:
    """Places of terms, looked up by word."""

    def __init__(self, terms):
        self.terms = list(terms)
        self.words, self.stems = {}, {n: {} for n in PREFIXES}
        for i, term in enumerate(self.terms):
            letters = term.rstrip("*")
            if letters == term:
                self.words[term] = i
            else:
                self.stems[len(letters)].setdefault(letters, [-1, -1])[len(term) - len(letters) - 1] = i
        self.stems = {n: own for n, own in self.stems.items() if own}

    def of(self, word):
        """(places that the word fires, places that it fires together with another word)."""
        alone, paired = ([self.words[word]] if word in self.words else []), []
        for n, own in self.stems.items():
            one, two = own.get(word[:n], (-1, -1)) if len(word) > n else (-1, -1)
            alone += [one] * (one >= 0)
            paired += [two] * (two >= 0)
        return alone, paired

    def votes(self, texts):
        """Places of the terms in each text (a list of words), sorted. Words are looked up once."""
        known, out = {}, []
        for words in texts:
            found, half = set(), set()
            for word in folded(words) if self.terms else ():
                places = known.get(word)
                if places is None:
                    places = known[word] = self.of(word)
                found.update(places[0])
                for p in places[1]:
                    (found if p in half else half).add(p)
            out.append(sorted(found))
        return out


class ToxicityModel:
    """Terms and their weights, weights of the patterns, and the intercept."""

    def __init__(self, weights, marks, intercept):
        self.weights, self.marks, self.intercept = weights, marks, intercept
        self.lexicon = Lexicon(weights)

    def scores(self, texts):
        own = np.array([*self.weights.values(), 0.0])
        totals = np.full(len(texts), float(self.intercept))
        words = [_WORDS(text or "") for text in texts]
        for i, places in enumerate(self.lexicon.votes(words)):
            totals[i] += own[places].sum()
            if any(self.marks):
                totals[i] += sum(w for w, fires in zip(self.marks, patterns(texts[i] or "", words[i])) if fires)
        return (1 / (1 + np.exp(-np.clip(totals, -40, 40)))).tolist()


def least_g(tests):
    """The G of four counts (likelihood ratio test) that one of so many tests passes by chance
    with the probability `CHANCE`."""
    low, high = 0.0, 1000.0
    while high - low > 1e-6:
        g = (low + high) / 2
        low, high = (g, high) if math.erfc(math.sqrt(g / 2)) * max(1, tests) > CHANCE else (low, g)
    return high


def mine(rows, text="text"):
    """(term, toxic texts, texts) of all terms that toxic texts have far more often than others,
    the strongest first. Rates are taken within each label, so that it does not matter how
    many rows either has."""
    every = F.concat(_terms(F.col(text)), F.array(F.lit("")))  # the empty term counts all rows
    found = rows.select("label", F.explode(every).alias("term"))
    tally = written(found.groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("bad"), F.count("*").alias("n"))
        .where(F.col("n") >= LEAST_TEXTS))
    whole = tally.where(F.col("term") == "").first()
    if whole is None or not 0 < whole["bad"] < whole["n"]:
        return []
    toxic, other = float(whole["bad"]), float(whole["n"] - whole["bad"])
    bad, fine = F.col("bad").cast("double"), (F.col("n") - F.col("bad")).cast("double")
    share = (bad / toxic) / (bad / toxic + fine / other)

    def part(seen, margin, kind):
        return F.when(seen > 0, seen * F.log(seen * (toxic + other) / (margin * kind))).otherwise(0.0)

    n, rest = F.col("n").cast("double"), F.lit(toxic + other) - F.col("n")
    g = 2 * (part(bad, n, toxic) + part(fine, n, other) + part(toxic - bad, rest, toxic) + part(other - fine, rest, other))
    good = tally.where((F.col("term") != "") & (bad >= LEAST_TEXTS)).select("term", "bad", "n", share.alias("share"), g.alias("g")).where(
        (F.col("share") >= LEAST_SHARE) & (F.col("g") >= least_g(tally.count() - 1)))
    strong = [(r["term"], r["bad"], r["n"], r["share"]) for r in good.orderBy(F.desc("g"), "term").collect()]
    return one_of_each(strong)


def one_of_each(terms):
    """`terms` less those with first letters that are as telling: these are in the same texts
    and more."""
    shares = {t: share for t, _, _, share in terms}

    def covered(term):
        letters = term.rstrip("*")
        wider = [letters[:k] + "*" for k in PREFIXES if k < len(letters)] + [letters + "*"] * term.endswith("**")
        if term.endswith("**"):
            wider += [letters[:k] + "**" for k in PREFIXES if k < len(letters)]
        return any(shares.get(w, -1) >= shares[term] for w in wider)

    return [(t, bad, n) for t, bad, n, _ in terms if not covered(t)]


def _terms(text):
    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(terms_of(t)) for t in texts.to_pylist()], pa.list_(pa.string()))

    return found(text)


class Votes:
    """What fires on which row: two arrays, sorted by voter."""

    def __init__(self, lists, voters):
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        voter = np.array([v for x in lists for v in x], np.int64)
        order = np.lexsort((row, voter))
        self.row, self.voter, self.rows, self.voters = row[order], voter[order], len(lists), voters
        self.begin = np.searchsorted(self.voter, np.arange(voters + 1))

    def by_voter(self, x):
        """Sum of x over the rows that each voter fires on."""
        return np.bincount(self.voter, x[self.row], self.voters)

    def by_row(self, w):
        """Sum of w over the voters that fire on each row."""
        return np.bincount(self.row, w[self.voter], self.rows)

    def together(self):
        """(voters, counts of rows that each of these shares with all), block after block."""
        for first in range(0, self.voters, BLOCK):
            last = min(first + BLOCK, self.voters)
            a, b = self.begin[first], self.begin[last]
            own = np.zeros((self.rows, last - first), np.float32)
            own[self.row[a:b], self.voter[a:b] - first] = 1
            both = np.zeros((self.voters, last - first))
            for v in range(self.voters):
                both[v] = own[self.row[self.begin[v]:self.begin[v + 1]]].sum(axis=0)
            yield np.arange(first, last), both


def shares(votes, post, one, zero):
    """The weight each voter keeps: one over the sum of its squared residual correlations with
    all voters, itself included."""
    side = np.stack([post, 1 - post], axis=1)
    rates = np.stack([one, zero])
    fired = np.stack([votes.by_voter(side[:, 0]), votes.by_voter(side[:, 1])], axis=1)
    grown = rates.T @ (side.T @ side)
    spread = np.sqrt(np.maximum(
        np.diff(votes.begin) - 2 * (fired * rates.T).sum(axis=1) + (grown * rates.T).sum(axis=1), 1e-9))
    kept = np.ones(votes.voters)
    for own, both in votes.together():
        rest = both - fired @ rates[:, own] - (fired[own] @ rates).T + grown @ rates[:, own]
        agree = rest / np.outer(spread, spread[own])
        agree[own, np.arange(len(own))] = 1.0
        kept[own] = 1 / np.maximum((agree ** 2).sum(axis=0), 1.0)
    return kept


def label_model(votes, known, prior, rounds=30):
    """Posteriors of all rows, the rates of all voters (class 0, class 1) and the weights they
    keep. `known` holds labels, NaN where there is none; labels are held. A voter that does
    not fire abstains; the odds of what fires are set to a scale by the known rows, each label
    counting as much as `prior` says."""
    open_ = np.isnan(known)
    share = np.where(known == 1, prior / max(1, (known == 1).sum()), (1 - prior) / max(1, (known == 0).sum()))[~open_]
    post = np.where(open_, prior, known)

    def rates(side):
        # drawn to the voter's rate in all rows, as if one more row were known
        return (votes.by_voter(side) + np.diff(votes.begin) / votes.rows) / (side.sum() + 1)

    sure = np.where(open_, 0.0, post), np.where(open_, 0.0, 1 - post)
    keep = shares(votes, post, rates(sure[0]), rates(sure[1]))
    for _ in range(rounds):
        one, zero = np.clip(rates(post), 1e-9, 1), np.clip(rates(1 - post), 1e-9, 1)
        odds = votes.by_row(keep * np.log(one / zero))
        slope, start = logistic(odds[~open_, None], known[~open_], share * len(share), ridge=1e-4)
        new = np.where(open_, 1 / (1 + np.exp(-np.clip(slope * odds + start, -30, 30))), known)
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < 1e-6:
            break
    return post, (zero, one), keep


def classifier(votes, y, weight, ridge=RIDGE, rounds=50):
    """Weights of a ridge logistic regression on what fires, and the intercept: Newton's steps,
    each solved by conjugate gradients."""
    w, b = np.zeros(votes.voters), 0.0

    def dot(a, c):
        return float(a[0] @ c[0] + a[1] * c[1])

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(votes.by_row(w) + b, -30, 30)))
        off, curve = weight * (p - y), weight * p * (1 - p)
        x = (np.zeros(votes.voters), 0.0)
        left = (-(votes.by_voter(off) + ridge * w), -float(off.sum()))
        way, size = left, dot(left, left)
        start = size
        for _ in range(200):
            if size <= 1e-12 * max(start, 1e-12):
                break
            seen = curve * (votes.by_row(way[0]) + way[1])
            turned = (votes.by_voter(seen) + ridge * way[0], float(seen.sum()) + 1e-9 * way[1])
            step = size / dot(way, turned)
            x = (x[0] + step * way[0], x[1] + step * way[1])
            left = (left[0] - step * turned[0], left[1] - step * turned[1])
            now = dot(left, left)
            way, size = (left[0] + now / size * way[0], left[1] + now / size * way[1]), now
        w, b = w + x[0], b + x[1]
        if max(np.abs(x[0]).max(initial=0), abs(x[1])) < 1e-6:
            break
    return w, b


def fit(docs, labels, key="doc_id", text="text", label="toxic", sample=SAMPLE):
    """Learn from at most about `sample` rows of each label (1 toxic, 0 not), and as many rows
    of `docs` without a label."""
    nothing = ToxicityModel({}, [0.0] * PATTERNS, -40.0)
    known = labels.select(key, F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col(key).isNotNull())
    single = known.groupBy(key).agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    rows, counts = labelled_sample(docs, single, key, "label", sample, text)
    if not (counts.get(0) and counts.get(1)):
        return nothing
    rows = written(rows.select(F.col(text).alias("text"), "label"))
    terms = [t for t, _, _ in mine(rows)]
    if not terms:
        return nothing
    every = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("text"))
    total = every.count()
    some = sampled(every.withColumn("label", F.lit(2)), "_key", sample, "label", {2: total})
    some = some.join(known, some["_key"] == known[key], "left_anti").select("text", "label")
    lexicon = Lexicon(terms)

    @F.arrow_udf("array<int>")
    def fires(texts: pa.Array) -> pa.Array:
        texts = [t or "" for t in texts.to_pylist()]
        words = [_WORDS(t) for t in texts]
        return pa.array([found + [len(terms) + i for i, p in enumerate(patterns(t, w)) if p]
                         for t, w, found in zip(texts, words, lexicon.votes(words))], pa.list_(pa.int32()))

    got = [(r["label"], r["fires"]) for r in rows.unionByName(some).select("label", fires("text").alias("fires")).collect()]
    got.sort()
    gold = np.array([np.nan if k == 2 else k for k, _ in got], float)
    none = len(terms) + PATTERNS
    votes = Votes([f if f and f[0] < len(terms) else [*f, none] for _, f in got], none + 1)
    post, _, _ = label_model(votes, gold, counts[1] / (counts[0] + counts[1]))
    # rows stand for those that were not picked; unlabelled ones for as many as a labelled row does on average
    weight = np.ones(len(gold))
    for k in (0, 1):
        weight[gold == k] = counts[k] / max(1, (gold == k).sum())
    weight[np.isnan(gold)] = weight[~np.isnan(gold)].mean()
    w, b = classifier(Votes([f for _, f in got], none), post, weight)
    return ToxicityModel({t: float(v) for t, v in zip(terms, w)}, [float(v) for v in w[len(terms):]], float(b))


def score(df, model, text="text"):
    """`df` with `score` (0 to 1, higher is more toxic) and `predicted` (1 at 0.3 or more)."""

    def work(texts):
        made = model.scores(texts.to_pylist())
        return [made, [int(s >= THRESHOLD) for s in made]]

    return map_texts(df, text, [("score", T.DoubleType()), ("predicted", T.IntegerType())], lambda: work)


def op9_toxicity(spark, sf_dir):
    """Toxicity score of every document, learnt from three quarters of the rows and labels."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held = crc_part("doc_id", 4) == 2
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held)
    model = fit(docs.where(~held), labels)
    return score(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), model).drop("text")
