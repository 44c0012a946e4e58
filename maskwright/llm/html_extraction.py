"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks. Each is a vector: hashed tags and names above it, hashed
words of its text, and a few measures. A bidirectional LSTM in numpy reads the blocks of
a page in order, so that every block is labelled with the whole page in view, and the
blocks labelled as content make up the text.

The model is trained here, on a bounded sample of the pages. Its labels are weak: what
the names of tags and classes say of a block. The sample is also varied: wrappers are
renamed, and notices, adverts, forms, menus and comments from other pages are put in, so
that the model learns kinds of blocks and not one layout.

A null, empty or blank page has the empty text. Pages with nothing but other blocks have
it too. Repeated rows give repeated results. A page may be as long and as deeply nested as it
likes: its blocks are read in parts, and what is known of a path is worked out from that of
the path above. Pages that are very long or deep do not teach, and neither do those with a
null key.
"""

import random
import zlib
from functools import reduce

import numpy as np
import pyspark.sql.types as T
from pyspark.sql import functions as F

from maskwright.llm.common import map_texts, table
from maskwright.llm.html_blocks import Path, page_blocks

#: Pages to learn from, at most, and the longest and the deepest of these.
SAMPLE = 128
SAMPLE_CHARS, SAMPLE_DEPTH = 200_000, 200
PATH_PLACES, WORD_PLACES, MEASURES = 192, 24, 6
WIDTH = PATH_PLACES + WORD_PLACES + MEASURES
HIDDEN_UNITS = 20
ROUNDS = 7
#: Seeds of the varied copies of the sample.
VARIED = tuple(range(3, 13))
CELLS = 16_384
#: Tags and names that say that a block is not the article's own text.
OTHER_TAGS = frozenset("nav footer aside form menu dialog button select textarea".split())
OTHER_NAMES = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright discussion disqus footer form gdpr header hidden masthead menu modal nav navbar navigation newsletter notice "
    "pager pagination popup promo promotion promoted recommended related replies reply respond search share sharing shop "
    "sidebar sidenav signup social sponsor sponsored subscribe subscription tags toolbar topbar widget".split())
MAIN_NAMES = frozenset("article content entry main post story body text".split())
#: Those that are foreign outside the article and part of it inside.
OUTER_TAGS, OUTER_NAMES = frozenset("header fieldset figcaption".split()), frozenset(["byline"])


def weak_labels(blocks):
    """1 for the blocks that belong to the article by the tags and names above them: those
    inside its element or, on a page without one, all that nothing speaks against."""
    sides = [downward(path, "side", (False, False), _side) for path, _, _ in blocks]
    some = any(main and not against for main, against in sides)
    return [int(not against and (main or not some)) for main, against in sides]


def _side(above, own):
    """(inside the article, foreign) below one more tag."""
    (main, against), (tag, names) = above, own
    against = against or tag in OTHER_TAGS or bool(OTHER_NAMES.intersection(names)) or not main and (
        tag in OUTER_TAGS or bool(OUTER_NAMES.intersection(names)))
    return main or tag in ("article", "main") or bool(MAIN_NAMES.intersection(names)), against


def downward(path, name, start, step):
    """A fold over the tags of a path; the nodes of a page's tree keep theirs."""
    return path.worked(name, start, step) if isinstance(path, Path) else reduce(step, path, start)


_places = {}


def place(token, size):
    key = token, size
    if key not in _places:
        if len(_places) > 200_000:
            _places.clear()
        h = zlib.crc32(token.encode("utf-8"))
        _places[key] = h % size, 1.0 if h & 0x80000000 else -1.0
    return _places[key]


def path_vector(path):
    return np.clip(downward(path, "sum", np.zeros(PATH_PLACES, np.float32), _with_tag), -2, 2)


def _with_tag(above, own):
    v, (tag, names) = above.copy(), own
    for token in ("<" + tag, *names):
        for spelled in (token, "2" + token):
            at, sign = place(spelled, PATH_PLACES)
            v[at] += sign
    return v


def vectors(pages):
    """For each page a row for each of its blocks."""
    blocks = [b for page in pages for b in page]
    if not blocks:
        return [np.zeros((0, WIDTH), np.float32) for _ in pages]
    seen = {}
    at = [seen.setdefault(path, len(seen)) for path, _, _ in blocks]
    out = np.zeros((len(blocks), WIDTH), np.float32)
    out[:, :PATH_PLACES] = np.stack([path_vector(path) for path in seen])[at]
    out[:, PATH_PLACES:-MEASURES] = word_vectors([text for _, text, _ in blocks])
    size = np.array([len(text) for _, text, _ in blocks])
    out[:, -6] = np.log1p(size) / 8
    out[:, -5] = [linked for _, _, linked in blocks]
    out[:, -4] = [text[-1] in ".!?…" for _, text, _ in blocks]
    out[:, -3] = ["©" in text for _, text, _ in blocks]
    out[:, -2] = [min(len(path), 64) / 8 for path, _, _ in blocks]
    out[:, -1] = 1
    return np.split(out, np.cumsum([len(page) for page in pages])[:-1])


_FACTOR = np.random.default_rng(5).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_vectors(texts):
    """Signed counts of all words of each text in hashed places, damped by their number."""
    raw = [t.encode("utf-8") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.flatnonzero(data == 32)  # a block has single blanks only
    starts = np.concatenate([[0], ends[:-1] + 1])
    offset = np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), ends + 1 - starts)
    name = np.add.reduceat(data * _FACTOR[offset & 63], starts)
    name ^= name >> np.uint64(29)
    owner = np.searchsorted(np.cumsum([len(r) for r in raw]), starts, side="right")
    spot = owner * WORD_PLACES + (name % np.uint64(WORD_PLACES)).astype(np.int64)
    sign = np.where(name >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    sums = np.bincount(spot, sign, len(raw) * WORD_PLACES).reshape(len(raw), WORD_PLACES)
    return sums / np.sqrt(1 + np.bincount(owner, minlength=len(raw)))[:, None]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction; `mask` keeps the state of pages that have ended, `state` that of a page
    that is read in parts."""

    def __init__(self, rng, width, units):
        self.w = (rng.standard_normal((width, 4 * units)) / np.sqrt(width)).astype(np.float32)
        self.u = (rng.standard_normal((units, 4 * units)) / np.sqrt(units)).astype(np.float32)
        self.b = np.zeros(4 * units, np.float32)
        self.b[units:2 * units] = 1

    def forward(self, x, mask, trace=None, state=None):
        steps, batch, _ = x.shape
        n = self.u.shape[0]
        drive = x @ self.w + self.b
        h, c = state or (np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32))
        out = np.zeros((steps, batch, n), np.float32)
        for t in range(steps):
            z = drive[t] + h @ self.u
            gates = _sigmoid(z[:, :3 * n])
            i, f, o, g = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:], np.tanh(z[:, 3 * n:])
            new = f * c + i * g
            m = mask[t][:, None]
            if trace is not None:
                trace.append((i, f, o, g, c, new, h, m))
            h, c = m * (o * np.tanh(new)) + (1 - m) * h, m * new + (1 - m) * c
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out

    def backward(self, x, trace, grad):
        """Gradients of w, u and b for the gradient of the outputs."""
        n = self.u.shape[0]
        gw, gu, gb = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        dh = np.zeros_like(grad[0])
        dc = np.zeros_like(grad[0])
        for t in range(len(trace) - 1, -1, -1):
            i, f, o, g, c, new, h, m = trace[t]
            dh = dh + grad[t]
            soft = np.tanh(new)
            own = m * dh
            dnew = m * dc + own * o * (1 - soft ** 2)
            dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), own * soft * o * (1 - o), dnew * i * (1 - g ** 2)], axis=1)
            gw += x[t].T @ dz
            gu += h.T @ dz
            gb += dz.sum(axis=0)
            dh = dz @ self.u.T + (1 - m) * dh
            dc = dnew * f + (1 - m) * dc
        return gw, gu, gb


class BlockLabeller:
    """Bidirectional LSTM with a logistic output; some 40,000 numbers."""

    def __init__(self, seed=7):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng, WIDTH, HIDDEN_UNITS), Lstm(rng, WIDTH, HIDDEN_UNITS)
        self.out = (rng.standard_normal(2 * HIDDEN_UNITS) / np.sqrt(2 * HIDDEN_UNITS)).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def parameters(self):
        return [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.out, self.offset]

    @staticmethod
    def padded(pages):
        steps = max(map(len, pages))
        x = np.zeros((steps, len(pages), WIDTH), np.float32)
        mask = np.zeros((steps, len(pages)), np.float32)
        for j, rows in enumerate(pages):
            x[:len(rows), j] = rows
            mask[:len(rows), j] = 1
        return x, mask

    def scores(self, pages):
        """Logits for each block of each page; pages of like length go together."""
        out = [np.zeros(0, np.float32)] * len(pages)
        order = sorted([i for i in range(len(pages)) if len(pages[i])], key=lambda i: len(pages[i]))
        while order:
            group = [order.pop()]
            most = len(pages[group[0]])
            while order and (len(group) + 1) * most <= CELLS:
                group.append(order.pop())
            x, mask = self.padded([pages[i] for i in group])
            both = self.ahead.forward(x, mask), self.back.forward(x[::-1], mask[::-1])[::-1]
            logit = both[0] @ self.out[:HIDDEN_UNITS] + both[1] @ self.out[HIDDEN_UNITS:] + self.offset
            for j, i in enumerate(group):
                out[i] = logit[:len(pages[i]), j]
        return out

    def long_scores(self, blocks):
        """Logits of the blocks of one page, `CELLS` blocks at a time in either direction."""
        out = np.full(len(blocks), self.offset[0], np.float32)
        begins = range(0, len(blocks), CELLS)
        for lstm, weight, turn in ((self.ahead, self.out[:HIDDEN_UNITS], 1), (self.back, self.out[HIDDEN_UNITS:], -1)):
            state = [np.zeros((1, HIDDEN_UNITS), np.float32)] * 2
            for a in begins[::turn]:
                x, mask = self.padded(vectors([blocks[a:a + CELLS]]))
                out[a:a + CELLS] += (lstm.forward(x[::turn], mask, state=state)[::turn] @ weight)[:, 0]
        return out

    def train(self, pages, labels, rounds=ROUNDS, rate=0.01, batch=24, seed=11):
        rng = np.random.default_rng(seed)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        count = 0
        for turn in range(rounds):
            order = sorted(range(len(pages)), key=lambda i: (len(pages[i]), i))
            groups = [order[k:k + batch] for k in range(0, len(order), batch)]
            for k in rng.permutation(len(groups)):
                group = groups[k]
                x, mask = self.padded([pages[i] for i in group])
                y = np.zeros_like(mask)
                for j, i in enumerate(group):
                    y[:len(labels[i]), j] = labels[i]
                ahead, back = [], []
                a, b = self.ahead.forward(x, mask, ahead), self.back.forward(x[::-1], mask[::-1], back)[::-1]
                logit = a @ self.out[:HIDDEN_UNITS] + b @ self.out[HIDDEN_UNITS:] + self.offset
                d = (_sigmoid(logit) - y) * mask / mask.sum()
                grads = [
                    *self.ahead.backward(x, ahead, d[:, :, None] * self.out[:HIDDEN_UNITS]),
                    *self.back.backward(x[::-1], back, (d[:, :, None] * self.out[HIDDEN_UNITS:])[::-1]),
                    np.concatenate([(d[:, :, None] * a).sum(axis=(0, 1)), (d[:, :, None] * b).sum(axis=(0, 1))]),
                    np.array([d.sum()], np.float32),
                ]
                count += 1
                step = rate * (1 - turn / rounds * 0.8)
                for p, g, (m, v) in zip(self.parameters(), grads, moments):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= step * (m / (1 - 0.9 ** count)) / (np.sqrt(v / (1 - 0.99 ** count)) + 1e-6)


def varied(pages, seed=3):
    """More pages to learn from: wrappers and inner tags renamed, and foreign blocks put in."""
    dice = random.Random(seed)
    texts = [text for blocks in pages for _, text, _ in blocks] or ["text"]
    names, mains, tags = sorted(OTHER_NAMES), sorted(MAIN_NAMES), sorted(OTHER_TAGS)
    lines = [(("p", ()),), (("blockquote", ()), ("p", ())), (("ul", ()), ("li", ())), (("ol", ()), ("li", ())), (("h2", ()),), (("h3", ()),),
             (("table", ()), ("tr", ()), ("td", ())), (("div", ()),), (("pre", ()),), (("section", ()), ("p", ())), (("dl", ()), ("dd", ()))]
    out = []
    for blocks in pages:
        swap = {"article": dice.choice([[("article", ())], [("main", ())], [("main", ()), ("article", ())], [("div", (dice.choice(mains),))],
                                        [("section", (dice.choice(mains),))], [("div", ("main", dice.choice(mains)))], [], [("div", ())]])}
        for tag in ("nav", "footer", "aside", "header"):
            swap[tag] = dice.choice([[(tag, ())], [("div", (dice.choice(names),))], [("section", (dice.choice(names),))], [(tag, (dice.choice(names),))]])
        deep = [(t, ()) for t in dice.choice([(), (), ("div",), ("div", "div"), ("section", "div")])]
        made = []
        for path, text, linked in blocks:
            main = any(t == "article" for t, _ in path)
            new = [p for t, n in path for p in (swap[t] if t in swap else [(t, n)])]
            if main and new and new[-1][0] == "p" and dice.random() < 0.5:
                new[-1:] = dice.choice(lines)
            if main and dice.random() < 0.25:
                text = " ".join(text.split(" ")[:dice.randint(1, 5)])
            made.append((tuple(new[:2] + deep + new[2:]), text, linked))
        if dice.random() < 0.25:  # a fragment
            some = [b for b in made if dice.random() < 0.5][:dice.randint(1, 6)] or made[:1]
            made = [(p[2:], t, k) for p, t, k in some]
        for _ in range(dice.randint(0, 6)):
            at = dice.randint(0, len(made))
            near = made[at - 1][0] if made and at else (("html", ()), ("body", ()))
            keep = near[:dice.randint(min(2, len(near)), len(near))]
            kind = (dice.choice(tags), ()) if dice.random() < 0.3 else (dice.choice(("div", "section", "ul", "p", "aside")), (dice.choice(names),))
            inner = dice.choice(lines + [()])
            for _ in range(dice.randint(1, 4)):
                text = dice.choice(texts)
                made.insert(at, (keep + (kind,) + inner, text[:dice.choice((20, 60, 400))].strip() or text, dice.choice((0.0, 0.0, 1.0))))
        out.append(made)
    return out


def fit(pages, html="html", key="page_id", sample=SAMPLE):
    """A labeller learnt from about `sample` of the pages at most."""
    count = pages.count()
    share = F.pmod(F.xxhash64(F.lit("pages"), F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    taken = pages.where(share < min(1.0, sample / max(1, count))).where(F.length(html) <= SAMPLE_CHARS).select(html).collect()
    read = [b for b in (page_blocks(r[0]) for r in sorted(taken)) if b and max(len(path) for path, _, _ in b) <= SAMPLE_DEPTH]
    return fit_pages(read)


def fit_pages(read):
    """A labeller learnt from the blocks of some pages."""
    # so that there is something to learn from, whatever the pages
    read = read + [[((("html", ()), ("body", ()), ("article", ()), ("p", ())), "A line of text.", 0.0)]]
    shown = read + [b for seed in VARIED for b in varied(read, seed)]
    model = BlockLabeller()
    model.train(vectors(shown), [weak_labels(b) for b in shown])
    return model


def texts_of(model, htmls):
    """Main text of each page."""
    root = Path()
    blocks = [page_blocks(h, root) for h in htmls]
    short = [b if len(b) <= CELLS else [] for b in blocks]
    scores = model.scores(vectors(short))
    scores = [s if len(b) <= CELLS else model.long_scores(b) for b, s in zip(blocks, scores)]
    return ["\n".join([text for (_, text, _), s in zip(b, logit) if s > 0]) for b, logit in zip(blocks, scores)]


def extract(df, model, html="html"):
    """`df` with `text` and `n_chars`."""

    def work(pages):
        made = texts_of(model, pages.to_pylist())
        return [made, [len(t) for t in made]]

    return map_texts(df, html, [("text", T.StringType()), ("n_chars", T.LongType())], lambda: work)


def op3_html(spark, sf_dir):
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", "n_chars")
