"""Learnt operators: held-out accuracy on the given tables, and odd rows."""

import random

import numpy as np
import pytest

from maskwright.llm import language, quality, toxicity
from maskwright.llm.html_blocks import page_blocks
from maskwright.llm import html_extraction as html

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "12345 !!! ###"), (4, "x " * 150_000), (5, "the ering of and thtion"), (5, "the ering of and thtion")]


def odd(spark):
    return spark.createDataFrame([(i, t, "mine", 0.5) for i, t in ODD], "doc_id long, text string, lang_pred string, score double")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_language(spark, docs):
    rows = {r["doc_id"]: r for r in language.op5_language(spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i, r in rows.items() if r["held_out"]]
    assert len(rows) == len(truth) and len(held) > 200
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert sum(r["rejected"] for r in rows.values()) == 0  # all are clean text


def test_language_of_odd_rows(spark, docs):
    model = language.fit(docs)
    got = language.identify(odd(spark), model).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "lang_pred", "score", "rejected"}
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in got[:3]] == [("und", 0.0, True)] * 3
    assert got[4]["lang_pred"] == got[5]["lang_pred"] != "und"
    assert [r["doc_id"] for r in language.accepted(odd(spark), model).collect()][-2:] == [5, 5]
    none = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(odd(spark), none).collect()} == {"und"}
    assert language.identify(odd(spark).limit(0), model).count() == 0


UNLEARNT = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván",
]


def test_unlearnt_languages_are_rejected(spark, docs):
    learnt = docs.where("doc_id % 4 <> 2")
    model = language.fit(learnt)
    dice = random.Random(6)
    noise = ["".join(dice.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (60, 100, 300, 1000, 5000)]
    planted = [t[:n] for t in UNLEARNT for n in (60, 110)] + [t * 10 for t in UNLEARNT] + noise
    assert all(model.predict(planted)[2])
    clean = [r["text"] for r in docs.where("doc_id % 4 = 2").collect()]
    short = [t for t in clean if t and language.has_letter(t) and len(t) < 100]
    assert len(short) >= 5 and not any(model.predict(short)[2]) and sum(model.predict(clean)[2]) <= 1


def odd_texts(n):
    """Texts of the words of an unlearnt language, or of random letters, all different."""
    dice = random.Random(8)

    def text(i):
        words = dice.choice([25, 60, 200])
        if i % 5 == 4:
            return "".join(dice.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(words * 6))
        return " ".join(dice.choice(UNLEARNT[i % 5].split()) for _ in range(words))

    return [text(i) for i in range(n)]


@pytest.mark.parametrize("n", [1, 12])
def test_odd_rows_under_a_learnt_language_are_rejected(spark, docs, n):
    rows = [(90_000 + i, text, ["de", "en", "es", "fr"][i % 4]) for i, text in enumerate(odd_texts(n))]
    both = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kept = {r["doc_id"] for r in language.accepted(both, language.fit(both)).collect()}
    assert not kept & {r[0] for r in rows} and len(kept) >= docs.count() - 1


def test_no_centroid_for_a_few_odd_rows():
    dice = np.random.default_rng(3)
    rows = np.zeros((200, language.PLACES), np.float32)
    rows[:100, :300] = 1 + dice.random((100, 300))
    rows[100:, 200:500] = 1 + dice.random((100, 300))
    rows[0], rows[1], rows[0, 3000:3300], rows[1, 3500:3800] = 0, 0, 1, 1
    made = language.cluster(rows / np.linalg.norm(rows, axis=1)[:, None], 4)
    assert len(made) >= 2 and not made[:, 3000:].any()
    assert len(language.cluster(np.eye(3, language.PLACES, dtype=np.float32), 4)) == 3


def test_what_is_odd_does_not_depend_on_the_number_of_rows():
    for times in (1, 1000):
        n = np.zeros((1, language.CLASSES, language.BINS + 1), np.int64)
        n[0, 14, [15, 40, 60, 70]] = [1, 1, 20, 20]
        n[0, 18, [20, 90]] = [1, 40]
        got = language.odd_below(n * times)[0]
        assert (got[:13] == 0).all() and (got[13:17] == 21).all() and (got[17:] == 31).all()
    other = np.zeros_like(n)
    other[0, 14, 10], other[0, 14, 50] = 5, 4
    got = language.odd_below(np.concatenate([n, other, other * 10]))
    assert got[0, 14] == 21 and (got[1] == 0).all() and got[2, 14] == 3  # few rows; a median of its own
    n, least = n * 1000, np.full(n.shape, np.inf)
    least[n > 0] = (np.nonzero(n)[2] + 0.5) / language.BINS
    alike = np.full((2, language.PLACES), 1 / 64, np.float32)
    bound = language.robust_bounds(n, least, [alike], [alike[:1]], np.array([0]))[0]
    assert abs(bound[14] - 0.405) < 0.002 and abs(bound[18] - 0.905) < 0.002 and (bound[:language.LEAST_CLASS] == 0).all()


def test_bounds_of_small_and_large_languages():
    least, n = np.full((2, language.CLASSES), np.inf), np.zeros((2, language.CLASSES), int)
    least[0, 3], n[0, 3], least[0, 12:15], n[0, 12:15] = 0.2, 4, [0.5, 0.6, 0.7], 2000
    least[1, 13], n[1, 13] = 0.4, 5
    got = language.bounds(least, n)
    assert abs(got[0, 24] - 0.7) < 0.002 and abs(got[0, 13] - 0.5) < 0.002 and (got[:, :language.LEAST_CLASS] == 0).all()
    assert abs(got[1, 13] - 0.4) < 0.002 and abs(got[1, 24] - 0.7) < 0.002
    assert (language.bounds(np.full((1, language.CLASSES), np.inf), n[:1] * 0) == 0).all()


@pytest.mark.parametrize("module,label,query,least", [
    (quality, "quality", quality.op6_quality, 0.95), (toxicity, "toxic", toxicity.op9_toxicity, 0.9)])
def test_scores(spark, docs, labels, module, label, query, least):
    rows = {r["doc_id"]: r for r in query(spark, SF).collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows.values())
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    held = [i for i, r in rows.items() if r["held_out"] and i in truth]
    assert np.mean([rows[i]["predicted"] == truth[i] for i in held]) > least
    model = module.fit(docs, labels)
    got = module.score(odd(spark), model).collect()
    assert len(got) == len(ODD) and got[0]["score"] == got[1]["score"] and got[4]["score"] == got[5]["score"]
    empty = module.fit(docs, labels.limit(0))
    assert module.score(odd(spark), empty).count() == len(ODD)
    assert module.score(odd(spark).limit(0), model).count() == 0


def test_terms_are_mined_by_rate(spark):
    rows = [(1, f"awful thing{i}") for i in range(20)] + [(1, f"plain words{i}") for i in range(20)]
    rows += [(0, f"awful case{i}") for i in range(20)] + [(0, f"plain words{i}") for i in range(3000)]
    got = {t: (bad, n) for t, bad, n in toxicity.mine(spark.createDataFrame(rows, "label int, text string"))}
    assert got["awfu*"] == (20, 40) and "awful" not in got  # half of its texts, 75 times the rate; one voter
    assert "plai*" not in got and "plain" not in got

    def word(i):
        return "".join(chr(97 + i // 26 ** k % 26) for k in range(3))

    many = [(1, " ".join(word(i) for i in range(g, g + 10))) for g in range(0, 600, 10) for _ in range(8)] + [(0, "zzz")] * 3000
    got = [t for t, _, _ in toxicity.mine(spark.createDataFrame(many, "label int, text string"))]
    assert set(got) >= {word(0), word(599)} and len(got) == 600  # significant each, none cut


def test_no_term_is_mined_from_chance(spark):
    dice = random.Random(8)
    rows = [(int(dice.random() < 0.1), " ".join(f"{dice.choice('abcd')}{dice.choice('efgh')}word{dice.randrange(4000)}" for _ in range(60)))
            for _ in range(2000)]
    assert toxicity.mine(spark.createDataFrame(rows, "label int, text string")) == []
    assert abs(toxicity.least_g(50) - 10.83) < 0.02  # one in a thousand


def test_terms_of_several_words():
    texts = ["Lostra losty lostrab x", "lostra", None, "", "LOSTRA lostra", "other"]
    assert "lost**" in toxicity.terms_of(texts[0]) and "lost**" not in toxicity.terms_of("lostra Lostra")
    terms = ["lost*", "lost**", "losty", "lostr**", "nothing", "othe*"]
    got = toxicity.Lexicon(terms).votes([(t or "").split() for t in texts])
    assert got == [sorted(i for i, t in enumerate(terms) if t in toxicity.terms_of(x)) for x in texts]
    kept = [t for t, _, _ in toxicity.one_of_each([("lost*", 9, 9, 0.9), ("lostr*", 8, 8, 0.9), ("lostr**", 7, 7, 1.0), ("losty", 3, 3, 0.8)])]
    assert kept == ["lost*", "lostr**"]


def dense(votes):
    return toxicity.Votes([np.flatnonzero(v).tolist() for v in votes], votes.shape[1])


def test_label_model_holds_labels_and_finds_the_rest():
    rng = np.random.default_rng(1)
    truth = (rng.random(4000) < 0.2).astype(float)
    # two kinds of toxic rows with voters of their own, a copied voter, and one that knows nothing
    kind = rng.random(4000) < 0.7
    own = [np.where((truth == 1) & (kind == k), rng.random(4000) < 0.6, rng.random(4000) < 0.02) for k in (True, False) for _ in range(4)]
    votes = np.stack([*own, own[0], rng.random(4000) < 0.1], axis=1)
    votes = np.hstack([votes, ~votes[:, :9].any(axis=1, keepdims=True)])
    known = np.where(rng.random(4000) < 0.3, truth, np.nan)
    post, (zero, one), keep = toxicity.label_model(dense(votes), known, 0.2)
    given = ~np.isnan(known)
    assert (post[given] == truth[given]).all()
    found = (post > 0.5)[~given]
    fires = votes[~given][:, :9].any(axis=1)
    assert np.mean(found[fires] == truth[~given][fires]) > 0.85
    for k in (True, False):  # neither kind is given up
        assert np.mean(found[(truth == 1)[~given] & (kind == k)[~given] & fires]) > 0.8
    assert keep[0] < 0.7 and keep[8] < 0.7 and keep[9] > 0.9 and abs(zero[9] - 0.1) < 0.02


def test_correlations_and_classifier_are_those_of_plain_matrices():
    rng = np.random.default_rng(5)
    v = (rng.random((300, 200)) < 0.1).astype(float)
    post = rng.random(300)
    votes = dense(v)
    one, zero = rng.random(200) * 0.3, rng.random(200) * 0.1
    rest = v - (post[:, None] * one + (1 - post)[:, None] * zero)
    size = np.sqrt((rest ** 2).sum(axis=0))
    agree = rest.T @ rest / np.outer(size, size)
    np.fill_diagonal(agree, 1)
    assert np.allclose(toxicity.shares(votes, post, one, zero), 1 / np.maximum((agree ** 2).sum(axis=0), 1))
    y, weight = (rng.random(300) < 0.3).astype(float), rng.random(300) + 0.5
    w, b = toxicity.classifier(votes, y, weight, ridge=0.5)
    p = 1 / (1 + np.exp(-(v @ w + b)))
    assert np.abs(v.T @ (weight * (p - y)) + 0.5 * w).max() < 1e-4 and abs((weight * (p - y)).sum()) < 1e-4


def test_toxic_documents_of_every_language_are_found(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in toxicity.op9_toxicity(spark, sf).collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    caught = {}
    for r in held:
        if truth[r["doc_id"]] == 1:
            caught.setdefault(lang[r["doc_id"]], []).append(r["predicted"])
    assert set(caught) == {"en", "de", "fr", "es"} and all(np.mean(c) > 0.7 for c in caught.values())
    assert np.mean(sum(caught.values(), [])) > 0.85
    assert np.mean([r["predicted"] for r in held if truth[r["doc_id"]] == 0]) < 0.01


def test_toxicity_of_odd_labels_and_long_texts(spark):
    rows = [(i, f"vile a{i} nasty b{i} brute c{i} words") for i in range(30)] + [(i, f"calm a{i} kind b{i} plain words") for i in range(30, 90)]
    docs = spark.createDataFrame(rows + [(None, "vile"), (91, None), (92, "calm " * 200_000 + "vile nasty brute")], "doc_id long, text string")
    labels = [(i, 1) for i in range(30)] + [(i, 0) for i in range(30, 90)]
    odd = labels + [(None, 1), (91, 1), (3, 0), (4, None), (5, 7), (6, 1)]
    model = toxicity.fit(docs, spark.createDataFrame(odd, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == (i < 30) for i in range(90)) and got[91] == 0 and got[92] == 1
    for none in ([(1, 1)], [(1, None)], [(40, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(none, "doc_id long, toxic int"))
        assert {r["score"] for r in toxicity.score(docs, model).collect()} == {1 / (1 + np.exp(40))}


def test_lstm_gradients():
    rng = np.random.default_rng(2)
    cell = html.Lstm(rng, 3, 4)
    cell.w, cell.u, cell.b = [p.astype(np.float64) for p in (cell.w, cell.u, cell.b)]
    x, mask = rng.standard_normal((5, 2, 3)), np.array([[1, 1]] * 3 + [[1, 0]] * 2, float)
    weight = rng.standard_normal((5, 2, 4))
    loss = lambda: float((cell.forward(x, mask) * weight).sum())
    trace = []
    cell.forward(x, mask, trace)
    for p, g in zip((cell.w, cell.u, cell.b), cell.backward(x, trace, weight)):
        at = tuple(rng.integers(0, n) for n in p.shape)
        old = p[at]
        p[at] = old + 1e-4
        up = loss()
        p[at] = old - 1e-4
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-4 - g[at]) < 1e-2


def test_blocks():
    page = ("<html><head><title>T</title><script>var t='</p>';</script></head><body><!-- <p>no</p> --><p>a  b<b>c</b><br>d<p>e &amp; f"
            "<div class='x y-z' id=main>g<ul><li>h<li><a href='q'>i</a></ul></div><textarea>j</textarea><p title='>'>k</p>l &lt;m&gt; &am")
    blocks = page_blocks(page)
    assert [b[1] for b in blocks] == ["a bc d", "e & f", "g", "h", "i", "j", "k", "l <m> &am"]
    assert blocks[2][0][-1] == ("div", ("main",)) or blocks[2][0][-1][0] == "div"
    assert blocks[4][2] == 1.0 and blocks[0][2] == 0.0
    for cut in range(0, len(page)):
        page_blocks(page[:cut])
    assert page_blocks(None) == page_blocks("") == page_blocks("<p></p>") == [] and page_blocks("<p")[0:] == []


def lines(page):
    return [b[1] for b in page_blocks(page)]


def test_lines_are_not_split_by_what_stands_in_them():
    assert lines("<p>one <img src=x> two</p>") == ["one two"] and lines("<p>super<wbr>cali</p>") == ["supercali"]
    assert lines("<p>a <svg><title>t</title><text>no</text></svg> b</p>") == ["a b"] == lines("<p>a <svg viewBox='0'/> b</p>")
    assert lines("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math> then</p>") == ["if x=2 then"]
    assert lines("<p><ruby>漢<rt>kan</rt></ruby>字</p>") == ["漢kan字"] and lines("<p>a <x-y>b</x-y> c</p>") == ["a b c"]
    assert lines("<p>press <button>OK</button> now</p>") == ["press now"] and lines("<div><button>OK</button>x</div>") == ["OK", "x"]
    assert lines("<p>a <object><p>no</p></object> b</p><p>c") == ["a b", "c"] and lines("<p>a<script>'<p>'</script>b</p>") == ["ab"]
    assert lines("<p>a <video><source src=q>no</video>b") == ["a b"] and lines("<p>x<input>y<p>z") == ["xy", "z"]
    assert lines("a<p>b<div>c<span>d<section>e</section></span>f</div>g") == ["a", "b", "cd", "e", "f", "g"]
    labels = lambda page: html.weak_labels(page_blocks(page))
    assert labels("<article><p>a</p><figure><figcaption>b</figcaption></figure><p class=byline>c</p><div class=ad>d</div></article><figcaption>e") == [
        1, 1, 1, 0, 0]


def test_deep_and_long_pages_take_little_memory():
    import tracemalloc

    model = html.fit_pages([[((("article", ()), ("p", ())), "A line of text.", 0.0)]])
    deep = "".join(f"<div>line {i} of text" for i in range(6_000))
    wide = "<article>" + "<p>line of text</p>" * 20_000 + "</article>"
    tracemalloc.start()
    got = html.texts_of(model, [deep, wide, "<p>x"])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 3 and most < 100 << 20
    # a page read in parts gets the scores of one that is read as a whole
    blocks = page_blocks("<article>" + "".join(f"<p>line {i}</p><div class=ad>buy</div>" for i in range(200)))
    whole = model.scores(html.vectors([blocks]))[0]
    cells, html.CELLS = html.CELLS, 64
    try:
        assert np.abs(model.long_scores(blocks) - whole).max() < 1e-4
    finally:
        html.CELLS = cells


def test_paths_are_nodes_of_one_tree():
    blocks = page_blocks("<div><p>a</p><p>b</p></div><div><p>c</p><p class=other>d</p></div>")
    assert blocks[0][0] is blocks[1][0] is blocks[2][0] and blocks[3][0] is not blocks[0][0]
    assert tuple(blocks[0][0]) == (("div", ()), ("p", ())) and len(blocks[0][0]) == 2
    for path, _, _ in blocks:
        assert np.array_equal(html.path_vector(path), html.path_vector(tuple(path)))


def test_pages(spark):
    rows = html.op3_html(spark, SF).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = [t for p, t, _ in page_blocks(pages[r["page_id"]]) if any(tag == "article" for tag, _ in p)]
        assert r["text"] == "\n".join(article) and r["n_chars"] == len(r["text"])


def test_pages_of_all_kinds(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html.fit(pages)
    long = "<article>" + "".join(f"<p>Line {i} of a long page.</p>" for i in range(20_000)) + "</article>"
    frame = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, " <p> </p>", "a"), (4, long, "a"), (4, long, "a")],
                                  "page_id long, html string, text string")
    got = html.extract(frame, model).collect()
    assert [r["text"] for r in got[:3]] == ["", "", ""] and got[3]["text"] == got[4]["text"]
    assert got[3]["text"].count("\n") == 19_999
    assert html.extract(frame.limit(0), html.fit(frame.limit(0))).count() == 0
