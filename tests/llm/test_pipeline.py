"""Every stage of the pipeline against a plain version of it, on its own input."""

import hashlib

import pytest
import tiktoken

import corpus_pipeline
from maskwright.llm import language, quality
from maskwright.llm import decontamination as dc
from tests.llm.test_models import odd_texts
from tests.llm.test_simhash import roots, slow_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Short documents, planted copies, rejects and benchmark passages, repeated and odd rows."""
    root = str(tmp_path_factory.mktemp("pipeline"))
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"] and len(r["text"]) < 1200]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(8).collect()]
    plain = [r for r in docs if r["lang"] == "en" and len(r["text"]) > 300]
    rows = [tuple(r) for r in docs]
    new = lambda i, text, lang="en": (i, text, lang, "planted", len(text or ""))
    rows += [new(100_000 + i, r["text"]) for i, r in enumerate(plain[:5])]  # exact copies
    rows += [new(100_100 + i, r["text"] + " the") for i, r in enumerate(plain[:5])]  # near copies
    rows += [new(100_200, None), new(100_201, ""), new(100_202, "12345 !!! ###")]
    rows += [new(100_300 + i, f"{plain[i + 5]['text'][:200]} {item.upper()} {plain[i + 6]['text'][:200]}") for i, item in enumerate(items[:4])]
    rows += [rows[0], new(None, plain[12]["text"][:250])]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{root}/labels.parquet")
    items_frame = spark.createDataFrame(list(enumerate(items)) + [(90, None), (91, "")], "item_id long, text string")
    items_frame.write.parquet(f"{root}/benchmark.parquet")
    return root


@pytest.fixture(scope="module")
def steps(spark, folder):
    """(name, rows in, rows out, frame in) of each stage, one after the other as `run` does."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        made.write.parquet(path)
        after = spark.read.schema(made.schema).parquet(path)
        out.append((name, docs.collect(), after.collect(), docs))
        docs = after
    return {name: rest for name, *rest in out}


def ids(rows):
    return sorted([r["doc_id"] for r in rows], key=lambda i: (i is None, i))


def test_names_and_columns(steps):
    assert list(steps) == ["language_id", "quality", "near_duplicates", "decontamination", "byte_bpe"]
    for name in list(steps)[:-1]:
        assert steps[name][1][0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}
        kept = {tuple(r) for r in steps[name][1]}
        assert kept <= {tuple(r) for r in steps[name][0]}  # rows are kept as they are


def test_language_stage(steps):
    before, after, frame = steps["language_id"]
    model = language.fit(frame)
    assert ids(after) == ids([r for r in before if not model.predict([r["text"]])[2][0]])
    gone = set(ids(before)) - set(ids(after))
    assert gone >= {100_200, 100_201, 100_202} and len(gone) < 10


def test_language_stage_drops_odd_rows_that_carry_a_learnt_language(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(200_000 + i, text, ["de", "en", "es", "fr"][i % 4], "odd", len(text)) for i, text in enumerate(odd_texts(4))]
    kept = corpus_pipeline.language_stage(spark, frame.unionByName(spark.createDataFrame(rows, frame.schema)), SF)
    assert ids(kept.collect()) == ids(frame.collect())


def test_quality_stage(spark, steps, folder):
    before, after, frame = steps["quality"]
    model = quality.fit(frame, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = quality.score(frame, model).collect()
    assert ids(after) == ids([r for r in scores if r["predicted"] == 1])
    good = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r["quality"] == 1}
    there = good & set(ids(before))
    assert len(there & set(ids(after))) > 0.9 * len(there)


def test_near_duplicate_stage(steps):
    before, after, _ = steps["near_duplicates"]
    prints = {r: slow_fingerprint(r["text"]) for r in set(before)}
    names = sorted(set(prints.values()))
    linked = [(a, b) for i, a in enumerate(names) for b in names[i + 1:] if bin(a ^ b).count("1") <= 2]
    group = roots(names, linked)
    least = {}
    for r, p in prints.items():
        if r["doc_id"] is not None:
            least[group[p]] = min(r["doc_id"], least.get(group[p], r["doc_id"]))
    named = [i for i in ids(after) if i is not None]
    assert named == sorted(least.values()) and len(named) < len({r["doc_id"] for r in before}) - 4
    assert [r["doc_id"] for r in before].count(None) == [r["doc_id"] for r in after].count(None)


def test_decontamination_stage(spark, steps, folder):
    before, after, _ = steps["decontamination"]
    items = [dc.plain(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r["text"]]
    looks = [(dc.bits_of(item), len(item)) for item in items if item]

    def hit(text):  # every item at every place, with no pieces in between
        shown = dc.plain(text)
        return any(dc.least_distance(bits, size, shown)[0] <= int(size * dc.BUDGET) for bits, size in looks)

    assert ids(after) == ids([r for r in before if not hit(r["text"])])
    planted = {i for i in ids(before) if i is not None and 100_300 <= i < 100_304}
    assert planted and not planted & set(ids(after))


def test_encoding_stage(steps):
    before, after, _ = steps["byte_bpe"]
    import public_tokenizers
    from tiktoken.load import load_tiktoken_bpe

    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    want = []
    for r in before:
        tokens = plain.encode_ordinary(r["text"] or "")
        packed = b"".join(t.to_bytes(4, "little") for t in tokens)
        want.append((r["doc_id"], len(tokens), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(want, key=str) == sorted([(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after], key=str)


def test_run_and_empty_table(spark, steps, folder, tmp_path):
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, steps["byte_bpe"][1]), key=str)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    none = corpus_pipeline.run(spark, str(tmp_path))
    assert none.columns == got.columns and none.count() == 0
