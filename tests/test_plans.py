"""Plans: what must be narrow, what must not appear anywhere, what is read."""

import re

import pytest

from corpus_checks import derived
from corpus_checks.queries import QUERIES
from maskwright.operators import entities, masking
from maskwright.plans.mask_corpus import mask_corpus
from maskwright.plans.mask_documents import detect_values, mask_documents
from maskwright.sources import files
from maskwright.sources.tables import spread_small

SF = "/root/testdata/sf0.001"
SHUFFLE_FREE = re.compile(r"\bExchange\b")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_masking_a_table_is_narrow_and_reads_two_columns(spark):
    text = plan(mask_documents(stored(spark)))
    assert not SHUFFLE_FREE.search(text)
    assert "Python" not in text and "Arrow" not in text
    assert re.findall(r"ReadSchema: struct<(.*?)>", text) == ["doc_id:bigint,text:string"]


def test_detection_runs_once_per_row(spark):
    for df in (mask_documents(stored(spark)), masking.redact_documents(detect_values(stored(spark)))):
        assert plan(df).count("%+-]++@") == 1


def test_masking_files_is_narrow(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    text = plan(mask_corpus(files.scan_files(spark, str(tmp_path))))
    below = text.index("REPARTITION_BY_NUM")  # the listing's rows, without bytes, are dealt out; then nothing moves
    assert not SHUFFLE_FREE.search(text[:below].rsplit("Exchange", 1)[0]) and text.count("Exchange") == 1
    assert text.count("ArrowEvalPython") == 2 and text.count("MapInArrow") == 1  # reading and unpacking, and writing back
    assert len(text) < 100_000  # nothing is spelled out over and over


def test_entity_table_and_segments_are_narrow(spark):
    found = detect_values(stored(spark))
    assert not SHUFFLE_FREE.search(plan(entities.entities_long(found)))
    lines = derived.lines(found, "values")
    assert not SHUFFLE_FREE.search(plan(masking.redact_segments(lines)))


def test_summary_combines_before_it_shuffles(spark):
    text = plan(entities.corpus_summary(entities.entities_long(detect_values(stored(spark)))))
    assert len(SHUFFLE_FREE.findall(text)) == 2
    assert "partial_count" in text and "Expand" not in text


def test_small_input_is_spread_and_large_is_not(spark):
    docs = stored(spark).select("doc_id", "text")
    assert SHUFFLE_FREE.search(plan(spread_small(spark, docs, "doc_id")))
    assert not SHUFFLE_FREE.search(plan(spread_small(spark, docs.repartition(8), "doc_id")).split("Exchange")[0])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_and_no_single_task(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SinglePartition" not in text
