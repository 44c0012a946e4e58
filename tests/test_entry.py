"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import check_oracles
from corpus_checks.oracles import ORACLES
from corpus_checks.queries import QUERIES, infer_pii_chunks

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return check_oracles.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert check_oracles.compare(spark, con, name, SF) is None


def test_short_pieces_give_whole_values(spark, con):
    """Pieces far shorter than most texts; many values are longer than their overlap."""
    short = lambda spark, sf: infer_pii_chunks(spark, sf, size=60, overlap=10, reach=48)
    assert check_oracles.compare(spark, con, "infer_pii_chunks", SF, short) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", ["mask_stream", "mask_stream_by_model", "mask_stream_by_dictionary", "mask_stream_by_dictionary_in_scan"])
def test_streams_of_a_table_in_many_files(spark, fresh, name):
    """A table is one file or a folder of files."""
    root = fresh("tables")
    rows = [(i, f"call (03) 1234-567{i} or write to a{i}@b.example", "en", "src0", 40) for i in range(6)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(0, "nothing of this")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    got = QUERIES[name](spark, root).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(6)) and all(r["n_values"] > 0 for r in got)
