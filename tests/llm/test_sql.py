"""Every query of the subpackage that has SQL against it."""

import pytest

import check_oracles
from maskwright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    assert name in QUERIES and check_oracles.compare(spark, check_oracles.connect(SF), name, SF) is None
