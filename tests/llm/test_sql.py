"""Queries against their SQL on the smallest tables."""

import pytest

from loomgraph.llm import entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_equals_sql(spark, name):
    compare(entry.QUERIES[name](spark, SF), duck(SF), entry.ORACLES[name])


def test_bpe_over_the_table(spark):
    assert entry.QUERIES["op1_bpe"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
