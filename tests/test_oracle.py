"""Every query of the catalogue against its SQL."""

from __future__ import annotations

import pytest
from helpers import of_duck, of_spark

from spanforge.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, duck, sf_dir):
    assert of_spark(QUERIES[name](spark, sf_dir)) == of_duck(duck, ORACLES[name])


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[:3] == ["name", "src_file", "src_line"] and df.count() > 0
