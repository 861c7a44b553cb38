import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 100


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
def test_flagship(spark):
    row = entry.entry(spark).first()
    assert row["n_masked_target"] == 150 and 0.9 < row["mean_nrmse"] < 1.1
