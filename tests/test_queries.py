"""Every query of the recording engine against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from sparkwave import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in "nation customer supplier part orders lineitem events conversations".split():
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", queries.QUERIES)
def test_matches_sql(spark, duck, name):
    found, wanted = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    found, wanted = (x[columns].sort_values(columns, ignore_index=True) for x in (found, wanted))
    pd.testing.assert_frame_equal(found, wanted, check_dtype=False, rtol=1e-12)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
