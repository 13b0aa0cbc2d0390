"""What SQL can state of the operators, on the same tables."""

from __future__ import annotations

import duckdb
import pytest

from sheaf.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    shown = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)))
    want = duck.sql(queries.oracle_sql()[name]).df()
    assert shown(queries.queries()[name](spark, SF).toPandas()) == shown(want) and len(want)
