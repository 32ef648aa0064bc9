import os

import duckdb
import pytest

from verdance.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_sql(spark, name, sf):
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall() if hasattr(want, "fetchall") else want.df().itertuples(index=False, name=None))
