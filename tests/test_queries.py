"""Every query with SQL equals its SQL; the others run and have rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from verdance.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Queries that may be empty on the smallest tables.
MAY_BE_EMPTY = {"frame_detection"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def cell(v):
    if v is None or (not isinstance(v, (list, np.ndarray)) and pd.isna(v)):
        return "-"
    if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool):
        return f"{float(v) + 0.0:.6f}".replace("-0.000000", "0.000000")
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)


def rows(pdf):
    return sorted(tuple(cell(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLES[name])
    assert {c: KINDS.get(k, k) for c, k in got.dtypes} == dict(zip(want.columns, map(str, want.types)))
    assert rows(got.toPandas()) == rows(want.df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    got = catalogue.QUERIES[name](spark, SF)
    assert got.count() > 0 or name in MAY_BE_EMPTY


def test_sweep_of_images_the_table_cuts_off(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < 12 AND vec_id % 4 <= vec_id // 4) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = catalogue.QUERIES["resample_sweep"](spark, str(tmp_path))
    assert rows(got.toPandas()) == rows(con.sql(catalogue.ORACLES["resample_sweep"]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
