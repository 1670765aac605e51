"""Every registered query with an oracle equals its DuckDB SQL (sf0.001 here; the driver uses sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tulkki.plans.catalog import CATALOG
from tulkki.plans.checkdata import TABLES

SF = "/root/testdata/sf0.001"


def _canon(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_canon(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(set(CATALOG) & set(E.oracle_sql())))
def test_query_matches_oracle(spark, con, name):
    s = _rows(E.queries()[name](spark, SF).toPandas())
    d = _rows(con.sql(E.oracle_sql()[name]).df())
    assert s[0] == d[0]
    assert s[1] == d[1]


@pytest.mark.parametrize("name", sorted(set(CATALOG) - set(E.oracle_sql())))
def test_queries_without_sql_give_rows(spark, name):
    df = E.queries()[name](spark, SF)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    for c in {"WER", "WIL", "METEOR", "TER", "wer", "wil"} & set(df.columns):
        assert all(r[c] is None or r[c] >= 0 for r in rows)


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"Language", "Model", "Condition_Code", "mean_wer", "mean_wil", "high_wer_share", "n_files"}
    for r in rows:
        assert 0 <= r["mean_wer"] and 0 <= r["mean_wil"] <= 1 and 0 <= r["high_wer_share"] <= 1
