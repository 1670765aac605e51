"""Queries with DuckDB SQL equal it on sf0.001."""

import duckdb
import pytest

from tulkki.llm.catalog import ORACLES, QUERIES

TINY = "/root/testdata/sf0.001"


def rows(pdf):
    cols = sorted(pdf.columns)
    clean = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    return cols, sorted((tuple(x.item() if hasattr(x, "item") else int(x) if isinstance(x, float) else x for x in r) for r in clean.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{TINY}/{t}.parquet')")
    assert rows(QUERIES[name](spark, TINY).toPandas()) == rows(con.sql(ORACLES[name]).df())
