import duckdb
import pytest

from sparktap.llm import catalog


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, sf_small)
    cols = sorted(got.columns)
    want = con.sql(catalog.ORACLE[name])
    assert sorted(want.columns) == cols
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in got.collect())
    assert rows == sorted(repr([plain(r[want.columns.index(c)]) for c in cols]) for r in want.fetchall())
