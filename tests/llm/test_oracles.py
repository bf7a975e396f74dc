import duckdb
import pytest

from reliefspark.llm import catalog

KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf)
    want = con.sql(catalog.oracle_sql()[name])
    assert {c: KINDS[t] for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    columns = sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want.project(", ".join(columns)).fetchall()))


def test_names():
    names = set(catalog.queries())
    assert set(catalog.oracle_sql()) <= names and {n.split("_")[0] for n in names - {"shard_law"}} == {f"op{i}" for i in range(1, 11)}
