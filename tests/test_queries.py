"""Every query of the catalog against its SQL in DuckDB."""

import math

import duckdb
import pytest

from reliefspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "events embeddings orders part".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    want_rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want_rel.columns) == columns
    kinds = dict(zip(want_rel.columns, map(str, want_rel.types), strict=True))
    same = {"bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}
    assert {c: same[t] for c, t in df.dtypes} == kinds
    want = sorted(want_rel.project(", ".join(columns)).fetchall(), key=str)
    assert len(got) == len(want) > 0
    for g, w in zip(got, want, strict=True):
        assert all(a == b or (isinstance(a, float) and math.isclose(a, b, abs_tol=1.01e-6)) for a, b in zip(g, w, strict=True)), (g, w)
