"""Every query that has SQL is held against DuckDB on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from tandem.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cell(x):
    if x is None or x != x:
        return None
    if hasattr(x, "isoformat"):
        return x.isoformat()[:26].replace("T", " ").removesuffix("+00:00")
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return f"{float(x) + 0.0:.5f}"
    return str(x)


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(cell(v) if not isinstance(v, int) or isinstance(v, bool) else str(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))


def floats_as(frame, other):
    """An integer column that one side gives as float is compared as float."""
    out = frame.copy()
    for c in out.columns:
        if other[c].dtype.kind == "f" and out[c].dtype.kind in "iu":
            out[c] = out[c].astype(float)
    return out


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(floats_as(got, want)) == rows(floats_as(want, got))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    assert len(got) and not got.isna().all().any()  # rows, and no column of nulls; the results are held against loops elsewhere
