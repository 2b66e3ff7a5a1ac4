"""Every query against its SQL on the second engine, at the smallest size."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from sentrygrid.plans import extended, oracles, planted, registry

ORACLE_SQL = oracles.ORACLE_SQL | extended.ORACLE_SQL | planted.ORACLE_SQL
QUERIES = registry.QUERIES | extended.QUERIES | planted.QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out:
        out[c] = out[c].map(lambda v: "" if v is None or v != v else repr(float(v) + 0.0) if isinstance(v, float) else str(v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = canonical(QUERIES[name](spark, str(DATA)).toPandas()), canonical(duck.sql(ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(ORACLE_SQL) <= set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
