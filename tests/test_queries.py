"""Each query of the reference's operators gives the rows of its SQL."""

import duckdb
import pandas as pd
import pytest

from tallyworks.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cell = lambda v: None if v is None or v is pd.NaT or (not isinstance(v, str) and pd.isna(v)) else round(float(v), 6) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind in "fiu" or isinstance(v, int) and not isinstance(v, bool) else str(v)[:19]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = db.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
