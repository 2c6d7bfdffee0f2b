"""Every bound query with SQL, against DuckDB on the driver's smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from siftline.plans import bindings

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def rows(df: pd.DataFrame) -> list:
    def put(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not hasattr(v, "item"):
            return str(list(v))
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "null"
        v = v.item() if hasattr(v, "item") else v
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(put, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(bindings.ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = bindings.QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(bindings.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
