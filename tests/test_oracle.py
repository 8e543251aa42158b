"""Every registered telemetry query against its SQL in DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from wattfleet import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(f: pd.DataFrame) -> list[tuple]:
    f = f[sorted(f.columns)]
    def text(v):
        if pd.isna(v):
            return "-"
        return f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(tuple(map(text, row)) for row in f.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = norm(got), norm(want)
    assert len(a) == len(b) and a == b


def test_all_have_sql():
    assert set(plans.QUERIES) == set(plans.SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
