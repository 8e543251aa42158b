"""Every registered query of the subpackage that has SQL, against it in DuckDB."""

import duckdb
import pytest

from wattfleet.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_registered(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    rows = lambda found: sorted(tuple("-" if v is None else str(v) for v in r) for r in found)
    assert rows(got.select(names).collect()) == rows([r[i] for i in at] for r in want.fetchall())
