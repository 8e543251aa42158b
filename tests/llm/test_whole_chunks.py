"""Line chunks that leave no line by itself, against their SQL."""

import duckdb

from wattfleet.llm.line_chunks import dedup_chunks
from wattfleet.llm.queries import ORACLE_SQL, op7_line_dedup_whole

SF = "/root/testdata/sf0.001"


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLE_SQL["op7_line_dedup_whole"]).fetchall()
    got = op7_line_dedup_whole(spark, SF).select("doc_id", "text", "removed_lines").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r[2] for r in want) > 0


def test_copies_go_whole(spark):
    texts = ["\n".join(f"line {k} {i}" for i in range(2 + k)) for k in range(40)]
    df = spark.createDataFrame([(100 * c + k, t) for c in range(2) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in dedup_chunks(df, whole=True).collect():
        k = r.doc_id % 100
        assert (r.text, r.removed_lines) == (("", 2 + k) if r.doc_id >= 100 else (texts[k], 0))
