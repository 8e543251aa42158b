"""Exact dedup down to one row of each text, and the pipeline's stages over it."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from wattfleet.llm.exact_dedup import drop_exact_duplicates

ROWS = [(1, "A b", 1), (1, "a b", 2), (1, "a b", 2), (0, "a b", 9), (None, "none", 3), (None, "None", 4), (None, "none", 3), (2, "own", 5), (3, None, 6), (3, "", 6), (4, "c", 7), (5, "c", 8)]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_one_row_of_each_text(spark, keep):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, extra int").repartition(4)
    out = drop_exact_duplicates(df, keep=keep, one_row=True)
    rows = [tuple(r) for r in out.collect()]
    assert out.columns == df.columns and set(rows) <= set(ROWS)
    ids = {"a b": 1, "none": None, "own": 2, "": 3, "c": 5} if keep == "largest" else {"a b": 0, "none": None, "own": 2, "": 3, "c": 4}
    assert len(rows) == 5 and {(t or "").lower(): d for d, t, _ in rows} == ids
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in drop_exact_duplicates(df.repartition(2), keep=keep, one_row=True).collect())


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert cp.exact(spark, docs.union(docs), sf).groupBy(F.lower("text")).count().filter("count > 1").count() == 0
    words = " ".join(f"w{i}" for i in range(60))
    two = spark.createDataFrame([(i, " ".join(f"d{i}x{j}" for j in range(200)) + f" {words} end", "en", "s", 1) for i in (1, 2)], docs.schema)
    left = cp.near(spark, two, sf)
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, two.collect()))
    out = {r.doc_id: r for r in cp.substrings(spark, left, sf).collect()}
    assert words in out[1].text and "w30" not in out[2].text and out[2].n_chars == len(out[2].text)
