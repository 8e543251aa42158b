"""The pipeline's stages against brute force on a small table."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from test_passages import brute

SF = "/root/testdata/sf0.001"


def shingles(text, width=5):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def groups(rows, width, percent):
    """doc_id -> smallest doc_id reachable."""
    sets = {d: shingles(t or "", width) for d, t in rows}
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: top(d) for d in ids}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(100_001, "123 456", None, None, 7), (100_002, None, "en", "src1", None), (None, "Nothing has an identifier here", "en", "src1", 3)], docs.schema)
    docs = docs.union(junk)
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(steps):
    assert len(cp.STAGES) == 5 and all(s.columns == steps[0].columns for s in steps[1:5])


def test_language_keeps_clean_documents(steps):
    gone = set(texts(steps[0])) - set(texts(steps[1]))
    assert {d for d, _ in gone} >= {100_001, 100_002} and len(gone) <= 4
    assert steps[1].filter("lang IS NULL").count() == 0


def test_exact(steps):
    rows = texts(steps[1])
    last = {}
    for d, t in rows:
        k = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        last[k] = max(last.get(k, -1), -1 if d is None else d)
    assert Counter(d for d, _ in texts(steps[2])) == Counter(None if d == -1 else d for d in last.values())


def test_near(steps):
    rows = texts(steps[2])
    own = groups([r for r in rows if r[0] is not None], 5, 80)
    assert {d for d, _ in texts(steps[3])} == {d for d, r in own.items() if d == r} | ({None} & {d for d, _ in rows})
    assert len(own) > len(set(own.values()))


def test_substrings(steps):
    want = brute(texts(steps[3]))
    got = texts(steps[4])
    before = {(d, len(t)): t for d, t in texts(steps[3])}
    assert sorted((d is not None, d or 0, t) for d, t in got) == sorted((has, d, text) for (has, d, t), (text, _) in want.items())
    assert len(before) == len(got) and steps[4].filter(F.length("text") != F.col("n_chars")).count() == 0


def test_passage_glued_into_lines(spark):
    """A passage of 55 words inside longer lines stays in its first document alone; documents without it stay as they are."""
    say = lambda seed, n: " ".join(f"w{seed}x{i}" for i in range(n))
    rows = [(i, f"{say(i, 20)} {say(99, 55)} {say(i + 10, 30)}\n{say(i + 20, 60)}", "en", "s", 1) for i in range(4)] + [(9, say(50, 90), "en", "s", 2)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = dict(texts(cp.STAGES[3][1](spark, docs, SF)))
    assert got == {0: rows[0][1], 9: rows[4][1]} | {i: f"{say(i, 20)} {say(i + 10, 30)}\n{say(i + 20, 60)}" for i in (1, 2, 3)}


@pytest.mark.parametrize("k", range(5))
def test_stages_on_empty_tables(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert cp.STAGES[k][1](spark, docs, SF).count() == 0


def test_packing_and_run(spark, steps):
    pieces = steps[5]
    assert pieces.select("doc_id").distinct().count() == steps[4].count()
    total = pieces.agg(F.sum("length")).first()[0]
    assert pieces.agg(F.max("sequence_id")).first()[0] == (total - 1) // 2048
    assert cp.run(spark, SF).agg(F.sum("length")).first()[0] <= total


CLASHES = ["score", "lang_pred", "spans", "_id", "_key", "_text", "__row", "kept", "keep_id", "component_id", "removed_spans", "n_removed", "_h", "position", "a b", "n"]


def test_columns_of_any_name_go_along(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHES})
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert out.columns == docs.columns and got, name
        assert all(r[c] == rows[r.doc_id][c] for r in got for c in CLASHES), name
    assert cp.packing(spark, docs, SF).count() >= 60
