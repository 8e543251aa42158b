"""Near-duplicate groups and nearest neighbours against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_pipeline import groups, shingles
from wattfleet.llm.ann_scan import Space, scan, search
from wattfleet.llm.components import components
from wattfleet.llm.minhash_forest import near_duplicates, sets_of, walk, walked


def same(df, rows, width, percent):
    own = groups([r for r in rows if r[0] is not None], width, percent)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()}
    assert got == {(d, len(shingles(t or "", width)), own.get(d), own.get(d) == d) for d, t in rows}


def test_near_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 400").repartition(5)
    same(near_duplicates(docs, width=2), [(r.doc_id, r.text) for r in docs.collect()], 2, 80)


def test_dense_region(spark):
    """Hundreds of near copies of one text, and some that hang on by one link only; the walks hit their limit."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 8, 9])):
            w[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    same(near_duplicates(df, width=2, reach=2, block=50), rows, 2, 80)


def test_near_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "two words"), (None, "one"), (8, "a b c " * 30_000), (7, "A B C " * 29_999)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_id": F.lit(1), "_key": F.lit("clash"), "kept": F.lit(2)})
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, width=2).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False), 6: (1, 6, True), None: (1, None, True), 8: (3, 7, False), 7: (3, 7, True)}
    assert near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "p q r s t"), (2, "a b c d e f"), (3, "p q r s t"), (3, "p q r s t")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(twice, width=2).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_walk_passes_own_component():
    region = np.array([1] * 9 + [2] * 2)
    comp = np.array([5, 5, 5, -1, 5, 5, 7, 7, 5, 5, 5])
    a, b, full, off = walk(region, comp, np.ones(11, int), 2, 80)
    assert set(zip(a.tolist(), b.tolist())) == {(0, 3), (0, 6), (1, 3), (1, 6), (2, 3), (2, 6), (3, 4), (3, 5), (4, 6), (4, 7), (5, 6), (5, 7), (6, 8), (7, 8)}
    assert set(full.tolist()) == {0, 1, 2, 3} and set(off.tolist()) == {9, 10}


def test_sets_of_texts():
    texts = ["a b c", None, "", " A\tb  c ", "b c a", "one", "É é", "x y " * 5000, "a b"]
    for width in (1, 2, 5):
        sets = [set(x.tolist()) for x in sets_of(pa.array(texts), width)]
        want = [shingles(t or "", width) for t in texts]
        assert [len(x) for x in sets] == [len(x) for x in want]
        assert all((sets[i] & sets[j] == set()) == (want[i] & want[j] == set()) for i in range(len(texts)) for j in range(len(texts)))


@pytest.mark.parametrize("parts", [1, 8])
@pytest.mark.parametrize("count", [5, 2000])
def test_walks_over_partition_ends(spark, parts, count):
    """An outsider behind one region's component: every member meets it or counts as one whose walk didn't end, with partitions empty or full."""
    rows = [(0, b"aaaabbbb", i, 1, 10) for i in range(1, count + 1)] + [(0, b"aaaabbbc", count + 1, None, 10)]
    df = spark.createDataFrame(rows, "_tree int, _sig binary, _id long, _comp long, n_shingles long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = walked(df, 1, 2, 80).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    done = {r.a for r in got if r.b == count + 1} | {r.a for r in got if r.b is None}
    assert done >= set(range(1, count + 1))


def test_link_over_many_partitions(spark):
    """A hot group and single documents that hang on by one link each, in many small partitions."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join([*base, f"own{i % 7}"])) for i in range(300)]
    for i in range(300, 330):  # near one member of a group, not near the rest
        w = list(base)
        for k in rng.sample(range(50), 5):
            w[k] = f"y{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        same(near_duplicates(df, width=2, reach=2), rows, 2, 80)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 250), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(101), 0), 200: 200, 250: 200, 300: 200}


def brute(ids, x, k, every):
    s = np.array([(x * v).sum(1) for v in x])
    out = []
    for i in np.flatnonzero(ids % every == 0):
        order = [j for j in np.lexsort((ids, -s[i])) if j != i][:k]
        out += [(int(ids[i]), r, int(ids[j]), s[i][j]) for r, j in enumerate(order, 1)]
    return out


def test_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want, got = brute(ids, x, 20, 20), search(e, list_size=64).collect()
    assert len(got) == len(want)
    score = {(r.query_id, r.vec_id): r.score for r in got}
    hits = [(q, v) in score for q, _, v, _ in want]
    assert sum(hits) / len(hits) >= 0.9
    assert all(abs(score[q, v] - s) < 1e-12 for q, _, v, s in want if (q, v) in score)
    for q in {r.query_id for r in got}:
        own = sorted((r.rank, -r.score, r.vec_id) for r in got if r.query_id == q)
        assert [o[0] for o in own] == list(range(1, 21)) and [o[1:] for o in own] == sorted(o[1:] for o in own)


def test_few_equal_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(0, 100)] + [(200, [3.0, -1.0]), (220, [0.5, 0.5]), (300, None), (301, [0.0, 0.0]), (302, [nan, 1.0]), (303, [inf, 1.0]), (304, [None, 1.0]), (None, [1.0, 1.0]), (305, [1.0]), (306, []), (220, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "_v": F.lit(2)})
    good = dict(r for r in rows[:102])
    ids, x = np.array(sorted(good)), np.array([good[i] for i in sorted(good)])
    got = sorted((r.query_id, r.rank, r.vec_id) for r in search(df, k=5).collect())
    assert got == sorted(w[:3] for w in brute(ids, x, 5, 20))
    few = df.filter("vec_id IN (0, 1, 200)")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in search(few, k=5).collect()) == [(0, 1, 1), (0, 2, 200), (200, 1, 0), (200, 2, 1)]
    assert search(df.limit(0)).count() == 0 and search(df.filter("vec_id = 0")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_abandons_but_keeps_the_near(seed):
    rng = np.random.default_rng(seed)
    x, q = rng.standard_normal((3000, 64)).astype(np.float32), rng.standard_normal(64).astype(np.float32)
    d = ((x - q) ** 2).sum(1)
    bound = np.sort(d)[20]
    live, _ = scan([x[:, i : i + 16] for i in range(0, 64, 16)], q, bound, 20, 16, 2.1)
    assert len(set(np.flatnonzero(d <= bound)) & set(live)) >= 19 and len(live) < 60
    assert Space(x[:50].astype(float), 12.0, 3).d == 65

def test_query_blocks_and_registered_recall(spark):
    from wattfleet.llm.queries import op6_ann

    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want, got = brute(ids, x, 20, 20), sorted(tuple(r) for r in op6_ann(spark, "/root/testdata/sf0.1").collect())
    assert sorted(tuple(r) for r in search(e, k=20, every=20, block=7).collect()) == got
    found = {(q, v) for q, _, v, _ in got}
    recall = sum((q, v) in found for q, _, v, _ in want) / len(want)
    print(f"recall of op6_ann on sf0.1: {recall:.4f} of {len(want)} neighbours")
    assert recall >= 0.95
