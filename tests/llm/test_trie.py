"""The conversation trie and its scans against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from wattfleet.llm import conversation_trie as ct
from wattfleet.llm.segmented_scan import running

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Rows (conv, turn, role, text) to the trie's nodes; convs of no turn can only be those whose head and rest are empty."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in convs.items()}
    members, paths = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c - 100 * int(c / 100))
        path = paths[c] = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out, children, leaves, saved = [], {}, {}, {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in children)
            saved[p[:d]] = saved.get(p[:d], 0) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select(NAMES).collect())


def made(seed, n=120, texts=3):
    rng, rows = random.Random(seed), []
    for c in range(-30, n):
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([0, 1, 2, 3, 6, 9])):
            rows.append((c, t or None, rng.choice(["user", "user", None]), rng.choice([None, "", "é" * 3, "ab", "x" * 50][:texts + 2])))
    long = [(7, t, "user", rng.choice("ab")) for t in range(1, 400)]
    rows = [r for r in rows if r[0] not in (7, 57)] + long + [(57, *r[1:]) for r in long]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 7), (3, 23)])
def test_brute_force(spark, seed, partitions):
    rows = made(seed)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions < 20)
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(partitions)
        # other columns and clashing names don't matter, nor do rows without an identifier
        df = df.withColumns({"conv": F.lit("x"), "depth": F.lit(1), "chars": F.lit(None).cast("int")}).unionByName(spark.createDataFrame([(None, 1, "user", "lost")], "conv_id long, turn long, role string, text string"), allowMissingColumns=True)
        assert found(ct.prefix_trie(df)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pieces_of_ends(spark, monkeypatch):
    monkeypatch.setattr(ct, "PIECE", 7)
    rows = [(c, 0, "user", "same") for c in range(1, 200)]
    assert found(ct.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == brute(rows)


def test_unequal_prefixes_are_found_and_told_apart(spark, monkeypatch):
    real, asked = ct.multipliers, []

    def weak(attempt):
        asked.append(attempt)
        return [1, 1, 1] if not attempt else real(attempt)

    monkeypatch.setattr(ct, "multipliers", weak)
    # with x = 1 a polynomial is a sum: the same turns in another order have the same fingerprint
    rows = [(c, t, "user", "ab"[(t + c // 100) % 2]) for c in (100, 200) for t in range(12)]
    assert found(ct.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == brute(rows) and asked == [0, 1]


def test_empty(spark):
    assert ct.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_role_and_text_are_kept_apart(spark):
    rows = [(100, 1, "a", "bc"), (200, 1, "ab", "c"), (300, 1, None, "abc"), (400, 1, "", "abc"), (500, None, "é", None)]
    assert found(ct.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == brute(rows)


@pytest.mark.parametrize("partitions", [1, 9])
def test_running(spark, partitions):
    rng = random.Random(partitions)
    rows = [(k, i, rng.randrange(97), rng.randrange(1000)) for k, n in ((1, 700), (2, 3), (3, 1), (4, 250)) for i in range(n)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        out = running(spark.createDataFrame(rows, "k long, i long, t long, w long").repartition(5), "k", ["i"], {"t": (5, 97), "w": None})
        got = {(r.k, r.i): (r.position, r.t_run, r.w_run) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    t, w, last = 0, 0, None
    for k, i, a, b in sorted(rows):
        t, w, last = (t, w, k) if k == last else (0, 0, k)
        t, w = (t + a * pow(5, i, 97)) % 97, w + b
        assert got[k, i] == (i, t, w)
