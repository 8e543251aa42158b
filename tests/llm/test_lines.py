"""Exact dedup, line chunks and substring dedup against plain Python, on odd rows too."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wattfleet.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from wattfleet.llm.line_chunks import dedup_chunks
from wattfleet.llm.substring_dedup import dedup_substrings, normalised, units_of, without

LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (5, "Same Text"), (1, "same text"), (9, "SAME TEXT"), (2, None), (3, ""), (4, "É"), (6, "é"), (None, "same text"), (None, "alone"), (7, "alone too"), (7, "alone too"),
    (10, f"intro\n{LONG}\nend"), (11, f"{LONG.upper()}!\nother"), (12, f"{LONG}\n{LONG}"), (13, "a\nb\nc\nd\n" * 50), (14, "a\nb\nc\nd\n" * 50), (15, "\n\n\n"), (16, "x" * 500_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"_id": F.lit("clash"), "kept": F.lit(1), "_lost_id": F.lit(5), "_lost_sha": F.lit("clash"), "_row": F.lit(2), "n_removed": F.lit(3)}).repartition(3)


def lower(s):
    return "".join(c.lower() if c.isascii() else c for c in s or "")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact(odd, keep):
    groups = defaultdict(list)
    for d, t in ROWS:
        groups[lower(t)].append(d)
    want = []
    for d, t in ROWS:
        own = [x for x in groups[lower(t)] if x is not None]
        k = (max if keep == "largest" else min)(own, default=None)
        want.append((str(d), str(k), len(groups[lower(t)]), d == k, hashlib.sha256(lower(t).encode()).hexdigest()))
    got = [(str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_duplicates(odd, keep=keep).collect()]
    assert sorted(got) == sorted(want)
    left = drop_exact_duplicates(odd, keep=keep)
    assert left.columns == odd.columns
    assert sorted((str(r.doc_id), lower(r.text)) for r in left.collect()) == sorted((w[0], lower(t)) for w, (_, t) in zip(want, ROWS) if w[3])
    assert exact_duplicates(odd.limit(0)).count() == 0


def test_exact_plan_merges_sorted_runs(odd):
    plan = exact_duplicates(odd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") >= 4 and "HashAggregate" not in plan and "Python" not in plan and "Arrow" not in plan


def test_exact_hot_group(spark):
    df = spark.range(0, 4000, 1, 37).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_duplicates(df).filter("text_sha256 = '%s'" % hashlib.sha256(b"hot").hexdigest())
    assert out.agg(F.count("*"), F.min("group_size"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()[:] == (1334, 1334, 3999, 1)


def brute_lines(rows, min_words):
    seen, out = set(), {}
    for has, d, t in sorted({(d is not None, d or 0, t) for d, t in rows if t is not None}):
        gone = []
        for start, end in units_of(t):
            n = normalised(t[start:end])
            if len(n.split()) >= min_words:
                if n in seen:
                    gone.append((start, end))
                seen.add(n)
        out[has, d, t] = ("\n".join(t[a:b] for a, b in units_of(t) if (a, b) not in gone), ",".join(f"{a}-{b}" for a, b in gone))
    return out


@pytest.mark.parametrize("min_words", [1, 25])
def test_substrings(spark, odd, min_words):
    # rows equal in identifier and text are one document, and null identifiers come first
    got = dedup_substrings(odd.withColumn("whole", F.col("text")), min_words=min_words).collect()
    want = brute_lines(ROWS, min_words)
    assert len(got) == len(ROWS)
    for r in got:
        if r.whole is None:
            assert r.text is None and r.removed_spans == ""
        else:
            assert (r.text, r.removed_spans) == want[r.doc_id is not None, r.doc_id or 0, r.whole], r.doc_id
    assert dedup_substrings(odd.limit(0)).count() == 0


def test_paragraphs():
    t = "a b\nc\n\n  \nd\n\ne"
    assert [t[a:b] for a, b in units_of(t, "paragraph")] == ["a b\nc", "d", "e"]
    assert without(t, [(10, 11)], "paragraph") == "a b\nc\n\ne"


def brute_chunks(rows, divisor=4):
    seen, out = set(), {}
    for has, d, t in sorted({(d is not None, d or 0, t) for d, t in rows if t is not None}):
        lines = t.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:14], 16) for x in lines]
        chunks, now = [], []
        for i in range(len(lines)):
            now.append(lines[i])
            rolled = h[i] ^ (h[i - 1] << 1 if i > 0 else 0) ^ (h[i - 2] << 2 if i > 1 else 0)
            if rolled % divisor == 0 or i == len(lines) - 1:
                chunks.append(now)
                now = []
        kept, gone = [], 0
        for c in chunks:
            if len(c) > 1 and tuple(c) in seen:
                gone += len(c)
            else:
                kept += c
            seen.add(tuple(c))
        out[has, d, t] = "\n".join(kept), gone
    return out


def test_chunks(odd):
    got = dedup_chunks(odd.withColumn("whole", F.col("text"))).collect()
    want = brute_chunks(ROWS)
    assert len(got) == len(ROWS)
    for r in got:
        if r.whole is not None:
            assert (r.text, r.removed_lines) == want[r.doc_id is not None, r.doc_id or 0, r.whole], r.doc_id
    assert sum(r.removed_lines for r in got) > 100
    assert dedup_chunks(odd.limit(0)).count() == 0
