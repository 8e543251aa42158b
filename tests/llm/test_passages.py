"""Passage dedup against a comparison of all runs of 50 words in plain Python."""

import random
import re
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattfleet.llm.passages import dedup_passages

WORD = re.compile("[0-9A-Za-z\u00c0-\u1fff\u2070-\u2fff\u3040-\U0010ffff]+")
LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def spans_of(text, gone):
    words = [m.span() for m in WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    spans = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        start, end = words[a][0], words[b - 1][1]
        follows = words[b][0] if b < len(words) else len(text)
        while end < follows and text[end] != "\n":
            end += 1
        if end < len(text) and text[end] == "\n" and (start == 0 or text[start - 1] == "\n"):
            end += 1
        spans.append((start, end))
    return spans


def brute(rows, n=50):
    first, out = {}, {}
    cuts = {}
    places = []
    for has, d, t in {(d is not None, d or 0, t) for d, t in rows if t is not None}:
        w = [x.translate(LOWER) for x in WORD.findall(t)]
        cuts[has, d, t] = np.zeros(len(w), bool)
        places += [(has, d, p, t, tuple(w[p : p + n])) for p in range(len(w) - n + 1)]
    for has, d, p, t, run in sorted(places, key=lambda x: x[:3]):
        if run not in first:
            first[run] = (has, d, t, p)
        else:
            *doc, q = first[run]
            start = max(p, q + n) if tuple(doc) == (has, d, t) else p
            cuts[has, d, t][start : p + n] = True
    for (has, d, t), gone in cuts.items():
        spans, left, at = spans_of(t, gone), "", 0
        for a, b in spans:
            left, at = left + t[at:a], b
        out[has, d, t] = (left + t[at:], ",".join(f"{a}-{b}" for a, b in spans))
    return out


def test_passages(spark):
    r = random.Random(5)
    say = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    passage, edge, short, near = say(70), say(50), say(49), say(300)
    in_lines = passage.replace(" ", "\n", 30)
    rows = [
        (1, f"{say(30)} {passage} {say(40)}"), (2, f"{say(20)} {passage.upper()}, {say(60)}"), (3, f"{say(3)}\n{in_lines}.\n{say(9)}"),
        (4, f"{say(8)} {edge} {say(8)}"), (5, f"{edge}. {say(5)}"), (6, short), (7, f"{say(2)} {short}"), (8, "la " * 200), (9, "la " * 120),
        (10, near), (11, near.replace(near.split()[150], "changed")), (12, None), (13, ""), (None, f"x {passage}"), (14, near), (14, near), (15, f"{say(60)} {say(60)}"), (16, f"{edge} {edge} {edge}"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"whole": F.col("text"), "_id": F.lit("clash")}).repartition(3)
    want, got = brute(rows), dedup_passages(df).collect()
    assert len(got) == len(rows)
    for x in got:
        if x.whole is None:
            assert x.text is None and x.removed_spans == ""
        else:
            assert (x.text, x.removed_spans) == want[x.doc_id is not None, x.doc_id or 0, x.whole], x.doc_id
            assert x.n_removed == len([s for s in x.removed_spans.split(",") if s])
    left = {x.doc_id: x.text for x in got}
    # the same passage inside a longer line, in capitals, and as lines of few words is gone but for its first place
    assert passage in left[None] and all(p.split()[35].lower() not in left[d].lower().split() for d in (1, 2, 3) for p in [passage])
    assert left[6] == short and left[7].endswith(short) and left[14] == "" and edge not in left[5]
    assert dedup_passages(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("min_words", [5, 8])
def test_any_overlaps(spark, seed, min_words):
    """Short passages over a small alphabet: copies of copies, cut and glued, repeats within a text, other scripts and signs."""
    r = random.Random(seed)
    signs = [" ", " ", " ", ", ", "\n", ".\n", " \u2014 ", "\u00a0", "\u3000", "\n\n"]
    say = lambda n: [r.choice(["a", "B", "b", "\u00e9", "x1", "\u65e5", "\u0416", "w%d" % r.randrange(30)]) for _ in range(n)]
    pool = [say(r.randrange(4, 40)) for _ in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(r.randrange(1, 5)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            w += p[a : a + r.randrange(1, 40)] if r.random() < 0.7 else say(r.randrange(20))
        pool.append(w)
        rows.append((i if r.random() < 0.95 else None, "".join(x + r.choice(signs) for x in w)))
    want = brute(rows, min_words)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("whole", F.col("text")).repartition(4)
    for x in dedup_passages(df, min_words=min_words).collect():
        assert (x.text, x.removed_spans) == want[x.doc_id is not None, x.doc_id or 0, x.whole], (x.doc_id, x.whole)
