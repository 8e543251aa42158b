"""Spelling variants against brute force."""

import collections
import itertools
import random
import re
import zlib

import pytest

from wattfleet.llm import spelling


def counts_of(rows, noise=97):
    n = collections.Counter()
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    near = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("bits", [2, 13])
@pytest.mark.parametrize("noise", [3, 97])
def test_brute_force(spark, monkeypatch, bits, noise):
    monkeypatch.setattr(spelling, "BLOCK_BITS", bits)
    monkeypatch.setattr(spelling, "QUERIES", 5)
    rng = random.Random(noise + bits)
    words = ["".join(rng.choice("abÀÿ×") for _ in range(rng.randrange(4, 10))) for _ in range(60)]
    rows = [(i or None, " ".join(rng.choice(words) if rng.random() < 0.9 else rng.choice(words).upper() for _ in range(rng.randrange(30))) + rng.choice(["", "1a", "漢字-aaaaa"])) for i in range(120)]
    rows += [(5, None), (6, ""), (7, "abcab " * 50), (7, "abcab " * 50), (8, "z" * 3000 + " " + "z" * 2999 + "y"), (9, "z" * 3000 + " " + "z" * 2999 + "y"), (10, "z" * 3000 + " " + "z" * 2999 + "y")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    assert found(spelling.spelling_variants(df, noise=noise)) == brute(counts_of(rows, noise))


def test_a_prefix_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_BITS", 3)
    rng = random.Random(1)
    words = sorted({"prefix" + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(300)} | {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) + "suffix" for _ in range(100)})
    rows = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(60)]
    assert found(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(counts_of(rows))


def test_chains_and_ties(spark):
    n = {"aaaaa": 64, "aaaab": 32, "aaabb": 16, "aabbb": 8, "abbbb": 4, "xyzab": 3, "xyzac": 6, "xyzad": 6, "lonely": 3}
    rows = [(1, " ".join(f"{w} " * k for w, k in n.items()))]
    got = found(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), noise=0))
    assert got == brute(n) and got["abbbb"][1] == "aaaaa" and got["xyzab"][0] == "xyzac"


def test_empty(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
