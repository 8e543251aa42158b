"""Order MinHash against a plain form, and its neighbours against sorting by hand."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattfleet.llm import order_minhash as om


def plain(text, width, hashes, picks):
    """The selected k-mers of every hash function, in text order."""
    kmers = [text[i : i + width] for i in range(len(text) - width + 1)] or ([text] if text else [])
    seen, x = {}, om.numbered(om.codes_of(text), width).tolist()
    assert len(x) == len(kmers)
    ids = [(k, seen.setdefault(k, []).append(0) or len(seen[k])) for k in kmers]
    # equal numbered k-mers have equal hashes, different ones different
    assert len(set(ids)) == len(set(x)) == len({*zip(ids, x)})
    out = []
    for j in range(hashes):
        value = [((h & 0xFFFFFFFF) ^ int(om._XOR[j])) * int(om._ODD[j]) & 0xFFFFFFFF for h in x]
        out.append(tuple(ids[i] for i in sorted(sorted(range(len(x)), key=lambda i: (value[i], i))[:picks])))
    return out


@pytest.mark.parametrize("block", [7, 8192])
def test_components_agree_where_selections_do(monkeypatch, block):
    monkeypatch.setattr(om, "BLOCK", block)
    rng = random.Random(block)
    texts = ["", "a", "ab", "abc", "abcabcabcabc", "é漢😀" * 5, *("".join(rng.choice("ab c") for _ in range(rng.randrange(60))) for _ in range(12))]
    texts += [t[: len(t) // 2] + "x" + t[len(t) // 2 :] for t in texts]
    prints = [om.order_minhash(om.codes_of(t), 3, 16, 2) for t in texts]
    picked = [plain(t, 3, 16, 2) for t in texts]
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert (prints[a] == prints[b]).tolist() == [x == y for x, y in zip(picked[a], picked[b])], (texts[a], texts[b])


def test_order_counts():
    rng = random.Random(2)
    parts = ["".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(10)]
    a, b = om.order_minhash(om.codes_of("".join(parts))), om.order_minhash(om.codes_of("".join(parts[::-1])))
    near = om.order_minhash(om.codes_of("".join(parts[:5] + ["x"] + parts[5:])))
    assert om.likeness(a, near) > 0.8 and om.likeness(a, b) < om.likeness(a, near) - 0.2


@pytest.mark.parametrize("partitions", [1, 5])
def test_neighbours(spark, partitions):
    rng = random.Random(partitions)
    rows = [(i * 3 - 50, "".join(rng.choice("ab cdé😀") for _ in range(rng.choice([0, 1, 5, 40, 200])))) for i in range(60)]
    rows += [(1000, None), (1001, "x" * 200_000), (1002, "same text here"), (1003, "same text here")]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, _range string, n_chars int").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.doc_id: r for r in om.edited_fingerprints(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    text = {i: t or "" for i, t in rows}
    order = sorted(text, reverse=True)
    make = lambda t: om.order_minhash(om.codes_of(t))
    for i, j in zip(order, [*order[1:], order[0]]):
        half = len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + text[j][:half]
        r = got.pop(i)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text[i]), hashlib.sha256(edited.encode()).hexdigest(), om.hexed(make(text[i])), om.hexed(make(edited)))
        assert (r.near_edited, r.near_next) == (om.likeness(make(text[i]), make(edited)), om.likeness(make(text[i]), make(text[j])))
    assert not got


def test_one_row_and_odd_rows(spark):
    one = om.edited_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1.0
    odd = spark.createDataFrame([(None, "x"), (None, "y"), (None, "x"), (3, "twice"), (3, "twice"), (4, None)], "doc_id long, text string")
    out = om.edited_fingerprints(odd).collect()
    assert sorted(str(r.doc_id) for r in out) == ["3", "3", "4", "None", "None", "None"]
    assert om.edited_fingerprints(odd.limit(0)).count() == 0
    prints = {(r.doc_id, r.fingerprint) for r in om.fingerprints(odd).collect()}
    assert prints == {(r.doc_id, r.fingerprint) for r in out}


def test_likeness_follows_edits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = om.edited_fingerprints(docs).filter(F.col("n_chars") > 200).toPandas()
    assert (out.near_edited > out.near_next).mean() > 0.95 and np.all(out.near_edited <= 1)
