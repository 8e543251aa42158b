"""BPE and packing against the tokenizers library and against plain Python."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wattfleet.llm.bpe import codec, encode_decode
from wattfleet.llm.packing import Mixture, pack
from wattfleet.llm.words import WordEncoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "\n\n\n", "x  \n\n y", "don't DON'T 's", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "né é ñ 漢字 😀   x", "a\x1c b\x85c", "!!'s ...", "aaaa" * 3000, "éü" * 2000, "1234567890" * 50, "tab\t\tx\r\n", "́é é"]


def plain(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def ids_of(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


def test_bpe_odd_texts():
    t, c = plain(BYTES), codec(BYTES)
    for text in ODD:
        assert c.encode(text) == ids_of(t, text), text[:20]
        assert c.decode(c.encode(text)) == t.decode(ids_of(t, text), skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Zé'\n\t s1!漢<|>😀\x1c"), max_size=40))
def test_bpe_any_text(text):
    assert codec(BYTES).encode(text) == ids_of(plain_bytes, text)


plain_bytes = plain(BYTES)


def test_bpe_operator(spark, docs):
    rows = [(i, x) for i, x in enumerate([*ODD, None])] + [(None, "x"), (1, "twice"), (1, "twice")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    t = plain(BYTES)
    want = sorted(
        (r[0] is None, r[0] or 0, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.decode(i, skip_special_tokens=False).encode()).hexdigest())
        for r in both.collect()
        for i in [ids_of(t, r[1])]
    )
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_decode(both, BYTES).collect())
    assert got == want
    assert encode_decode(both.limit(0), BYTES).count() == 0


def test_word_encoder():
    for special in (True, False):
        t, e = plain(WORDS), WordEncoder(WORDS, special)
        t.encode_special_tokens = not special
        for text, ids in zip(ODD, e.encode(ODD), strict=True):
            assert np.frombuffer(ids, e.kind).tolist() == ids_of(t, text), text[:20]


MIXED = st.text(alphabet=st.sampled_from("aB zZ'.,!<|>9 0\n\t éÉ×÷ñß日Σ́-_$%\xa0"), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(MIXED, min_size=1, max_size=30))
def test_batches_of_any_texts(texts):
    """Texts that lie side by side in one buffer don't touch each other."""
    assert [np.frombuffer(x, words.kind).tolist() for x in words.encode(texts)] == [ids_of(plain_words, t) for t in texts]
    ids, counts = codec(BYTES).encode_flat(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [ids_of(plain_bytes, t) for t in texts]


words, plain_words = WordEncoder(WORDS), plain(WORDS)


def test_full_table_starts_anew(monkeypatch):
    from wattfleet.llm import fragments

    monkeypatch.setattr(fragments, "CACHED", 50)
    e = WordEncoder(WORDS)
    for k in range(40):
        texts = [" ".join(f"word{i}x" for i in range(k * 7, k * 7 + 9)), None, "same again"]
        assert [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)] == [ids_of(plain_words, t) for t in texts]


def whole(rows, docs, end=1):
    """Every document's pieces join to its ids; sequences have no gaps and all but the last are full."""
    t = plain(WORDS)
    want = sorted((d is None, d or 0, *ids_of(t, x), end) for d, x in docs)
    seqs, pieces = {}, {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids) > 0
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
    sizes = []
    for s in sorted(seqs):
        at = 0
        for o, n in sorted(seqs[s]):
            assert o == at
            at += n
        sizes.append(at)
    assert sorted(seqs) == list(range(len(seqs))) and all(x == 2048 for x in sizes[:-1]) and sizes[-1] <= 2048
    got = []
    for d, parts in pieces.items():
        for n in {p[2] for p in parts}:
            ids = [i for s, x, _ in sorted(p for p in parts if p[2] == n) for i in x]
            got += [(d is None, d or 0, *ids[k : k + n]) for k in range(0, len(ids), n)] if len(ids) == n else [None]
    return want, sorted(x for x in got if x), None in got


def test_pack_whole(spark, docs):
    rows = pack(docs.repartition(5), WORDS, with_ids=True, window=8192).collect()
    want, got, odd = whole(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert got == want and not odd


def test_pack_nulls_and_empties(spark):
    data = [(1, None, "a"), (2, "", None), (None, "x y", "a"), (4, "word " * 5000, "b")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("length", df_lit())
    rows = pack(df, WORDS, with_ids=True).collect()
    want, got, odd = whole(rows, [(d, x) for d, x, _ in data])
    assert got == want and not odd
    assert pack(df.limit(0), WORDS).count() == 0


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 5), st.integers(1, 5000), min_size=1, max_size=5), st.integers(1, 700), st.booleans(), st.data())
def test_mixture_is_exact(totals, window, own, data):
    weights = {q: data.draw(st.integers(0, 5)) for q in totals} if own else None
    m, seen = Mixture(totals, window, weights), []
    for q, n in totals.items():
        for first, k, where in m.pieces(q, 0, n, 64):
            assert where // 64 == (where + k - 1) // 64
            seen += range(where, where + k)
        cut = n // 3
        assert [w + j for _, k, w in [*m.pieces(q, 0, cut, 64), *m.pieces(q, cut, n - cut, 64)] for j in range(k)] == [w + j for _, k, w in m.pieces(q, 0, n, 64) for j in range(k)]
    assert sorted(seen) == list(range(sum(totals.values())))


def test_windows_keep_the_mixture():
    totals = {1: 900_000, 2: 90_000, 3: 10_000}
    m = Mixture(totals, 1000, {1: 2, 2: 1, 3: 1})
    for w in range(0, 30):
        one, two, _ = m.at(w)
        assert two[1] - one[1] == 500 and two[2] - one[2] == 250 and two[3] - one[3] == 250
