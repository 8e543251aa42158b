"""Fragments and words whose hashes collide are told apart."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wattfleet.llm import fragments
from wattfleet.llm.bpe import ForcedBoundaryCodec, encode_decode
from wattfleet.llm.minhash_forest import near_duplicates
from wattfleet.llm.packing import pack
from wattfleet.llm.words import WordEncoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
# a polynomial modulo 2**64 takes these to one value, whatever its odd multiplier
ONE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
TWO = ONE.translate({97: 98, 98: 97})


def plain(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("make,path", [(ForcedBoundaryCodec, BYTES), (WordEncoder, WORDS)])
@pytest.mark.parametrize("collide", [False, True])
def test_encoders(monkeypatch, make, path, collide):
    if collide:  # nearly all fragments share a hash
        monkeypatch.setattr(fragments, "hashes", lambda data, starts, ends: ((ends - starts) % 3 + 1).astype(np.uint64))
    coder, want = make(path), plain(path)
    texts = [ONE, TWO, "one two three onetwo 12 é", ONE + " " + TWO, "two one threee éé", "", "abcdefgh abcdefghi abcdefghj abcdefgh1 abcdefghij"]
    for some in (texts, texts[::-1], texts[1:2]):  # in one batch, in another order, and alone
        ids, counts = coder.encode_flat(pa.array(some, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [want(t) for t in some]
    coder.table.reset()
    assert coder.encode_flat(pa.array([TWO]))[0].tolist() == want(TWO)


def test_operators(spark):
    df = spark.createDataFrame([(1, ONE, "s"), (2, TWO, "s"), (3, ONE + " x", "s"), (4, TWO + " x", "t")], "doc_id long, text string, source string").coalesce(1)
    got = {r.doc_id: r.ids for r in encode_decode(df, BYTES).collect()}
    assert got == {i: plain(BYTES)(t) for i, t in ((1, ONE), (2, TWO), (3, ONE + " x"), (4, TWO + " x"))}
    crc = {}
    for r in pack(df, WORDS, sequence=2048, end_id=1).collect():
        crc.setdefault(r.doc_id, []).append(r.ids_crc32)
    assert crc[1] != crc[2] and crc[3] != crc[4]
    assert {r.doc_id: r.component_id for r in near_duplicates(df, width=2).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
