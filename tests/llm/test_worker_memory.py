"""What Python workers keep between tasks."""

import os

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from wattfleet.llm import language_id, words
from wattfleet.llm.common import memory_returned
from wattfleet.llm.packing import pack

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def resident():
    """MB that this process has in memory."""
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20


def test_free_memory_goes_back():
    """Of 200 MB in blocks of 100 kB all but every hundredth become free; the others lie between them."""
    stays = []

    def run(batches):
        blocks = [np.ones(100_000, np.uint8) for _ in range(2000)]
        stays.extend(blocks[99::100])
        yield pa.record_batch([pa.array([resident()])], ["mb"])

    top = [b.column(0)[0].as_py() for b in memory_returned(run)(iter([]))][0]
    assert resident() < top - 100 and len(stays) == 20


def test_a_stage_drops_the_encoder_of_another(spark):
    docs = spark.createDataFrame([(i, f"some words of document {i}", "en", "s") for i in range(40)], "doc_id long, text string, lang string, source string").repartition(4)
    pieces = pack(docs, VOCABULARY).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces) and len(pieces) == 40

    def filled(batches):
        for batch in batches:
            words.word_encoder(VOCABULARY)
            yield pa.record_batch([pa.array([words.word_encoder.cache_info().currsize])], ["n"])

    def left(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([words.word_encoder.cache_info().currsize])], ["n"])

    one = docs.select("doc_id").repartition(4)
    assert {r.n for r in one.mapInArrow(memory_returned(filled), "n long").collect()} == {1}
    assert {r.n for r in one.mapInArrow(memory_returned(left), "n long").collect()} == {0}


def test_pieces_of_wide_and_narrow_ids_agree(spark):
    """Pieces are cut from ids of two bytes; the width comes from the rows, and the ids are those of the tokenizer."""
    docs = spark.createDataFrame([(1, "a b c " * 1000, "s"), (2, None, None), (3, "", "s")], "doc_id long, text string, source string")
    rows = pack(docs, VOCABULARY, with_ids=True).orderBy("doc_id", "start").collect()
    ids = {}
    for r in rows:
        ids.setdefault(r.doc_id, []).extend(r.ids)
    want = words.word_encoder(VOCABULARY).own.encode("a b c " * 1000, add_special_tokens=False).ids
    assert ids == {1: [*want, 1], 2: [1], 3: [1]} and all(r.doc_tokens == len(ids[r.doc_id]) for r in rows)


def test_character_tables():
    kind, lower, odd = language_id.characters()
    assert [int(kind[ord(c)]) for c in "aé́ 1"] == [1, 1, 2, 0, 0] and chr(lower[ord("É")]) == "é" and odd[ord("Σ")] and odd[0x130]
    assert not kind[0xD800:0xE000].any() and kind[0x1D400] == 1


def test_operators_still_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert pack(docs, VOCABULARY).agg(F.count("*")).first()[0] == 0
