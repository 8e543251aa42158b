"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

1. language ID: documents whose language can't be told go
2. exact dedup: of texts equal but for the case of A-Z, the one with the largest identifier stays, and of rows equal in both only one
3. MinHash near-dedup: of documents linked by 80 % of their five-word shingles, the one with the smallest identifier stays
4. substring dedup: passages of 50 words or more that occurred before are cut out of the text, wherever they lie in its lines
5. packing: what is left, as sequences of 2048 tokens, mixed by source

All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattfleet.llm import language_id
from wattfleet.llm.common import saved, table
from wattfleet.llm.exact_dedup import drop_exact_duplicates
from wattfleet.llm.minhash_forest import near_duplicates
from wattfleet.llm.packing import pack
from wattfleet.llm.passages import dedup_passages

#: A document stays if one language has at least this share of its letters.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language; a missing lang is filled in. Texts that are null or without letters go; repeated rows share their verdict, an empty table stays empty. Columns of any name go along untouched."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    # a row is one column here, so that no column of the user's meets one of the prediction's
    out = language_id.predict(docs.select(F.struct("*").alias("__row")), model, text_col="__row.text", keep=["__row"])
    out = out.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    lang = F.coalesce("__row.lang", "lang_pred")
    return out.select(*[(lang if c == "lang" else F.col("__row")[c]).alias(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, a null text counting as empty; of equal rows one. An empty table stays empty."""
    return drop_exact_duplicates(docs, keep="largest", one_row=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; null identifiers are in no group. Texts without words are linked with nothing and stay. Empty tables stay empty."""
    gone = near_duplicates(docs, width=5, percent=80).filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti").select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, and n_chars follows the text. A text that is one repeated passage becomes empty; null texts and empty tables stay as they are."""
    out = dedup_passages(docs, min_words=50, spans_col=None, count_col=None)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as pieces of sequences; a null or empty text is its end id alone, repeated rows are documents of their own, an empty table gives no rows."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), sequence=2048, end_id=1)


STAGES = [("language_id", language), ("exact_dedup", exact), ("minhash_near_dedup", near), ("substring_dedup", substrings), ("packing", packing)]
#: No stage but exact dedup can be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
