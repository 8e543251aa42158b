"""Language ID against held-out labels, and Viterbi against all label sequences."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattfleet.llm import language_id as li


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return li.fit(docs.filter(~li.held_out()))


def test_held_out_accuracy(docs, model):
    out = li.predict(docs, model).filter(li.held_out() & F.col("lang").isNotNull())
    n, right = out.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right / n > 0.97
    assert out.filter("score < 0 OR score > 1").count() == 0


def test_viterbi_is_best():
    rng = np.random.default_rng(3)
    for _ in range(40):
        t, n, p = rng.integers(1, 6), rng.integers(1, 4), float(rng.uniform(0, 3))
        s = -rng.uniform(0, 4, (t, 1, n)).astype(np.float32)
        got = li.viterbi(s, np.array([t]), p)[:, 0]
        value = lambda seq: sum(s[i, 0, x] for i, x in enumerate(seq)) - p * sum(a != b for a, b in zip(seq, seq[1:]))
        assert abs(value(got) - max(map(value, itertools.product(range(n), repeat=t)))) < 1e-4


def test_spans_of_mixed_text(spark, docs, model):
    one = {r.lang: r.text for r in docs.filter("length(text) BETWEEN 300 AND 2000").groupBy("lang").agg(F.first("text").alias("text")).collect()}
    text = one["de"] + "\n" + one["fr"]
    spans = li.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, with_spans=True).first().spans
    assert spans[0].lang == "de" and spans[-1].lang == "fr" and len(spans) <= 6
    assert min(abs(s.start - len(one["de"])) for s in spans[1:]) < 80


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 ... !"), (None, "Der und die"), (4, "Привет мир"), (5, "x " * 100_000), (5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = li.predict(df, model).collect()
    assert len(got) == 7 and got[0].asDict().keys() == {"doc_id", "text", "lang_pred", "score"}
    by = {(r.doc_id, r.text): r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in rows[:3])
    assert all(by[k].lang_pred in model.langs for k in rows[3:])
    assert li.predict(df.limit(0), model).count() == 0
    nothing = li.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in li.predict(df, nothing).collect()} == {"und"}


def test_scripts_narrow():
    m = li.Model({"ru": {"^мы": 1, "мы$": 1}, "en": {"^we": 1, "we$": 1}}, {"ru": {"cyrillic": 100}, "en": {"latin": 100}})
    s = m.scores(["мы", "we", "漢", "ы"])
    en, ru = m.langs.index("en"), m.langs.index("ru")
    assert s[0][en] == -30 and s[0][ru] == 0 and s[1][ru] == -30 and s[1][en] == 0 and not s[2].any() and s[3][ru] == 0
