"""URL filters against trying every rule, token counts against counting directly."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wattfleet.llm.token_counts import count_tokens, document_token_counts, read_streams
from wattfleet.llm.url_filter import TokenIndex, host_rule, judge_urls, pattern_rule

RULES = [host_rule("allow", "com"), host_rule("block", "example.com", "/en/"), host_rule("block", "net", "/es"), pattern_rule("||spam."), pattern_rule("/ads/*.gif|"), pattern_rule("^q=1^", "allow"), pattern_rule("track")]
URLS = [None, "", "no scheme /ads/x.gif", "http://a.Example.COM/en/x?q=1", "http://example.com", "http://notexample.com/en/", "https://b.net/es/1", "https://b.net/est#x", "http://SPAM.org/TRACK", "http://nospam.org/ads/1/2.gif", "http://x.org/?q=1&b", "http://x.org/?q=12", "://com/", "a://b://com/x", "http://u@com:80/", "http://x.org/attract\nracking", "h" * 100_000 + "://com/"]


def brute(url):
    at = (url or "").find("://")
    host, path = ("", "") if at < 0 else re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :]).groups()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in RULES if re.search(r.expression, host + path if r.where == "place" else (url or "").lower(), re.S)]
    best = max(fits, key=lambda r: (r.rank, r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


@pytest.mark.parametrize("max_sent", [1 << 20, 0])
def test_urls(spark, max_sent):
    df = spark.createDataFrame([(i if i else None, u) for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string").withColumns({"rule": F.lit(1), "_token": F.lit("clash"), "_key": F.lit("clash")})
    got = judge_urls(df, RULES, max_sent=max_sent).collect()
    assert len(got) == len(URLS) + 3
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url), r.url
    assert judge_urls(df.limit(0), RULES, max_sent=max_sent).count() == 0


@pytest.mark.parametrize("max_sent", [1 << 20, 0])
def test_any_pattern_on_null(spark, max_sent):
    df = spark.createDataFrame([(None,), ("",), ("x",)], "url string")
    assert {r.verdict for r in judge_urls(df, [pattern_rule("*")], max_sent=max_sent).collect()} == {"block"}


def test_line_ends_and_random_patterns_alike(spark):
    rng = random.Random(3)
    rules = [pattern_rule("/x|"), pattern_rule("|http://a.com/y|"), *(pattern_rule("".join(rng.choice("ab/.*^|é") for _ in range(rng.randrange(1, 6)))) for _ in range(40))]
    ends = ["", "\r", "\n", "\r\n", "\x85", "\u2028", "\u2029", " "]
    urls = [None, *(f"http://a.com/{p}{e}" for p in "xy" for e in ends), *("http://" + "".join(rng.choice("aAbB/.?é\n\r\u2028") for _ in range(rng.randrange(12))) for _ in range(150))]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    verdicts = [[(r.page_id, r.rule, r.verdict) for r in judge_urls(df, rules, max_sent=m).orderBy("page_id").collect()] for m in (1 << 20, 0)]
    assert verdicts[0] == verdicts[1]
    few = [{urls[r.page_id]: r.verdict for r in judge_urls(df.filter("page_id < 17"), rules[:2], max_sent=m).collect()} for m in (1 << 20, 0)]
    assert few[0] == few[1] and few[0]["http://a.com/x"] == "block" and few[0]["http://a.com/x\r"] == few[0]["http://a.com/x\u2028"] == "allow"


def test_only_candidates_run():
    i = TokenIndex(tuple((r, r.tokens[0] if r.tokens else None) for r in RULES))
    assert {r.text for r in i.always} == {"track"}
    assert i.decide("x.org/", "http://x.org/") is None


@pytest.mark.parametrize("block_tokens", [3, 1 << 18])
def test_document_counts(spark, block_tokens):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40)
    odd = spark.createDataFrame([(None, None), (1000, ""), (1001, "<|endoftext|> a <|startoftext|>"), (1002, "x"), (1002, "x y")], "doc_id long, text string")
    both = docs.union(odd).repartition(4)
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = sorted((str(r.doc_id), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in both.collect())
    got = document_token_counts(both, path, block_tokens=block_tokens).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want and all(r.complete for r in got)
    assert document_token_counts(both.limit(0), path).count() == 0


def test_flat_files(spark, tmp_path):
    rng, want = random.Random(1), []
    for f in range(3):
        ids = [rng.choice([0, 1, 2, 3, 9]) for _ in range(rng.randrange(0, 3000))]
        np.array(ids, "<u2").tofile(tmp_path / f"s{f}.bin")
        at, k = 0, 0
        for i, x in enumerate(ids):
            if x == 9:
                want.append((f, k, at, i - at, True))
                at, k = i + 1, k + 1
        if at < len(ids):
            want.append((f, k, at, len(ids) - at, False))
    got = [(int(r.stream[-5]), r.ordinal, r.start, r.n_tokens, r.complete) for r in count_tokens(read_streams(spark, str(tmp_path), 2), 9).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("max_sent", [1 << 30, 0])
def test_long_rule_list(spark, max_sent):
    rules = [pattern_rule(f"||host{i}.") for i in range(20_000)] + [host_rule("block", "org", "/bad/")]
    urls = ["http://host7.com/", "http://a.host19999.net/x", "http://host20000.com/", "http://x.org/bad/1", "http://x.org/good", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.rule) for r in judge_urls(df, rules, max_sent=max_sent).collect()}
    assert got == {0: ("block", "||host7."), 1: ("block", "||host19999."), 2: ("allow", None), 3: ("block", "org/bad/"), 4: ("allow", None), 5: ("allow", None)}


def test_odd_bytes_and_ranges(spark, tmp_path):
    (tmp_path / "s.bin").write_bytes(np.array([1, 2, 9, 3], "<u2").tobytes() + b"\x07")
    (tmp_path / "t.bin").write_bytes(b"")
    blocks = read_streams(spark, str(tmp_path), 4)
    assert sorted((r.stream[-5], r.block, bytes(r.tokens)) for r in blocks.collect()) == [("s", 0, b"\x01\x00\x02\x00"), ("s", 1, b"\x09\x00\x03\x00"), ("s", 2, b"\x07")]
    assert sorted((r.ordinal, r.start, r.n_tokens, r.complete) for r in count_tokens(blocks, 9).collect()) == [(0, 0, 2, True), (1, 3, 1, False)]
