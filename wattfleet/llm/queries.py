"""The operators' registered queries over the tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattfleet.llm import language_id
from wattfleet.llm.ann_scan import search
from wattfleet.llm.bpe import encode_decode
from wattfleet.llm.common import LOWER, UPPER, table
from wattfleet.llm.conversation_trie import prefix_trie
from wattfleet.llm.exact_dedup import exact_duplicates
from wattfleet.llm.line_chunks import dedup_chunks
from wattfleet.llm.minhash_forest import near_duplicates
from wattfleet.llm.order_minhash import edited_fingerprints
from wattfleet.llm.packing import pack
from wattfleet.llm.passages import WORD_RANGES, dedup_passages
from wattfleet.llm.spelling import spelling_variants
from wattfleet.llm.substring_dedup import dedup_substrings
from wattfleet.llm.token_counts import document_token_counts
from wattfleet.llm.url_filter import host_rule, judge_urls, pattern_rule

HOST_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Patterns that decide where no host rule does.
PATTERNS = ["||spam-farm.", "||cheap-pills.", "||ads-track.", "/wp-login.php", "^utm_campaign=spam^"]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [host_rule(*r) for r in HOST_RULES] + [pattern_rule(p) for p in PATTERNS]
    out = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    named = F.col("rule").isin([host + path for _, host, path in HOST_RULES])
    return out.select("page_id", "host", "path", F.when(named, F.col("rule")).alias("rule"), "verdict", F.when(~named, F.col("rule")).alias("pattern"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=25)


def op2_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "complete")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~language_id.held_out() & F.col("doc_id").isNotNull()))
    out = language_id.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), sequence=2048, end_id=1)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_trie(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_passage_dedup": op2_passage_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_language_id": op4_language_id,
    "op5_minhash": op5_minhash,
    "op6_ann": op6_ann,
    "op7_line_dedup": op7_line_dedup,
    "op7_line_dedup_whole": op7_line_dedup_whole,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_bpe": op9_bpe,
    "op10_packing": op10_packing,
    "op11_spelling": op11_spelling,
    "op12_fingerprints": op12_fingerprints,
    "op13_prefix_trie": op13_prefix_trie,
}

_PATTERN_SQL = " ".join(
    f"WHEN regexp_matches(u, '{e}') THEN '{p}'"
    for p, e in sorted(((p, pattern_rule(p).expression) for p in PATTERNS), key=lambda x: (-len(x[0]), x[0]))
)
ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": f"""
        WITH r(verdict, host, path) AS (VALUES {", ".join(map(str, HOST_RULES))}),
        p AS (SELECT page_id, translate(url, '{UPPER}', '{LOWER}') AS u,
                     translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                     regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        b AS (SELECT p.page_id, max(struct_pack(n := length(r.host || r.path), rule := r.host || r.path, verdict := r.verdict)) AS best
              FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id),
        f AS (SELECT p.*, CASE {_PATTERN_SQL} END AS fits FROM p)
        SELECT f.page_id, f.host, f.path, b.best.rule AS rule,
               coalesce(b.best.verdict, CASE WHEN f.fits IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
               CASE WHEN b.best IS NULL THEN f.fits END AS pattern
        FROM f LEFT JOIN b USING (page_id)""",
    "op2_passage_dedup": f"""
        WITH d AS (SELECT doc_id, text, length(regexp_extract(text, '^[^{WORD_RANGES}]*')) AS lead, regexp_extract_all(text, '[{WORD_RANGES}]+[^{WORD_RANGES}]*') AS pieces FROM documents),
        p AS (SELECT doc_id, text, lead, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM d),
        w AS (SELECT *, regexp_extract(piece, '^[{WORD_RANGES}]+') AS word, (lead + sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece))::BIGINT AS place FROM p),
        t AS (SELECT doc_id, list(translate(word, '{UPPER}', '{LOWER}') ORDER BY i) AS ws FROM w GROUP BY doc_id),
        r AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM t)),
        f AS (SELECT doc_id, i, first_value(doc_id) OVER o AS first_id, first_value(i) OVER o AS first_i, row_number() OVER o AS nth FROM r WINDOW o AS (PARTITION BY h ORDER BY doc_id, i)),
        c AS (SELECT doc_id, CASE WHEN first_id = doc_id THEN greatest(i, first_i + 50) ELSE i END AS a, i + 50 AS b FROM f WHERE nth > 1),
        e AS (SELECT doc_id, i, sum(x) AS x FROM (SELECT doc_id, a AS i, 1 AS x FROM c UNION ALL SELECT doc_id, b, -1 FROM c) GROUP BY doc_id, i),
        g AS (SELECT w.*, sum(coalesce(e.x, 0)) OVER (PARTITION BY doc_id ORDER BY i) > 0 AS gone FROM w LEFT JOIN e USING (doc_id, i)),
        k AS (SELECT *, count(*) FILTER (NOT gone) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g),
        m AS (SELECT doc_id, any_value(text) AS text, min(place) AS a, max(place) AS z, arg_max(word, i) AS word, arg_max(piece, i) AS piece FROM k WHERE gone GROUP BY doc_id, island),
        n AS (SELECT *, strpos(substr(piece, length(word) + 1), chr(10)) AS feed FROM m),
        s AS (SELECT doc_id, text, a, CASE WHEN feed = 0 THEN z + length(piece) ELSE z + length(word) + feed - (NOT (a = 0 OR substr(text, a, 1) = chr(10)))::INT END AS b FROM n),
        q AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
        z AS (SELECT doc_id, string_agg(substr(text, before + 1, a - before), '' ORDER BY a) || substr(any_value(text), max(b) + 1) AS text, string_agg(a || '-' || b, ',' ORDER BY a) AS spans, count(*) AS n FROM q GROUP BY doc_id)
        SELECT documents.doc_id, CASE WHEN z.n IS NULL THEN documents.text ELSE z.text END AS text, coalesce(z.spans, '') AS removed_spans, coalesce(z.n, 0) AS n_removed
        FROM documents LEFT JOIN z USING (doc_id)""",
    "op2_substring_dedup": r"""
        WITH l AS (SELECT doc_id, n, unnest(lines) AS line, generate_subscripts(lines, 1) AS no
                   FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n, string_split(text, chr(10)) AS lines FROM documents)),
        o AS (SELECT *, trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS norm,
                     sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no) - length(line) - 1 AS start FROM l),
        c AS (SELECT *, len(string_split(norm, ' ')) >= 25 AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, no) > 1 AS cut FROM o)
        SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT cut), '') AS text,
               coalesce(string_agg(start::BIGINT || '-' || (start + length(line))::BIGINT, ',' ORDER BY no) FILTER (cut), '') AS removed_spans,
               count(*) FILTER (cut) AS n_removed
        FROM c GROUP BY doc_id""",
    "op7_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS no, len(lines) AS n
                   FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
        h AS (SELECT *, ('0x' || substr(md5(line), 1, 14))::BIGINT AS h FROM l),
        r AS (SELECT *, xor(xor(coalesce(lag(h, 2) OVER w, 0) << 2, coalesce(lag(h, 1) OVER w, 0) << 1), h) AS roll FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
        e AS (SELECT *, (roll % 4 = 0 OR no = n - 1)::INT AS ends FROM r),
        g AS (SELECT *, sum(ends) OVER (PARTITION BY doc_id ORDER BY no) - ends AS chunk FROM e),
        c AS (SELECT doc_id, chunk, count(*) AS lines, string_agg(line, chr(10) ORDER BY no) AS body FROM g GROUP BY doc_id, chunk),
        d AS (SELECT *, lines > 1 AND row_number() OVER (PARTITION BY lines > 1, body ORDER BY doc_id, chunk) > 1 AS cut FROM c)
        SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT cut), '') AS text,
               coalesce(sum(lines) FILTER (cut), 0)::BIGINT AS removed_lines
        FROM d GROUP BY doc_id""",
    "op7_line_dedup_whole": """
        WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS no, len(lines) AS n
                   FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
        h AS (SELECT *, ('0x' || substr(md5(line), 1, 14))::BIGINT AS h FROM l),
        r AS (SELECT *, (h + 3 * coalesce(lag(h, 1) OVER w, 0) + 7 * coalesce(lag(h, 2) OVER w, 0)) % 4 = 0 AS fits FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
        e AS (SELECT *, (no = n - 1 OR (fits AND NOT coalesce(lag(fits) OVER w, false) AND no > 0 AND no <> n - 2))::INT AS ends FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
        g AS (SELECT *, sum(ends) OVER (PARTITION BY doc_id ORDER BY no) - ends AS chunk FROM e),
        c AS (SELECT doc_id, chunk, count(*) AS lines, string_agg(line, chr(10) ORDER BY no) AS body FROM g GROUP BY doc_id, chunk),
        d AS (SELECT *, lines > 1 AND row_number() OVER (PARTITION BY lines > 1, body ORDER BY doc_id, chunk) > 1 AS cut FROM c)
        SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT cut), '') AS text,
               coalesce(sum(lines) FILTER (cut), 0)::BIGINT AS removed_lines
        FROM d GROUP BY doc_id""",
    "op8_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op13_prefix_trie": """
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        n AS (SELECT conv_id AS c, count(*) AS n, conv_id - conv_id % 100 AS base FROM t GROUP BY conv_id),
        b AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                                    lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))) AS crc FROM n),
        h AS (SELECT *, xor(crc, 4294967295) % 6 AS h FROM b),
        k AS (SELECT h.c, h.n, h.h, h.base, count(t.pos) AS k FROM h LEFT JOIN t ON t.conv_id = h.base AND t.pos < h.h GROUP BY ALL),
        r AS (SELECT k.c, t.pos + 1 AS d, role, text FROM k JOIN t ON t.conv_id = k.base AND t.pos < k.h
              UNION ALL SELECT k.c, t.pos - k.h + k.k + 1, role, text FROM k JOIN t ON t.conv_id = k.c AND t.pos >= k.h),
        p AS (SELECT c, d, length(text) AS chars, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY d) AS path FROM r
              UNION ALL SELECT c, 0, 0, [] FROM k),
        q AS (SELECT c, d, chars, path, CASE WHEN d > 0 THEN path[: d - 1] END AS up, d = max(d) OVER (PARTITION BY c) AS last FROM p),
        v AS (SELECT path, d, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(chars) AS chars, bool_and(last) AS leaf, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends FROM q GROUP BY path, d),
        s AS (SELECT a.path, a.d, sum((w.n - 1) * w.chars)::BIGINT AS saved, count(*) FILTER (w.leaf) AS leaves FROM v w JOIN q z ON z.c = w.c AND z.d = w.d JOIN q a ON a.c = w.c AND a.d <= w.d GROUP BY a.path, a.d),
        u AS (SELECT up AS path, d - 1 AS d, count(*) AS kids FROM v WHERE d > 0 GROUP BY ALL)
        SELECT v.c AS conv_id, v.d AS depth, o.c AS parent_conv_id, v.n AS n_convs, coalesce(u.kids, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, v.ends AS ends_sha256
        FROM v LEFT JOIN v o ON o.d = v.d - 1 AND o.path = v.up LEFT JOIN u ON u.d = v.d AND u.path = v.path JOIN s ON s.d = v.d AND s.path = v.path""",
}
