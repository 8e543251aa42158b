"""URL filters: rules indexed by their rarest literal token.

A rule matches where its regular expression does. Each rule is filed under the token that is rarest
in the URLs to be judged, of those that every URL it matches must hold as a whole token. A URL is
cut into tokens once; only the rules filed under one of them run their expression on it.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattfleet.llm.common import LOWER, UPPER

#: Bytes of rule text that are sent to every task at most; longer lists are joined token by token instead.
MAX_SENT = 16 << 20
#: Groups of URLs that meet the rules without a token.
SPREAD = 64
_TOKENS = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """text names the rule; expression is searched in host + path (where="place") or in the whole URL with A-Z lower-cased (where="url").

    tokens: literal tokens, lower case, that every match holds whole. rank orders rules that match
    the same URL: the largest decides; text breaks ties.
    """

    text: str
    verdict: str
    expression: str
    where: str
    tokens: tuple[str, ...] = field(default=())
    rank: int = 0


def host_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """Fits host and all its subdomains where the path starts with `path`; the longest such rule decides, over all patterns."""
    text = host + path
    inner = path if path.endswith("/") else path.rpartition("/")[0] + "/"
    tokens = _TOKENS.findall((host + inner).lower())
    return Rule(text, verdict, rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}", "place", tuple(tokens), (1 << 20) + len(text))


def pattern_rule(pattern: str, verdict: str = "block") -> Rule:
    """A pattern over the lower-cased URL: `||` anchors at a host label, `|` at an end, `*` is anything, `^` a separator or the end."""
    body, start, end = pattern.lower(), "", ""
    if body.startswith("||"):
        body, start = body[2:], r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?"
    elif body.startswith("|"):
        body, start = body[1:], "^"
    if body.endswith("|"):
        body, end = body[:-1], "$"
    expression = start + "".join({"*": ".*", "^": r"([^a-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in body) + end
    # a run at an open end, or next to *, may go on in the URL
    marked = (" " if start else "*") + body + (" " if end else "*")
    tokens = [m[0] for m in re.finditer(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", marked)]
    return Rule(pattern, verdict, expression, "url", tuple(tokens), len(pattern))


def parsed(url: Column) -> dict[str, Column]:
    """Host (after the first :// up to / ? # or the end, A-Z lower-cased), path (then up to ? # or the end), and the URL with A-Z lower-cased."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host, path = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return {"_host": F.when(has, F.translate(host, UPPER, LOWER)).otherwise(""), "_path": F.when(has, path).otherwise(""), "_url": F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)}


def rarest_tokens(urls: DataFrame, rules: list[Rule]) -> dict[Rule, str | None]:
    """Each rule's token that fewest URLs hold; ties go to the longer, then the smaller. urls: column _url.

    The rules' tokens are a table, so a list of any length makes the same plan.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return dict.fromkeys(rules)
    table = urls.sparkSession.createDataFrame([(t,) for t in wanted], "t string")
    seen, few = urls.select(F.explode(F.array_distinct(F.split("_url", "[^a-z0-9]+"))).alias("t")), sum(map(len, wanted)) <= MAX_SENT
    # tokens of long lists are counted before they meet the table, so that a common one is a row per task
    n = (seen.join(F.broadcast(table), "t") if few else seen).groupBy("t").agg(F.count("*").alias("n"))
    counts = {r["t"]: r["n"] for r in (n if few else n.join(table, "t")).collect()}
    return {r: min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=None) for r in rules}


@lru_cache(maxsize=4096)
def compiled(expression: str) -> re.Pattern:
    return re.compile(expression, re.S)


class TokenIndex:
    """Rules by token; verdict of one URL. An expression is compiled when one of its rule's tokens is first met."""

    def __init__(self, filed: tuple[tuple[Rule, str | None], ...]):
        self.by: dict[str, list[Rule]] = {}
        self.always: list[Rule] = []
        for r, token in filed:
            (self.by.setdefault(token, []) if token else self.always).append(r)

    def decide(self, place: str, url: str) -> Rule | None:
        rules = [*self.always, *(r for t in set(_TOKENS.findall(url)) & self.by.keys() for r in self.by[t])]
        fits = [r for r in rules if compiled(r.expression).search(place if r.where == "place" else url)]
        return max(fits, key=lambda r: (r.rank, r.text), default=None)


_indexes: dict[str, TokenIndex] = {}


def index(name: str, filed: tuple[tuple[Rule, str | None], ...]) -> TokenIndex:
    """One for each worker and list of rules, of which two are kept; name: a digest of the list, made once."""
    if name not in _indexes:
        if len(_indexes) > 1:
            del _indexes[next(iter(_indexes))]
        _indexes[name] = TokenIndex(filed)
    return _indexes[name]


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow", max_sent: int = MAX_SENT) -> DataFrame:
    """pages with host, path, rule (its text, null if none fits) and verdict.

    Of the rules that fit, the one with the largest rank decides, by text in ties; without any the
    verdict is `default`. A null URL, or one without ://, has empty host and path; patterns are still
    tried on it, on a null one as on the empty text. Columns of pages with the added names are replaced. Repeated rows get the
    same verdict; an empty table gives no rows, and a very long URL is judged whole. Rule lists of up to
    max_sent bytes go to every task; longer ones become a table, joined with the URLs' tokens. The
    same expressions run by the same engine on either way.
    """
    parts = parsed(F.col(url_col))
    filed = tuple(rarest_tokens(pages.select(parts["_url"].alias("_url")), rules).items())
    if sum(len(r.text) + len(r.expression) for r in rules) <= max_sent:
        name = hashlib.sha256(repr(filed).encode()).hexdigest()

        @F.pandas_udf("struct<rule string, verdict string>")
        def decide(host, path, url):
            i = index(name, filed)
            found = [i.decide(h + p, u) for h, p, u in zip(host, path, url)]
            return pd.DataFrame({"rule": [r.text if r else None for r in found], "verdict": [r.verdict if r else default for r in found]}, dtype=object)

        out = pages.withColumn("__uf", decide(*parts.values()))
        return out.withColumns({"host": parts["_host"], "path": parts["_path"], "rule": F.col("__uf.rule"), "verdict": F.col("__uf.verdict")}).drop("__uf")
    return _joined(pages, filed, parts, url_col, default)


def _joined(pages: DataFrame, filed: tuple[tuple[Rule, str | None], ...], parts: dict[str, Column], url_col: str, default: str) -> DataFrame:
    """The way for long lists: distinct URLs meet the rules' table by token, the best rule of each goes back to its pages."""
    spark = pages.sparkSession
    table = spark.createDataFrame([(t or "", r.text, r.verdict, r.expression, r.where, r.rank) for r, t in filed], "_token string, _text string, _verdict string, _expression string, _where string, _rank long")
    key = F.coalesce(F.col(url_col), F.lit(""))
    urls = pages.select(key.alias("_key"), *[c.alias(n) for n, c in parts.items()]).distinct()
    tokens = F.split("_url", "[^a-z0-9]+")
    if any(not t for _, t in filed):
        # rules without a token meet every URL; these are dealt out, for no token is as frequent
        tokens = F.concat(F.array(F.concat(F.lit("#"), F.pmod(F.xxhash64("_key"), F.lit(SPREAD)).cast("string"))), tokens)
        every = F.explode(F.transform(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda i: F.concat(F.lit("#"), i.cast("string"))))
        table = table.filter("_token != ''").union(table.filter("_token = ''").withColumn("_token", every))

    @F.pandas_udf("boolean")
    def found(expression: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([compiled(e).search(t) is not None for e, t in zip(expression, text)], dtype=bool)

    met = urls.withColumn("_token", F.explode(F.array_distinct(tokens))).join(table, "_token")
    fits = met.filter(found("_expression", F.when(F.col("_where") == "place", F.concat("_host", "_path")).otherwise(F.col("_url"))))
    best = fits.groupBy(F.col("_key").alias("__uf_key")).agg(F.max(F.struct("_rank", "_text", "_verdict")).alias("__uf"))
    out = pages.join(best, key == F.col("__uf_key"), "left")
    return out.withColumns({"host": parts["_host"], "path": parts["_path"], "rule": F.col("__uf._text"), "verdict": F.coalesce("__uf._verdict", F.lit(default))}).drop("__uf", "__uf_key")
