"""Substring dedup by hashes of lines or paragraphs.

Units are normalised and hashed where they lie; only digests and positions are shuffled. The
earliest ranked occurrence of a digest stays, by (identifier, position); all others are cut out,
and the spans cut are kept as offsets into the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfleet.llm.common import saved

_NOT_WORD = regex.compile(r"[^\p{L}\p{N}]+")
BREAKS = {"line": re.compile("\n"), "paragraph": re.compile("\n[ \t\r]*\n[ \t\r\n]*")}


def normalised(unit: str) -> str:
    """Lower case, with every run of anything but letters and digits as one space, none at the ends."""
    return _NOT_WORD.sub(" ", unit.lower()).strip(" ")


def units_of(text: str, unit: str = "line") -> Iterator[tuple[int, int]]:
    """Start and end of every unit; what breaks units belongs to none."""
    at = 0
    for m in BREAKS[unit].finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def without(text: str, spans: list[tuple[int, int]], unit: str = "line") -> str:
    """text without these units; each unit that stays keeps the break before it, the first none."""
    gone, out, at = set(spans), [], 0
    for start, end in units_of(text, unit):
        if (start, end) not in gone:
            out.append(text[at:end] if out else text[start:end])
        at = end
    return "".join(out)


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25, unit: str = "line") -> DataFrame:
    """Every unit to cut: _id, _row (hash of the text), _start, _end (characters), _keep_id, _count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                found: list[tuple] = []
                for i, text in enumerate(batch.column(2)[k : k + 2000].to_pylist(), k):
                    for start, end in units_of(text or "", unit):
                        if end - start < 2 * min_words - 1:
                            continue
                        norm = normalised(text[start:end])
                        if norm and norm.count(" ") + 1 >= min_words:
                            found.append((i, start, end, hashlib.sha256(norm.encode()).digest()[:16]))
                rows, starts, ends, digests = zip(*found) if found else ((), (), (), ())
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(digests, pa.binary())], ["_id", "_row", "_start", "_end", "_digest"])

    slim = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_row"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    units = saved(slim.mapInArrow(run, f"_id {kind}, _row long, _start long, _end long, _digest binary"), "units")
    first = units.groupBy("_digest").agg(F.min(F.struct("_id", "_start", "_row")).alias("_first"), F.count("*").alias("_count")).filter("_count > 1")
    here = F.struct("_id", "_start", "_row")
    return units.join(first, "_digest").filter(~here.eqNullSafe(F.col("_first"))).select("_id", "_row", "_start", "_end", F.col("_first._id").alias("_keep_id"), "_count")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25, unit: str = "line", spans_col: str | None = "removed_spans", count_col: str | None = "n_removed") -> DataFrame:
    """docs with repeated lines (or paragraphs) cut out of the text, all other columns as they are.

    A unit repeats when its normalised form occurs earlier: in a document with a smaller identifier
    (null counts as smallest) or earlier in the same one. Units of fewer than min_words words are
    never cut, since headings and short phrases repeat by right. removed_spans lists what was cut
    as start-end pairs in the original text ("0-80,120-300"; empty if nothing was), n_removed
    their number. A null text stays null. Rows equal in identifier and text count as one document.
    If docs has columns of the added names, those are replaced. An empty table gives no rows; texts may
    be of any length.
    """
    cut = repeated_units(docs, id_col, text_col, min_words, unit).distinct()
    spans = cut.groupBy(F.col("_id").alias("__sd_id"), F.col("_row").alias("__sd_row")).agg(F.array_sort(F.collect_list(F.struct("_start", "_end"))).alias("__sd_spans"))
    joined = docs.join(spans, docs[id_col].eqNullSafe(F.col("__sd_id")) & (F.xxhash64(docs[text_col]) == F.col("__sd_row")), "left")

    @F.pandas_udf("string")
    def cut_out(texts, spans):
        import pandas as pd

        return pd.Series([t if s is None or t is None else without(t, [(x["_start"], x["_end"]) for x in s], unit) for t, s in zip(texts, spans)], dtype=object)

    cleaned = F.when(F.col("__sd_spans").isNull(), F.col(text_col)).otherwise(cut_out(F.col(text_col), F.col("__sd_spans")))
    new = {text_col: cleaned}
    if spans_col:
        pairs = F.transform("__sd_spans", lambda s: F.concat_ws("-", s["_start"].cast("string"), s["_end"].cast("string")))
        new[spans_col] = F.coalesce(F.array_join(pairs, ","), F.lit(""))
    if count_col:
        new[count_col] = F.when(F.col("__sd_spans").isNull(), 0).otherwise(F.size("__sd_spans")).cast("long")
    return joined.withColumns(new).drop("__sd_id", "__sd_row", "__sd_spans")
