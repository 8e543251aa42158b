"""Passage dedup: every run of min_words words that occurred before is cut, wherever it lies in a line.

Units are placed by content, so that they fall alike in every copy of a passage: of each `window`
neighbouring runs of `width` words the one with the least hash is a unit. Digests of units are
grouped globally and the earliest ranked occurrence of each stays. Repeated units of a document
that follow each other as they do where they first occurred form a chain, and all words of a chain
of min_words or more are cut. Only at the ends of chains are the runs of min_words words hashed one
by one and grouped, in both documents. What is cut is exactly what a comparison of all runs would
cut, up to collisions of 64- and 96-bit hashes: a run that occurred before holds a unit; it lies in
that unit's chain, or else holds a unit at an end of it, here and where it occurred first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattfleet.llm.common import memory_returned, saved
from wattfleet.llm.fragments import blocks, flat, hashes, sliced

#: Bytes of text that are cut into words at a time.
BLOCK = 1 << 19
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Characters of words, as ranges of a regular expression: digits, letters, and all beyond U+00BF but general and CJK punctuation.
WORD_RANGES = r"0-9A-Za-z\x{C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3040}-\x{10FFFF}"
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end in the bytes, and the number of the first word of every text (at: where texts start)."""
    inside = _IN_WORD[data]
    lead = data == 0xC2
    low, mid = np.append(data[1:], np.zeros(1, np.uint8)), np.append(data[2:], np.zeros(2, np.uint8))[: len(data)]
    sign = (data == 0xE2) & ((low == 0x80) | ((low == 0x81) & (mid < 0xB0))) | (data == 0xE3) & (low == 0x80)
    inside[lead | sign] = False
    inside[1:] &= ~(lead | sign)[:-1]
    inside[2:] &= ~sign[:-2]
    begins = np.zeros(len(data) + 1, bool)
    begins[at] = True
    before = np.append(False, inside[:-1]) & ~begins[:-1]
    after = np.append(inside[1:], False) & ~begins[1:]
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, at)


class Runs:
    """Hashes of all runs of some words, as polynomials modulo 2**64."""

    def __init__(self, multiplier: int):
        self.multiplier, self.powers, self.inverse = multiplier, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, h: np.ndarray, width: int) -> np.ndarray:
        if len(h) < width:
            return np.zeros(0, np.uint64)
        if len(h) > len(self.powers):
            for name, x in (("powers", self.multiplier), ("inverse", pow(self.multiplier, -1, 1 << 64))):
                setattr(self, name, np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(h), x, np.uint64))]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.powers[: len(h)])])
        x = (sums[width:] - sums[:-width]) * self.inverse[: len(h) - width + 1]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def samples(x: np.ndarray, window: int, fits: np.ndarray) -> np.ndarray:
    """Positions of the least of each window of neighbouring hashes that fits, the first of equal ones."""
    if len(x) < window:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(x, window).argmin(1)
    return np.unique((least + np.arange(len(least)))[fits[: len(least)]])


def spans_of(text: str, cuts: list) -> list[tuple[int, int]]:
    """Spans, in characters, of the words of these (from, to) with what follows them up to the next word or line; a line that goes whole takes its line feed along."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = words_of(data, np.array([0, len(data)]))
    gone = np.zeros(len(starts) + 1, np.int64)
    for c in cuts:
        gone[c[0]] += 1
        gone[c[1]] -= 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(gone)[:-1] > 0).astype(np.int8), [0]])))
    spans = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        start, end = int(starts[a]), int(ends[b - 1])
        follows = int(starts[b]) if b < len(starts) else len(raw)
        feed = raw.find(b"\n", end, follows)
        if feed < 0:
            end = follows
        else:
            end = feed + (start == 0 or raw[start - 1] == 10)
        spans.append((start, end))
    if len(raw) > len(text):
        place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        spans = [(int(place[a]), int(place[b])) for a, b in spans]
    return spans


def place(at: Column | str, row: Column | str) -> Column:
    """A word's number and its row's hash as one number, in the order of the first."""
    return F.shiftleft(F.col(at).cast("long") if isinstance(at, str) else at, 32) + (F.col(row) if isinstance(row, str) else row)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """For every document with words to cut: _id, _row (32 bits of the text's hash), _cuts (array of _from, _to in words)."""
    # a run of min_words words holds a whole window, and windows are no wider than units, so that neighbouring units leave no word out
    width = (min_words + 1) // 2
    window = min_words - width + 1 if min_words % 2 else width

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(MULTIPLIERS[0])
        for batch in sliced(batches):
            data, at = flat(batch.column(2))
            for a, b in blocks(at, BLOCK):
                own, part = at[a : b + 1] - at[a], _LOWER[data[at[a] : at[b]]]
                starts, ends, first = words_of(part, own)
                x = runs.of(hashes(part, starts, ends), width)
                ends_at = np.repeat(first[1:], np.diff(first))[: len(x)]
                p = samples(x, window, np.arange(len(x)) + window + width - 1 <= ends_at)
                text = np.searchsorted(first, p, "right") - 1
                take = pa.array(a + text)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array((p - first[text]).astype(np.int32)), pa.array(x[p].view(np.int64))], ["_id", "_row", "_at", "_h"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chains of repeated units: where they start and end here, and the document and word where they start in the first occurrence."""
        for batch in batches:
            near = batch.column(2)
            unit = near.flatten()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(near.offsets.to_numpy()))
            at, where = unit.field("_at").to_numpy().astype(np.int64), unit.field("_fplace").to_numpy()
            who = unit.field("_fid").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            fat, frow = where >> 32, where & 0xFFFFFFFF
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (who[1:] != who[:-1]) | (frow[1:] != frow[:-1]) | (at[1:] - at[:-1] != fat[1:] - fat[:-1]) | (at[1:] - at[:-1] > width)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(at))[: len(head)] - 1
            take = pa.array(doc[head])
            out = [batch.column(0).take(take), batch.column(1).take(take), pa.array(at[head]), pa.array(at[tail] + width), unit.field("_fid").take(pa.array(head)), pa.array(frow[head]), pa.array(fat[head])]
            yield pa.RecordBatch.from_arrays(out, ["_id", "_row", "_from", "_to", "_fid", "_frow", "_ffrom"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of all runs of min_words words that hold one of the units asked for."""
        runs = [Runs(m) for m in MULTIPLIERS]
        for batch in sliced(batches):
            data, at = flat(batch.column(2))
            for a, b in blocks(at, BLOCK):
                own, part = at[a : b + 1] - at[a], _LOWER[data[at[a] : at[b]]]
                starts, ends, first = words_of(part, own)
                asked = batch.column(3)[a:b]
                unit, doc = asked.flatten().to_numpy(), np.repeat(np.arange(b - a), np.diff(asked.offsets.to_numpy()))
                lo = first[doc] + np.maximum(0, unit - (min_words - width))
                hi = np.minimum(first[doc] + unit, first[doc + 1] - min_words)
                lo, hi = lo[hi >= lo], hi[hi >= lo]
                near = np.zeros(len(starts) + 2, np.int64)
                np.add.at(near, lo, 1)
                np.add.at(near, hi + 1, -1)
                p = np.flatnonzero(np.cumsum(near) > 0)
                h = hashes(part, starts, ends)
                one, two = runs[0].of(h, min_words)[p].view(np.int64), runs[1].of(h ^ (h >> np.uint64(7)), min_words)[p].astype(np.uint32).view(np.int32)
                text = np.searchsorted(first, p, "right") - 1
                take = pa.array(a + text)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array((p - first[text]).astype(np.int32)), pa.array(one), pa.array(two)], ["_id", "_row", "_pos", "_h", "_g"])

    row = F.xxhash64(F.col(text_col)).bitwiseAND(0xFFFFFFFF)
    slim = docs.select(F.col(id_col).alias("_id"), row.alias("_row"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    # rows equal in identifier and text are one document
    units = saved(slim.mapInArrow(memory_returned(sample), f"_id {kind}, _row long, _at int, _h long").select("_id", place("_at", "_row").alias("_place"), "_h"), "passage-units")
    first = units.groupBy("_h").agg(F.min(F.struct("_id", "_place")).alias("_f"), F.count("*").alias("_n")).filter("_n > 1")
    first = saved(first.select("_h", F.col("_f._id").alias("_fid"), F.col("_f._place").alias("_fplace")), "passage-first")
    again = units.join(first, "_h").filter(~(F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_place") == F.col("_fplace"))))
    again = again.select("_id", F.col("_place").bitwiseAND(0xFFFFFFFF).alias("_row"), F.struct(F.shiftright("_place", 32).cast("int").alias("_at"), "_fid", "_fplace").alias("_u"))
    near = again.groupBy("_id", "_row").agg(F.array_sort(F.collect_set("_u")).alias("_near"))
    chains = saved(near.mapInArrow(memory_returned(chain), f"_id {kind}, _row long, _from long, _to long, _fid {kind}, _frow long, _ffrom long"), "passage-chains")
    ends = [("_id", "_row", F.col("_from")), ("_id", "_row", F.col("_to") - width), ("_fid", "_frow", F.col("_ffrom")), ("_fid", "_frow", F.col("_ffrom") + F.col("_to") - F.col("_from") - width)]
    asked = chains.select(F.explode(F.array(*[F.struct(F.col(i).alias("_nid"), F.col(r).alias("_nrow"), at.alias("_at")) for i, r, at in ends])).alias("_x")).select("_x.*")
    asked = asked.groupBy("_nid", "_nrow").agg(F.collect_set("_at").alias("_asked"))
    held = slim.join(asked, slim["_id"].eqNullSafe(F.col("_nid")) & (F.col("_row") == F.col("_nrow"))).select("_id", "_row", "_text", "_asked")
    runs = saved(held.mapInArrow(memory_returned(exact), f"_id {kind}, _row long, _pos int, _h long, _g int").select("_id", place("_pos", "_row").alias("_place"), "_h", "_g"), "passage-runs")
    least = runs.groupBy("_h", "_g").agg(F.min(F.struct("_id", "_place")).alias("_f"), F.count("*").alias("_n")).filter("_n > 1")
    least = saved(least.select("_h", "_g", F.col("_f._id").alias("_fid"), F.col("_f._place").alias("_fplace")), "passage-least")
    more = runs.join(least, ["_h", "_g"]).filter(~(F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_place") == F.col("_fplace"))))
    where = lambda c: F.shiftright(c, 32)
    more = more.select("_id", F.col("_place").bitwiseAND(0xFFFFFFFF).alias("_row"), where("_place").alias("_from"), (where("_place") + min_words).alias("_to"), "_fid", F.col("_fplace").bitwiseAND(0xFFFFFFFF).alias("_frow"), where("_fplace").alias("_ffrom"))
    both = chains.filter(F.col("_to") - F.col("_from") >= min_words).unionByName(more)
    # a run that overlaps its own first occurrence leaves that one whole
    own = F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_row") == F.col("_frow"))
    cut = both.withColumn("_from", F.when(own, F.greatest("_from", F.col("_ffrom") + min_words)).otherwise(F.col("_from")))
    return cut.groupBy("_id", "_row").agg(F.collect_set(F.struct(F.col("_from").cast("int").alias("_from"), F.col("_to").cast("int").alias("_to"))).alias("_cuts"))


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, spans_col: str | None = "removed_spans", count_col: str | None = "n_removed") -> DataFrame:
    """docs with every repeated passage of min_words words or more cut out of the text, all other columns as they are.

    Words are runs of digits, letters and all other characters beyond U+00BF that aren't general or
    CJK punctuation, compared with A-Z lower-cased; what lies between them (line feeds too) doesn't
    count. A passage repeats when its words occurred earlier: in a document with a smaller
    identifier (null counts as smallest) or earlier in the same one. Every word that lies in such a
    passage goes, with the punctuation and blanks after it; a line that goes whole takes its line
    feed along. removed_spans lists what was cut as start-end pairs in the original text ("0-80,120-300";
    empty if nothing was), n_removed their number. A null text stays null. Rows equal in identifier
    and text count as one document; of other rows with one identifier, the earlier place in the text
    comes first. Columns of docs that have the added names are replaced. An empty table gives no
    rows. Texts may be of any length.
    """
    cuts = repeated_runs(docs, id_col, text_col, min_words)
    cuts = cuts.select(F.col("_id").alias("__pd_id"), F.col("_row").alias("__pd_row"), F.col("_cuts").alias("__pd_cuts"))
    joined = docs.join(cuts, docs[id_col].eqNullSafe(F.col("__pd_id")) & (F.xxhash64(docs[text_col]).bitwiseAND(0xFFFFFFFF) == F.col("__pd_row")), "left")

    @F.pandas_udf("text string, spans array<struct<start:long,end:long>>")
    def cut_out(texts, cuts):
        import pandas as pd

        out, where = [], []
        for t, c in zip(texts, cuts):
            spans, at, left = [], 0, []
            if t is not None and c is not None:
                spans = spans_of(t, [(x["_from"], x["_to"]) for x in c])
                for start, end in spans:
                    left.append(t[at:start])
                    at = end
                t = "".join([*left, t[at:]])
            out.append(t)
            where.append([{"start": a, "end": b} for a, b in spans])
        return pd.DataFrame({"text": pd.Series(out, dtype=object), "spans": where})

    joined = joined.withColumn("__pd_out", F.when(F.col("__pd_cuts").isNotNull(), cut_out(F.col(text_col), F.col("__pd_cuts"))))
    spans = F.col("__pd_out.spans")
    new = {text_col: F.when(F.col("__pd_cuts").isNull(), F.col(text_col)).otherwise(F.col("__pd_out.text"))}
    if spans_col:
        new[spans_col] = F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))
    if count_col:
        new[count_col] = F.coalesce(F.size(spans), F.lit(0)).cast("long")
    return joined.withColumns(new).drop("__pd_id", "__pd_row", "__pd_cuts", "__pd_out")
