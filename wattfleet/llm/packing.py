"""Mixture-controlled packing of tokenised documents by deficit round-robin.

Each source has a queue of tokens. A window of `window` tokens takes from every queue its share of
the mixture; what a share falls short of a whole token stays as that queue's deficit and is carried
into the next window, so after w windows a queue has given floor(w * window * share) tokens. That
count is closed-form, hence every task finds the windows of its own documents without seeing any
other document: it needs only how many tokens of the queue lie in earlier partitions (a prefix sum
over partitions) and the queues' totals. Windows follow each other without gaps and are cut into
sequences of a fixed length; only the last sequence of all is padded.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattfleet.llm.common import memory_returned, saved
from wattfleet.llm.words import word_encoder

#: Bytes of (partition, queue) offsets that are broadcast at most; beyond it they are joined by a shuffle, with the same result.
MAX_BROADCAST = 50 << 20


def scaled(n: int, part: np.ndarray, whole: int) -> np.ndarray:
    """floor(n * part / whole) without overflow, for part < whole < 2**53: long division by digits of ten bits of n."""
    found, rest = np.zeros(len(part), np.uint64), np.zeros(len(part), np.uint64)
    ten, divisor = np.uint64(10), np.uint64(whole)
    for shift in range(-(-n.bit_length() // 10) * 10 - 10, -1, -10):
        rest = (rest << ten) + part * np.uint64(n >> shift & 1023)
        found, rest = (found << ten) + rest // divisor, rest % divisor
    return found.astype(np.int64)


class Mixture:
    """How many tokens each queue has given after w windows, and where in the output they lie.

    totals: tokens by queue. weights: target shares by queue (default: the totals, so that all
    queues end together). A queue that has run dry gives its share up to the others from the next
    window on; queues without weight come last, by what they hold.
    """

    def __init__(self, totals: dict, window: int, weights: dict | None = None):
        self.number, self.window = {q: i for i, q in enumerate(totals)}, window
        self.totals = np.fromiter(totals.values(), np.int64, len(totals))
        wanted = self.totals if weights is None else np.array([weights.get(q, 0) for q in totals], np.int64)
        self.phases: list[tuple] = []  # first window; given before it; weights; their sum; tokens per window as whole numbers and rests
        w, given = 0, np.zeros_like(self.totals)
        while (left := given < self.totals).any():
            share = np.where(left, wanted, 0)
            if not (share > 0).any():
                share = np.where(left, self.totals - given, 0)
            shares, all_shares = share.tolist(), sum(share.tolist())
            each = [divmod(window * x, all_shares) for x in shares]
            self.phases.append((w, given, share, all_shares, np.array([x for x, _ in each], np.int64), np.array([x for _, x in each], np.uint64)))
            rest = (self.totals - given).tolist()
            w += min(-(-r * all_shares // (window * x)) for r, x in zip(rest, shares) if x > 0)
            given = self._given(len(self.phases) - 1, w)
        self.starts = [p[0] for p in self.phases]
        # windows kept by a task, so that they take some 50 MB at most
        self._at = lru_cache(maxsize=max(2, min(64, 2_000_000 // max(1, len(totals)))))(self._window)

    def _given(self, phase: int, w: int) -> np.ndarray:
        first, before, _, all_shares, whole, part = self.phases[phase]
        return np.minimum(self.totals, before + (w - first) * whole + scaled(w - first, part, all_shares))

    def _window(self, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        phase = bisect_right(self.starts, w) - 1
        one, two = self._given(phase, w), self._given(phase, w + 1)
        return one, two, one.sum() + np.cumsum(two - one) - (two - one)

    def at(self, w: int) -> tuple[dict, dict, dict]:
        """Of window w, by queue: the first token it takes, the token it ends before, and where the first lies in the output."""
        one, two, place = (dict(zip(self.number, x.tolist())) for x in self._at(w))
        return one, two, place

    def window_of(self, queue: int, token: int) -> int:
        """The window that takes the token of that number of the queue of that number."""
        phase = len(self.phases) - 1
        while self.phases[phase][1][queue] > token:
            phase -= 1
        first, before, share, all_shares = self.phases[phase][:4]
        return first + -(-(token + 1 - int(before[queue])) * all_shares // (self.window * int(share[queue]))) - 1

    def pieces(self, queue, start: int, n: int, sequence: int) -> Iterator[tuple[int, int, int]]:
        """The n tokens of a queue from start on, as (first, length, place in the output), cut at windows and sequences."""
        q, at = self.number[queue], start
        w = self.window_of(q, start) if n else 0
        while at < start + n:
            first, end, place = (int(x[q]) for x in self._at(w))
            while at < min(start + n, end):
                where = place + at - first
                m = min(start + n, end, at + sequence - where % sequence) - at
                yield at - start, m, where
                at += m
            w += 1


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Rows _part, _queue, _start (the queue's tokens before, within the partition), id, doc_tokens, _ids (little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = word_encoder(vocabulary), TaskContext.get().partitionId()
        end, size = np.array([end_id], enc.kind).tobytes(), enc.kind.itemsize
        so_far: dict[str, int] = {}
        for batch in batches:
            queues = batch.column(2).to_pylist()
            for k in range(0, batch.num_rows, 1000):
                ids = [x + end for x in enc.encode(batch.column(1)[k : k + 1000])]
                starts = []
                for q, x in zip(queues[k : k + 1000], ids):
                    starts.append(so_far.get(q, 0))
                    so_far[q] = starts[-1] + len(x) // size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), batch.column(2)[k : k + 1000], pa.array(starts, pa.int64()), batch.column(0)[k : k + 1000], pa.array([len(x) // size for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["_part", "_queue", "_start", id_col, "doc_tokens", "_ids"],
                )

    slim = docs.select(id_col, text_col, F.col("_queue"))
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(memory_returned(run), f"_part int, _queue string, _start long, `{id_col}` {kind}, doc_tokens long, _ids binary")


def pack(
    docs: DataFrame,
    vocabulary: str,
    sequence: int = 2048,
    end_id: int = 1,
    window: int = 65_536,
    weights: dict[str, int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_ids: bool = False,
) -> DataFrame:
    """Packs every document into sequences; one row per piece.

    A document is its text's ids (none for a null or empty text) and then end_id. Rows: id, start
    (ids of the document before the piece), length, ids_crc32 (of the ids as little-endian unsigned
    32-bit numbers), doc_tokens, sequence_id, offset, source queue, and the ids themselves if
    with_ids. Each id lies in exactly one piece, offsets have no gaps, and all sequences but the
    last are full. weights sets target shares by source; by default sources are mixed by their
    tokens. Null sources form a queue. Null or repeated identifiers are carried, each row being a
    document of its own; a very long one fills sequence after sequence. An empty table gives no rows;
    other columns are ignored. Every source has a
    queue of its own, however many there are; driver and tasks hold one total per source.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col), F.col(text_col), key.alias("_queue"))
    stored = saved(tokenised(slim, vocabulary, end_id, id_col, text_col, source_col), "pack-ids")
    sums = saved(stored.groupBy("_part", "_queue").agg(F.sum("doc_tokens").alias("_n")), "pack-sums")
    before = F.sum("_n").over(Window.partitionBy("_queue").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("_part", "_queue", F.coalesce(before, F.lit(0)).alias("_before"))
    totals = {r["_queue"]: r["t"] for r in sums.groupBy("_queue").agg(F.sum("_n").alias("t")).orderBy("_queue").collect()}
    if (sums.agg(F.sum(F.octet_length("_queue") + 100)).first()[0] or 0) <= MAX_BROADCAST:
        offsets = F.broadcast(offsets)
    mixture = (totals, window, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = Mixture(*mixture)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            rows = zip(*(batch.column(i).to_pylist() for i in range(1, 5)))
            for k, (queue, start, tokens, ids) in enumerate(rows):
                # ids have two or four bytes, and no document is without one
                wide = np.frombuffer(ids, f"<u{len(ids) // tokens}").astype("<u4")
                for first, n, where in mix.pieces(queue, start, len(wide), sequence):
                    part = wide[first : first + n]
                    for c, x in zip(out, (k, first, n, zlib.crc32(part), len(wide), where // sequence, where % sequence, part)):
                        c.append(x)
            cols = [batch.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(c, pa.int64()) for c in out[1:7])]
            cols += [pa.array(out[7], pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(cols, names_out)

    names_out = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    joined = stored.join(offsets, ["_part", "_queue"]).select(id_col, "_queue", (F.col("_start") + F.col("_before")).alias("_start"), "doc_tokens", "_ids")
    kinds = [joined.schema[0].dataType.simpleString(), *["long"] * 6, *["array<int>"] * with_ids]
    return joined.mapInArrow(memory_returned(run), ", ".join(f"`{n}` {k}" for n, k in zip(names_out, kinds)))
