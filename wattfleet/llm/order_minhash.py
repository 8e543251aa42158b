"""Order MinHash fingerprints: likeness of texts by what they hold and by the order in which it stands.

A text's k-mers of code points are numbered by occurrence, so that the second "the cat" isn't the
first one. Each of `hashes` hash functions selects the `picks` numbered k-mers of least hash; these
are put back into text order, and the hash of that tuple is one component of the fingerprint. Two
fingerprints agree in a component only where the same k-mers were selected in the same order, so
the share of equal components follows edit distance and not only the set of k-mers.

The neighbour of a document is the next one by descending identifier, so texts are dealt out by
ranges of (identifier, hash of the text): bounds come from a sort of these two numbers alone, the
first row of each range goes to the range before it as well, and a task then reads its rows in
order and holds two texts at a time. A text is shuffled once.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfleet.llm.fragments import sliced

WIDTH, HASHES, PICKS = 8, 64, 2
#: K-mers whose hashes are made at a time.
BLOCK = 8192
_RNG = np.random.default_rng(23)
_ODD = _RNG.integers(0, 1 << 32, 4096, np.uint64).astype(np.uint32) | np.uint32(1)
_XOR = _RNG.integers(0, 1 << 32, 4096, np.uint64).astype(np.uint32)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def numbered(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each k-mer with its occurrence number, in text order; a text shorter than a k-mer is one by itself, an empty one has none."""
    n = len(codes) - width + 1
    if not len(codes):
        return np.zeros(0, np.uint64)
    if n < 1:
        width, n = len(codes), 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = (h ^ codes[i : i + n]) * _A
        h ^= h >> np.uint64(29)
    h = mixed(h)
    # one sort of hash and place finds equal k-mers in text order
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    both = np.sort((h & ~low) | np.arange(n, dtype=np.uint64))
    same, place = both >> bits, (both & low).astype(np.int64)
    first = np.concatenate([[True], same[1:] != same[:-1]])
    start = np.flatnonzero(first)
    nth = np.empty(n, np.uint64)
    nth[place] = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    return np.where(nth > 0, mixed(h + nth * _A), h)


def order_minhash(codes: np.ndarray, width: int = WIDTH, hashes: int = HASHES, picks: int = PICKS) -> np.ndarray:
    """The fingerprint of a text of code points: `hashes` numbers of 32 bits."""
    x, rows = numbered(codes, width), np.arange(hashes)
    low, odd, xor = x.astype(np.uint32), _ODD[:hashes, None], _XOR[:hashes, None]
    places, values = [], []
    for a in range(0, len(low), BLOCK):
        h = (low[a : a + BLOCK] ^ xor) * odd
        for _ in range(min(picks, h.shape[1])):
            at = h.argmin(1)
            places.append(at + a)
            values.append(h[rows, at])
            h[rows, at] = 0xFFFFFFFF
    out = np.full(hashes, len(x) > 0, np.uint64) + rows.astype(np.uint64)
    if places:
        best = np.argsort(np.stack(values, 1), axis=1, kind="stable")[:, :picks]
        chosen = np.sort(np.take_along_axis(np.stack(places, 1), best, 1), axis=1)
        for column in chosen.T:
            out = mixed(out * _A + x[column])
    return (mixed(out) >> np.uint64(32)).astype(np.uint32)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal components."""
    return float((a == b).mean())


def hexed(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def place_of(identifier: int | None, h: int) -> tuple:
    """Sorts by descending identifier, null last, then by h."""
    return (identifier is None, 0 if identifier is None else -identifier, h)


def dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text, _h, _range, _extra: every row in its range, and the first of each range once more, as an extra row, in the one before (the first of all: in the last)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_h", F.xxhash64("_text"))
    ranges = rows.select("_id", "_h").repartitionByRange(n, F.desc_nulls_last("_id"), F.asc("_h")).withColumn("_p", F.spark_partition_id())
    # the first of each range, in its order: one pair of numbers for every partition
    top = F.struct(F.col("_id").isNotNull().alias("some"), F.col("_id").alias("id"), (-1 - F.col("_h")).alias("back"))
    starts = sorted(place_of(r.t.id, -1 - r.t.back) for r in ranges.groupBy("_p").agg(F.max(top).alias("t")).collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            where = [place_of(*x) for x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            found = [max(0, bisect.bisect_right(starts, w) - 1) for w in where]
            more = [i for i, w in enumerate(where) if w == starts[found[i]]]
            at = pa.array([*range(len(where)), *more], pa.int64())
            part = pa.array([*found, *((found[i] - 1) % len(starts) for i in more)], pa.int32())
            extra = pa.array([False] * len(where) + [True] * len(more))
            yield pa.RecordBatch.from_arrays([*batch.take(at).columns, part, extra], ["_id", "_text", "_h", "_range", "_extra"])

    out = rows.mapInArrow(run, "_id long, _text string, _h long, _range int, _extra boolean")
    return out.repartitionById(max(1, len(starts)), F.col("_range")).sortWithinPartitions("_range", "_extra", F.desc_nulls_last("_id"), "_h")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, hashes: int = HASHES, picks: int = PICKS) -> DataFrame:
    """Fingerprints of every text and of its edited text: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document's, by descending identifier; after the last comes the first, so a
    single document follows itself. near_edited and near_next are the likeness to the edited text's
    fingerprint and to the next document's.

    A null text counts as empty. Texts shorter than `width` are one k-mer; empty texts share one
    fingerprint, which no other text has but by chance. Rows that repeat an identifier, or have
    none (they come last), are documents of their own, ordered by a hash of their texts; equal rows
    give equal results. Very long texts are worked on in blocks of k-mers, an empty table gives no
    rows, and other columns, whatever their names, are left out. Identifiers are integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        # (range, identifier, text, its code points, its fingerprint) of the document that waits for the next one
        now, found = None, []
        for batch in sliced(batches, 200):
            for identifier, text, part, extra in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                codes = codes_of(text)
                mine = now[4] if now and now[2] == text else order_minhash(codes, width, hashes, picks)
                if now and now[0] == part:
                    n, half = len(now[3]), len(now[3]) // 2
                    edited = np.concatenate([now[3][: n - half], codes[:half]])
                    new = order_minhash(edited, width, hashes, picks)
                    digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
                    found.append((now[1], n, digest, hexed(now[4]), hexed(new), likeness(now[4], new), likeness(now[4], mine)))
                # of several equal first rows the range before needs one
                now = None if extra else (part, identifier, text, codes, mine)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * len(kinds), kinds)], names)
            found = []

    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt(docs, id_col, text_col).mapInArrow(run, schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, hashes: int = HASHES, picks: int = PICKS) -> DataFrame:
    """id and fingerprint of every text, without a shuffle; nulls, short and very long texts as in edited_fingerprints, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = pa.array([hexed(order_minhash(codes_of(t), width, hashes, picks)) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], [id_col, "fingerprint"])

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fingerprint string")
