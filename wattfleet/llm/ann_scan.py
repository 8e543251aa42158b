"""Approximate nearest neighbours by largest inner product: an adaptive dimension scan over probed lists.

Vectors get one more component that gives all the same length, so that the largest inner product
is the least distance. A random rotation spreads distance evenly over dimensions; rotated vectors
lie in column blocks. Within a probed list a query adds up partial distances block by block, and
after each block a hypothesis test drops every candidate whose partial distance is already too
large for the whole distance to come in below the query's bound. The bound is the k-th distance in
the query's nearest list, found first. What survives is scored on the original vectors.

The k-means centres are fitted on a bounded sample; every row is indexed. Equal vectors are one
entry with their k + 1 smallest identifiers, as no more of them can be among k nearest; so a vector
that makes up a third of the table is one row. Long lists are split into chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattfleet.llm.common import saved


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id, _v (doubles) of the rows that take part: identifier not null; vector not null or zero, of finite components."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("_v", lambda x: x != 0)
    return rows.select(F.col(id_col).alias("_id"), v.alias("_v")).filter(F.col("_id").isNotNull() & F.col("_v").isNotNull()).filter(good)


def arrays(c: pa.Array) -> np.ndarray:
    return np.stack(c.to_numpy(zero_copy_only=False)) if len(c) else np.zeros((0, 0))


class Space:
    """The lifted and rotated space with its centres."""

    def __init__(self, sample: np.ndarray, norm: float, lists: int, seed: int = 7, rounds: int = 10):
        rng = np.random.default_rng(seed)
        self.norm, self.d = norm, sample.shape[1] + 1
        self.turn = np.linalg.qr(rng.standard_normal((self.d, self.d)))[0].astype(np.float32)
        x = self.lift(sample)
        self.centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(rounds):
            own = self.nearest(x)
            sums, n = np.zeros_like(self.centres), np.bincount(own, minlength=len(self.centres))
            np.add.at(sums, own, x)
            self.centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.centres)

    def lift(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.norm**2 - (v * v).sum(1)))
        return np.concatenate([v, rest[:, None]], 1).astype(np.float32) @ self.turn

    def aim(self, q: np.ndarray) -> np.ndarray:
        """Queries, of the norm that candidates have; their length doesn't change the order."""
        q = q / np.sqrt((q * q).sum(1))[:, None] * self.norm
        return np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32) @ self.turn

    def distances(self, x: np.ndarray) -> np.ndarray:
        return (self.centres * self.centres).sum(1) - 2 * x @ self.centres.T

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.distances(x[k : k + 4096]).argmin(1) for k in range(0, len(x), 4096)] or [np.zeros(0, int)])


    def probes_for(self, sample: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
        """How many nearest lists hold `recall` of the k nearest of some sample rows, found by brute force within the sample.

        Neighbours lie closer in the whole table than in a sample of it, so the share found there is larger.
        """
        q, own = sample[:queries], self.nearest(self.lift(sample))
        scores = q @ sample.T
        scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
        true = np.argsort(-scores, 1, kind="stable")[:, : min(k, len(sample) - 1)]
        place = np.argsort(np.argsort(self.distances(self.aim(q)), 1, kind="stable"), 1)
        at = np.sort(place[np.arange(len(q))[:, None], own[true]].ravel())
        return int(at[min(len(at) - 1, int(recall * len(at)))]) + 1 if len(at) else 1


def scan(blocks: list[np.ndarray], q: np.ndarray, bound: float, k: int, width: int, error: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that survive all tests against `bound` (squared; infinite: the k-th distance of this list itself), and their distances."""
    d = len(q)
    n = len(blocks[0])
    alive, partial = np.arange(n), np.zeros(n, np.float32)
    for i, block in enumerate(blocks):
        part = block[alive] if len(alive) < n else block
        diff = part - q[i * width : (i + 1) * width]
        partial = partial + (diff * diff).sum(1)
        seen = min(d, (i + 1) * width)
        if seen < d and bound < np.inf:
            ok = partial <= bound * seen / d * (1 + error / seen**0.5) ** 2
            alive, partial = alive[ok], partial[ok]
    if bound == np.inf and n > k:
        bound = np.partition(partial, k - 1)[k - 1]
    ok = partial <= bound * (1 + 1e-4) + 1e-6
    return alive[ok], partial[ok]


def search(rows: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", max_sample: int = 20_000, list_size: int = 512, max_lists: int = 16_384, recall: float = 0.97, chunk: int = 4096, width: int = 16, error: float = 2.1, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose identifier is divisible by `every`.

    Candidates are all rows but the query's own; nearness is the inner product in double precision
    on the original vectors, nearest first, ties to the smaller identifier. Vectors that are null,
    zero, or hold a null or non-finite component take no part, nor do rows with a null identifier or
    vectors of another length than most. An identifier that repeats counts once, with its smallest
    vector. Every query gets k rows, or all candidates if there are fewer. Other columns are
    ignored; an empty table gives no rows.

    Bounds: centres are fitted on the max_sample rows with the smallest hash of their identifier,
    at most max_lists of them. Each query probes as many nearest lists as hold the share `recall` of
    the sample's own neighbours, and more until they hold enough candidates. A task compares some
    `chunk` vectors of a list with some `block` queries at a time; no neighbour is lost by either.
    """
    spark = rows.sparkSession
    out_schema = f"query_id {rows.schema[id_col].dataType.simpleString()}, rank int, vec_id {rows.schema[id_col].dataType.simpleString()}, score double"
    good = usable(rows, id_col, vector_col)
    length = good.groupBy(F.size("_v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    if length is None:
        return spark.createDataFrame([], out_schema)
    good = saved(good.filter(F.size("_v") == length["n"]).groupBy("_id").agg(F.min("_v").alias("_v")), "vectors")
    first = F.row_number().over(Window.partitionBy("_v").orderBy("_id"))
    distinct = good.withColumn("_n", first).filter(F.col("_n") <= k + 1).groupBy("_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids"))
    distinct = saved(distinct.select(F.element_at("_ids", 1).alias("_rep"), "_ids", "_v"), "distinct")
    total, norm2 = distinct.agg(F.count("*"), F.max(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))).first()[:]
    sample = np.array([r["_v"] for r in distinct.select("_v").orderBy(F.xxhash64("_rep")).limit(max_sample).collect()])
    space = Space(sample, float(norm2) ** 0.5, max(1, min(max_lists, total // list_size, len(sample) // 8)))
    probes = space.probes_for(sample, k, recall)
    kind = rows.schema[id_col].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = space.nearest(space.lift(arrays(batch.column(1)))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32())], ["_rep", "_v", "_list"])

    index = saved(distinct.select("_rep", "_v").mapInArrow(assign, f"_rep {kind}, _v array<double>, _list int"), "index")
    sizes = {r["_list"]: r["n"] for r in index.groupBy("_list").agg(F.count("*").alias("n")).collect()}
    size = np.array([sizes.get(i, 0) for i in range(len(space.centres))])
    parts = np.maximum(1, -(-size // chunk))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for every chunk of every list that a query probes."""
        for batch in batches:
            at, rank, where, piece = [], [], [], []
            if batch.num_rows:
                order = np.argsort(space.distances(space.aim(arrays(batch.column(1)))), 1, kind="stable")
                for i, lists in enumerate(order):
                    lists = lists[size[lists] > 0]
                    enough = int(np.searchsorted(np.cumsum(size[lists]), k + 1)) + 1
                    for r, x in enumerate(lists[: max(probes, enough)].tolist()):
                        for c in range(parts[x]):
                            at.append(i)
                            rank.append(r)
                            where.append(x)
                            piece.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int32()) for x in (rank, where, piece))], ["_q", "_qv", "_nth", "_list", "_piece"])

    asked = good.filter(F.pmod(F.col("_id"), F.lit(every)) == 0)
    queries = asked.join(distinct.select("_v", "_rep"), "_v").select("_id", "_rep")
    queries = saved(queries, "queries")
    probed = distinct.select("_rep", "_v").join(queries.select("_rep").distinct(), "_rep", "left_semi").mapInArrow(probe, f"_q {kind}, _qv array<double>, _nth int, _list int, _piece int")
    blocks = max(1, -(-queries.select("_rep").distinct().count() // block))
    probed = saved(probed.withColumn("_block", F.pmod(F.xxhash64("_q"), F.lit(blocks)).cast("int")), "probes")
    pieces = F.element_at(F.array(*[F.lit(int(x)) for x in parts]), F.col("_list") + 1) if len(parts) <= 64 else None
    if pieces is None:
        table = spark.createDataFrame([(i, int(n)) for i, n in enumerate(parts)], "_list int, _parts int")
        pieced = index.join(F.broadcast(table), "_list").withColumn("_piece", F.pmod(F.xxhash64("_rep"), F.col("_parts")).cast("int")).drop("_parts")
    else:
        pieced = index.withColumn("_piece", F.pmod(F.xxhash64("_rep"), pieces).cast("int"))

    pieced = pieced.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def found(some: DataFrame) -> DataFrame:
        def run(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
            q, at, score = [], [], []
            if len(asked) and len(held):
                own = arrays(held.column("_v").combine_chunks())
                x = space.lift(own)
                blocks = [np.ascontiguousarray(x[:, i : i + width]) for i in range(0, space.d, width)]
                qv = arrays(asked.column("_qv").combine_chunks())
                ids = np.array(held.column("_rep").to_pylist())
                for i, (aim, bound) in enumerate(zip(space.aim(qv), asked.column("_bound").to_pylist())):
                    live, _ = scan(blocks, aim, np.inf if bound is None else bound, k + 1, width, error)
                    s = (own[live] * qv[i]).sum(1)
                    best = np.lexsort((ids[live], -s))[: k + 1]
                    q += [i] * len(best)
                    at += live[best].tolist()
                    score += s[best].tolist()
            return pa.table([asked.column("_q").combine_chunks().take(pa.array(q, pa.int64())), held.column("_rep").combine_chunks().take(pa.array(at, pa.int64())), pa.array(score, pa.float64())], ["_q", "_rep", "_score"])

        return some.groupBy("_list", "_piece", "_block").cogroup(pieced.groupBy("_list", "_piece", "_block")).applyInArrow(run, f"_q {kind}, _rep {kind}, _score double")

    near = saved(found(probed.filter("_nth = 0").withColumn("_bound", F.lit(None).cast("double"))), "near")
    best = Window.partitionBy("_q").orderBy(F.desc("_score"), "_rep")
    # the k + 1st score bounds the distance: both vectors have the norm of the space
    q2 = F.aggregate("_qv", F.lit(0.0), lambda a, x: a + x * x)
    kth = near.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") == k + 1).select("_q", F.col("_score").alias("_kth"))
    others = probed.filter("_nth > 0").join(kth, "_q", "left").withColumn("_bound", 2 * F.lit(float(norm2)) - 2 * F.col("_kth") * F.sqrt(F.lit(float(norm2)) / q2)).drop("_kth")
    top = near.union(found(others)).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1).drop("_n")
    each = top.join(distinct.select("_rep", "_ids"), "_rep").select("_q", "_score", F.explode("_ids").alias("_id"))
    # k + 1 of a query vector's candidates are enough for each of its queries
    each = each.withColumn("_n", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("_score"), "_id"))).filter(F.col("_n") <= k + 1)
    best_list = each.groupBy("_q").agg(F.array_sort(F.collect_list(F.struct("_n", "_id", "_score"))).alias("_best"))
    out = queries.join(best_list, queries["_rep"] == best_list["_q"]).select("_id", F.slice(F.filter("_best", lambda x: x["_id"] != F.col("_id")), 1, k).alias("_best"))
    return out.select(F.col("_id").alias("query_id"), F.posexplode("_best").alias("_p", "_x")).select("query_id", (F.col("_p") + 1).alias("rank"), F.col("_x._id").alias("vec_id"), F.col("_x._score").alias("score"))
