"""MinHash near-dedup by an LSH forest: sorted signature orders, neighbours by longest common prefix.

Documents with the same shingle set are one representative. Each tree of the forest sorts the
representatives' signatures in its own order of hash functions; the sort is a range partition, so a
dense region is spread over tasks. Neighbours in an order share the longest prefixes: scanning on
from a signature meets partners in order of falling prefix length. How deep the shared prefix must
be adapts to the region: down to `base` values where it is sparse, only the deepest where it is
dense. Three passes:

1. direct neighbours in the first orders become candidates, and verified links join into components;
2. all orders are walked: from each signature, past members of its own component, on to
   `reach` others that share `base` values. A dense region of copies is one component by now and
   yields no pair;
3. signatures whose walk in pass 2 hit the limit lie in regions that many documents of other
   components share. These go through another forest of more and deeper trees, where every region
   is compared set by set, in blocks, but for pairs of one component. A walk that is cut off where
   a task's rows end counts as one at the limit.

Candidates become links only when the full shingle sets agree to the threshold; no link rests on
signatures. Sets are not stored: those of candidates are made again from their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfleet.llm.common import forget, memory_returned, saved
from wattfleet.llm.components import components
from wattfleet.llm.fragments import blocks, flat, hashes
from wattfleet.llm.words import CLASSES, LOWER

#: Bytes of text that are cut into words at a time.
BLOCK = 1 << 19
#: Identifiers that are broadcast at most, some 16 bytes each; beyond it they are joined by a shuffle.
MAX_BROADCAST = 1_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def sets_of(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct runs of `width` words; a word is a run without ASCII white space, A-Z lower-cased."""
    data, at = flat(texts)
    for a, b in blocks(at, BLOCK):
        own, low = at[a : b + 1] - at[a], LOWER[data[at[a] : at[b]]]
        word = CLASSES[low] != CLASSES[32]
        begins = np.zeros(len(low) + 1, bool)
        begins[own] = True
        starts = np.flatnonzero(word & ~(np.append(False, word[:-1]) & ~begins[:-1]))
        ends = np.flatnonzero(word & ~(np.append(word[1:], False) & ~begins[1:])) + 1
        h, first = hashes(low, starts, ends), np.searchsorted(starts, own).tolist()
        runs = joined(h, width)
        for x, y in zip(first, first[1:]):
            yield np.unique(runs[x : y - width + 1] if y - x >= width else joined(h[x:y], y - x))


def joined(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k of these; of no word if k is 0."""
    n = len(h) - k + 1 if k else 0
    out = np.full(max(0, n), k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k if n > 0 else 0):
            out = mixed(out * ODD + h[i : i + n])
    return out


def signature(shingles: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The least of (mult * x + add) by hash function, upper 32 bits; rows in blocks, so that long texts stay small."""
    out = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 1024):
            np.minimum(out, (shingles[k : k + 1024, None] * mult + add).min(0), out=out)
    return (out >> np.uint64(32)).astype(">u4")


def functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def shingled(docs: DataFrame, width: int, values: int, id_col: str, text_col: str) -> DataFrame:
    """_id, n_shingles, _key (digest of the set; null if empty), _sig (the signature), _sketch (a byte of each of its values)."""
    mult, add = functions(values, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                sizes, keys, sigs = [], [], []
                for x in sets_of(batch.column(1)[k : k + 1000], width):
                    sizes.append(len(x))
                    keys.append(digest(x))
                    sigs.append(signature(x, mult, add) if len(x) else None)
                cols = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())]
                cols += [pa.array([None if x is None else x.astype(t).tobytes() for x in sigs], pa.binary()) for t in (">u4", "u1")]
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1000], *cols], ["_id", "n_shingles", "_key", "_sig", "_sketch"])

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return slim.mapInArrow(memory_returned(run), f"_id {slim.schema[0].dataType.simpleString()}, n_shingles long, _key binary, _sig binary, _sketch binary")


def digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.sha256(shingles.tobytes()).digest()[:16] if len(shingles) else None


def whole_sets(docs: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """The sets of documents with these identifiers (ids: _id), made again from their texts: _id, n_shingles, _key, _set (64-bit hashes in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                sets = list(sets_of(batch.column(1)[k : k + 500], width))
                cols = [pa.array([len(x) for x in sets], pa.int64()), pa.array(map(digest, sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 500], *cols], ["_id", "n_shingles", "_key", "_set"])

    slim = some_of(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ids, ["_id"])
    sets = slim.mapInArrow(memory_returned(run), f"_id {slim.schema[0].dataType.simpleString()}, n_shingles long, _key binary, _set binary")
    return sets.filter("_key IS NOT NULL").dropDuplicates(["_id", "_key"])


def hashes_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def deeper(sets: DataFrame, values: int, seed: int) -> DataFrame:
    """Signatures by other functions, from packed sets: _id, n_shingles, _sig."""
    mult, add = functions(values, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [signature(mixed(hashes_of(x.as_py())), mult, add).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.binary())], ["_id", "n_shingles", "_sig"])

    slim = sets.select("_id", "n_shingles", "_set")
    return slim.mapInArrow(memory_returned(run), f"_id {slim.schema[0].dataType.simpleString()}, n_shingles long, _sig binary")


def orders(reps: DataFrame, trees: range, base: int, depth: int) -> DataFrame:
    """One row per representative and tree: _tree, _sig (depth values, big-endian so that they sort), _id, _comp, n_shingles.

    Tree t takes the signature's values from t * base on, going round at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                some = batch.slice(k, 2000)
                sigs = np.frombuffer(b"".join(x.as_py() for x in some.column(3)), ">u4").reshape(some.num_rows, -1)
                again = pa.array(np.tile(np.arange(some.num_rows), len(trees)))
                rows = [np.take(sigs, [(t * base + i) % sigs.shape[1] for i in range(depth)], 1).tobytes() for t in trees]
                values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * depth), some.num_rows * len(trees), [None, pa.py_buffer(b"".join(rows))]).cast(pa.binary())
                cols = [pa.array(np.repeat(np.array(trees, np.int32), some.num_rows)), values, *(some.column(i).take(again) for i in range(3))]
                yield pa.RecordBatch.from_arrays(cols, ["_tree", "_sig", "_id", "_comp", "n_shingles"])

    slim = reps.select("_id", "_comp", "n_shingles", "_sig")
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(memory_returned(run), f"_tree int, _sig binary, _id {kind}, _comp {kind}, n_shingles long")


def walk(region: np.ndarray, comp: np.ndarray, size: np.ndarray, reach: int, percent: int, fresh: int = 0, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) met by walks over sorted rows, the rows whose walk ended at `reach` with more to meet, and those whose walk ran off the end of the rows.

    A walk stays in its row's region and passes whole runs of its own component (-1: none) at once.
    Pairs whose sizes rule the threshold out are met but left out; so are pairs on one side of
    `fresh`, if that is given, and all pairs of rows at the limit where `whole` is set.
    """
    n = len(region)
    change = np.flatnonzero((comp[1:] != comp[:-1]) | (comp[1:] < 0) | (region[1:] != region[:-1])) + 1
    after = np.append(change, n)[np.searchsorted(change, np.arange(n), "right")]
    i = np.arange(fresh or n)
    p = i + 1
    a, b, off = [], [], [np.zeros(0, np.int64)]

    def inside() -> None:
        nonlocal i, p
        off.append(i[p >= n])
        i, p = i[p < n], p[p < n]

    for step in range(reach + 1):
        inside()
        own = (comp[i] >= 0) & (comp[p] == comp[i]) & (region[p] == region[i])
        p = np.where(own, after[p], p)
        inside()
        ok = region[p] == region[i]
        i, p = i[ok], p[ok]
        if step < reach:
            fits = (p >= fresh) & (100 * np.minimum(size[i], size[p]) >= percent * np.maximum(size[i], size[p]))
            a.append(i[fits])
            b.append(p[fits])
            p = p + 1
    a, b = np.concatenate(a), np.concatenate(b)
    if whole and len(i):
        stays = ~np.isin(a, i)
        a, b = a[stays], b[stays]
    return a, b, i, np.concatenate(off)


def regions(tree: np.ndarray, sig: pa.Array, base: int) -> np.ndarray:
    """Numbers rows by tree and the first `base` values of their signatures, in sorted order."""
    lead = np.frombuffer(b"".join(x[: 4 * base] for x in sig.to_pylist()), ">u4").reshape(len(tree), base)
    new = np.append(True, (tree[1:] != tree[:-1]) | (lead[1:] != lead[:-1]).any(1)) if len(tree) else np.zeros(0, bool)
    return np.cumsum(new)


def walked(rows: DataFrame, base: int, reach: int, percent: int, whole: bool = True) -> DataFrame:
    """Pairs (a, b) of neighbours in the orders with their components (ca, cb), and (a, null) with _tree and _sig for signatures whose walk didn't end.

    rows: as orders() makes them. Where a range partition ends, the last rows of one and the first
    of the next that isn't empty meet in a second step, over these rows alone. A walk that gets no
    further there, or starts too far before the end to be taken along, counts as one that didn't end.
    """
    kind = rows.schema["_id"].dataType.simpleString()
    margin, most = 8 * reach, 1_000_000
    plain = ["_tree", "_sig", "_id", "_comp", "n_shingles"]
    names = ["_part", "_side", *plain, "a", "b", "ca", "cb"]

    def made(t: pa.Table, fresh: int = 0, carried: int = 0) -> pa.Table:
        """What walks over t find; `carried` rows at its end may walk on elsewhere."""
        t = t.combine_chunks()
        ids, known = t.column("_id").combine_chunks(), t.column("_comp").combine_chunks()
        comp = known.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        i, j, full, off = walk(regions(t.column("_tree").to_numpy(), t.column("_sig").combine_chunks(), base), comp, t.column("n_shingles").to_numpy(), reach, percent, fresh, whole)
        open_ = np.union1d(full, off[off < (fresh or len(t)) - carried])
        own, at = pc.coalesce(known, ids), t.take(pa.array(open_))
        some = lambda x, c: pa.chunked_array([x.take(pa.array(c)), pa.nulls(len(open_), x.type)])
        none = lambda c: pa.nulls(len(i), t.schema.field(c).type)
        return pa.table([pa.chunked_array([none(c), *at.column(c).chunks]) for c in ("_tree", "_sig")] + [pa.chunked_array([ids.take(pa.array(i)), *at.column("_id").chunks]), some(ids, j), some(own, i), some(own, j)], ["_tree", "_sig", "a", "b", "ca", "cb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        some: list[pa.RecordBatch] = []
        head = tail = None

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal head, tail
            t = pa.Table.from_batches(some)
            t = pa.concat_tables([tail, t]) if tail is not None else t
            head = t.slice(0, margin) if head is None else head
            tail = t.slice(max(0, len(t) - margin))
            some.clear()
            yield from padded(made(t, carried=len(tail))).to_batches()

        for batch in batches:
            if batch.num_rows:
                some.append(batch)
            if sum(x.num_rows for x in some) >= most:
                yield from out()
        if some:
            yield from out()
        if head is not None:
            for t, side in ((head, 1), (tail, 0)):
                t = t.append_column("_part", pa.array([part] * len(t), pa.int32())).append_column("_side", pa.array([side] * len(t), pa.int32()))
                yield from padded(t).to_batches()

    def padded(t: pa.Table) -> pa.Table:
        own = t.schema.field("a" if "a" in t.column_names else "_id").type
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), own, own, pa.int64(), own, own, own, own]
        return pa.table([t.column(n) if n in t.column_names else pa.nulls(len(t), x) for n, x in zip(names, types)], names)

    schema = f"_part int, _side int, _tree int, _sig binary, _id {kind}, _comp {kind}, n_shingles long, a {kind}, b {kind}, ca {kind}, cb {kind}"
    parted = rows.select(plain).repartitionByRange("_tree", "_sig", "_id").sortWithinPartitions("_tree", "_sig", "_id")
    found = saved(parted.mapInArrow(memory_returned(run), schema), "walk")

    def over(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_side", "ascending"), ("_tree", "ascending"), ("_sig", "ascending"), ("_id", "ascending")])
        fresh = sum(s == 0 for s in t.column("_side").to_pylist())
        return made(t, fresh) if 0 < fresh < len(t) else made(t.slice(0, 0))

    ends = found.filter("_part IS NOT NULL")
    # partitions with rows, one number each: the first rows of one go to the end of the one before it
    parts = [r[0] for r in ends.select("_part").distinct().orderBy("_part").collect()]
    edge = F.col("_part") if len(parts) < 2 else F.when(F.col("_side") == 0, F.col("_part")).otherwise(F.element_at(F.create_map(*[F.lit(x) for pair in zip(parts, [-1, *parts]) for x in pair]), F.col("_part")))
    edges = ends.select(edge.alias("_edge"), "_side", *plain).groupBy("_edge").applyInArrow(over, f"_tree int, _sig binary, a {kind}, b {kind}, ca {kind}, cb {kind}")
    return found.filter("_part IS NULL").select("_tree", "_sig", "a", "b", "ca", "cb").union(edges)


def candidates(walks: DataFrame) -> DataFrame:
    """Distinct pairs of different identifiers, a < b, with their components."""
    turn = F.col("a") < F.col("b")
    each = walks.filter("b IS NOT NULL AND a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turn, F.col("ca")).otherwise(F.col("cb")).alias("ca"), F.when(turn, F.col("cb")).otherwise(F.col("ca")).alias("cb"))
    return each.groupBy("a", "b").agg(F.min("ca").alias("ca"), F.min("cb").alias("cb"))


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches agree in no fewer values than six standard deviations below the threshold."""
    sketch = reps.select("_id", "_sketch")
    both = pairs.join(sketch.withColumnsRenamed({"_id": "a", "_sketch": "sa"}), "a").join(sketch.withColumnsRenamed({"_id": "b", "_sketch": "sb"}), "b")
    kind, p = pairs.schema["a"].dataType.simpleString(), percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in batch.columns[2:])
                n = x.shape[1]
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= n * p - 6 * (n * p * (1 - p)) ** 0.5))

    return both.select("a", "b", "sa", "sb").mapInArrow(memory_returned(run), f"a {kind}, b {kind}")


def some_of(sets: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """The sets of these keys; few enough keys come to the sets, so that these aren't shuffled whole."""
    return sets.join(F.broadcast(keys) if keys.count() <= MAX_BROADCAST else keys, names, "left_semi")


def verified(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets agree: 100 * intersection >= percent * union. sets: gives the sets of identifiers; of several with one identifier each counts."""
    pairs = saved(pairs, "pairs")
    ids = saved(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct(), "wanted")
    whole = saved(sets(ids).select("_id", "_set"), "wanted-sets")
    full = pairs.join(whole.withColumnsRenamed({"_id": "a", "_set": "sa"}), "a").join(whole.withColumnsRenamed({"_id": "b", "_set": "sb"}), "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = hashes_of(x.as_py()), hashes_of(y.as_py())
                n = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * n >= percent * (len(x) + len(y) - n))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    out = saved(full.select("a", "b", "sa", "sb").mapInArrow(memory_returned(run), f"a {kind}, b {kind}"), "verified")
    forget(pairs, ids, whole)
    return out


def agreed(walks: DataFrame, by: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links among the pairs met. Of two components one pair is tried first; of those that it links no other pair is needed."""
    pairs = saved(candidates(walks), "candidates")
    tried = pairs.groupBy("ca", "cb").agg(F.min(F.struct("a", "b")).alias("_x")).select("ca", "cb", "_x.*")
    tried = saved(tried, "witnesses")
    linked = verified(likely(tried.select("a", "b"), by, percent), sets, percent)
    rest = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
    if rest.isEmpty():
        return linked
    merged = components(tried.join(linked, ["a", "b"]).select("ca", "cb"), "ca", "cb")
    now = lambda c: merged.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    apart = rest.join(now("ca"), "ca", "left").join(now("cb"), "cb", "left").filter(F.coalesce("_ca", "ca") != F.coalesce("_cb", "cb"))
    out = linked.union(verified(likely(apart.select("a", "b"), by, percent), sets, percent))
    forget(pairs, tried)
    return out


def mixed_regions(rows: DataFrame) -> DataFrame:
    """Regions (_tree, _lead) with members of several components, the largest of these and their sizes. rows: _tree, _lead, _own."""
    each = rows.groupBy("_tree", "_lead", "_own").agg(F.count("*").alias("_n"))
    each = each.groupBy("_tree", "_lead").agg(F.max_by("_own", "_n").alias("_largest"), F.max("_n").alias("_most"), F.sum("_n").alias("_all"))
    return each.filter("_most < _all").select("_tree", "_lead", "_largest", "_all")


def settled(rows: DataFrame, sets: DataFrame, percent: int, block: int = 2048) -> DataFrame:
    """Pairs (a, b) between the components of each region that may be links, found by comparing sets.

    rows: _tree, _lead, _id, _own (the component). A region is dealt out in blocks of about `block`
    signatures, and every signature outside its largest component meets every block, in blocks as well, which counts
    common shingles by its own postings: of two components one isn't the largest. Of each other
    component the nearest is enough. Regions of one component are done. Sets are compared by 32 bits
    of their hashes here, which can only make a pair seem nearer, so no link is left out: this is
    the exact way for regions in which walks don't end.
    """
    keys = ["_tree", "_lead"]
    rows = saved(rows, "regions")
    sizes = saved(mixed_regions(rows).select(*keys, "_largest", F.ceil(F.col("_all") / block).alias("_blocks")), "region-sizes")
    members = rows.join(sizes, keys)
    kind = sets.schema["_id"].dataType.simpleString()

    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = [(hashes_of(x.as_py()) >> np.uint64(32)).astype(np.uint32).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(small, pa.binary())], ["_id", "n_shingles", "_set"])

    whole = sets.select("_id", "n_shingles", "_set").mapInArrow(memory_returned(shorter), f"_id {kind}, n_shingles long, _set binary")
    # both sides are dealt out, so that no group is larger than two blocks
    mine, all_ = F.pmod(F.xxhash64("_id"), F.col("_blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    held = members.withColumn("_block", mine).withColumn("_asking", all_).select(*keys, "_block", "_asking", "_id", "_own").join(whole, "_id")
    wanted = members.filter(F.col("_own") != F.col("_largest")).withColumn("_asking", mine).withColumn("_block", all_).select(*keys, "_block", "_asking", "_id", "_own").join(whole, "_id")
    wanted = wanted.select(*[F.col(c).alias(f"q{c}") for c in ("_tree", "_lead", "_block", "_asking", "_id", "_own", "n_shingles", "_set")])

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        ids, out_a, out_b = held.column("_id").to_pylist(), [], []
        own = [np.frombuffer(x, np.uint32) for x in held.column("_set").to_pylist()]
        comps = held.column("_own").to_pylist()
        sizes = held.column("n_shingles").to_numpy()
        shingles = np.concatenate(own) if own else np.zeros(0, np.uint32)
        order = np.argsort(shingles, kind="stable")
        shingles, doc = shingles[order], np.repeat(np.arange(len(own)), [len(x) for x in own])[order]
        for me, comp, n, x in zip(*(asked.column(c).to_pylist() for c in ("q_id", "q_own", "qn_shingles", "q_set"))):
            x = np.frombuffer(x, np.uint32)
            lo, hi = np.searchsorted(shingles, x, "left"), np.searchsorted(shingles, x, "right")
            k = hi - lo
            both = np.bincount(doc[np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(k.sum())], minlength=len(own))
            near = np.flatnonzero(100 * both >= percent * (n + sizes - both))
            witness = {comps[i]: ids[i] for i in near[np.argsort(both[near] / (n + sizes[near]), kind="stable")].tolist()}
            for c, i in witness.items():
                if c != comp:
                    out_a.append(me)
                    out_b.append(i)
        types = held.schema.field("_id").type
        return pa.table([pa.array(out_a, types), pa.array(out_b, types)], ["a", "b"])

    keys = [*keys, "_block", "_asking"]
    return wanted.groupBy(*[f"q{k}" for k in keys]).cogroup(held.groupBy(*keys)).applyInArrow(meet, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", trees: int = 24, base: int = 4, depth: int = 7, first_trees: int = 3, reach: int = 8, deep_trees: int = 64, deep_base: int = 8, block: int = 2048) -> DataFrame:
    """Groups of near-duplicate documents: id, n_shingles, component_id, kept.

    A document's set is its distinct runs of `width` words (with fewer words, the whole sequence as
    one). Documents are linked when 100 * intersection >= percent * union, confirmed on full sets.
    component_id is the smallest identifier that can be reached, kept says that it is the document's
    own. Texts that are null or without words have empty sets and are linked with nothing. A null
    identifier takes no part in links: its component_id is null and it is kept. Rows that repeat an
    identifier are linked like one document: the union of their links. An empty table gives no rows.
    Texts may be of any length; docs is read more than once and must give the same rows each time.

    A pair at 80 % shares 4 of 4 values in one of 24 trees with probability 0.999997, and at 85 %
    with 0.9999999. Where regions are dense the deeper forest decides: 8 of 8 values in one of 64 trees
    (0.99999 at 80 %). There is no limit on partners: walks that reach theirs hand the region on, and
    a pair that fails a test on sketches is more than six standard deviations below the threshold.
    """
    rows = saved(shingled(docs, width, trees * base, id_col, text_col), "shingles")
    sets = rows.filter("_key IS NOT NULL AND _id IS NOT NULL")
    groups = sets.groupBy("_key").agg(F.min("_id").alias("_rep"))
    member = saved(rows.select("_id", "n_shingles", "_key").join(groups, "_key", "left"), "members")
    chosen = member.filter("_id = _rep").select("_id", "_key").distinct()
    reps = saved(sets.join(chosen, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]).drop("_key"), "signatures")
    forget(rows)
    # identifiers that repeat with different texts hang together through themselves
    again = member.filter("_rep IS NOT NULL").groupBy("_id").agg(F.min("_rep").alias("a"), F.max("_rep").alias("b")).filter("a < b").select("a", "b")

    def whole(ids: DataFrame) -> DataFrame:
        return whole_sets(docs, ids, width, id_col, text_col)

    def known(some: DataFrame, comp: DataFrame) -> DataFrame:
        return some.join(comp.select(F.col("node").alias("_id"), F.col("component").alias("_comp")), "_id", "left")

    alone = reps.withColumn("_comp", F.lit(None).cast(reps.schema["_id"].dataType))
    walks = walked(orders(alone, range(0, first_trees), base, depth), base, 1, percent, False)
    links = saved(verified(likely(candidates(walks).select("a", "b"), reps, percent), whole, percent).union(again), "links")
    walks = walked(orders(known(reps, components(links)), range(trees), base, depth), base, reach, percent)
    links = saved(links.union(agreed(walks, reps, whole, percent)), "links")

    def regions_of(some: DataFrame, n: int, depth: int) -> DataFrame:
        return orders(known(some, comp), range(n), depth, depth).select("_tree", F.col("_sig").alias("_lead"), "_id", F.coalesce("_comp", "_id").alias("_own"))

    comp = components(links)
    dense = saved(walks.filter("b IS NULL").select("_tree", F.substring("_sig", 1, 4 * base).alias("_lead")).distinct(), "dense")
    if not dense.isEmpty():
        # all that share a dense signature's first values in some order, with members of another component among them, go through a deeper forest
        near = saved(some_of(regions_of(reps, trees, base), dense, ["_tree", "_lead"]), "near")
        inside = saved(near.join(mixed_regions(near), ["_tree", "_lead"], "left_semi").select("_id").distinct(), "inside")
        own = saved(whole(inside).join(chosen, ["_id", "_key"], "left_semi").drop("_key"), "inside-sets")
        # whose regions are settled exactly
        pairs = settled(regions_of(deeper(own, deep_trees * deep_base, 2), deep_trees, deep_base), own, percent, block).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = saved(links.union(verified(pairs, whole, percent)), "links")
        forget(near, inside, own)
        comp = components(links)
    forget(reps)
    out = member.join(comp.select(F.col("node").alias("_rep"), "component"), "_rep", "left")
    # a representative is its group's smallest identifier, so a component's smallest is the smallest of all
    own = F.when(F.col("_id").isNotNull(), F.coalesce("component", "_rep", "_id"))
    return out.select(F.col("_id").alias(id_col), "n_shingles", own.alias("component_id"), F.col("_id").eqNullSafe(own).alias("kept"))
