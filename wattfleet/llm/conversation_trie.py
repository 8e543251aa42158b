"""A trie of conversations by their first turns, without materializing the conversations.

A conversation is rebuilt from the head of another one (its base) and its own turns after as many.
Prefixes are named by fingerprints: the turns' digests as a polynomial modulo three primes, which is
a monoid under concatenation. Two scans over the turns as they are stored give the fingerprint of
every stored prefix; that of a rebuilt prefix is the base's head, combined with the own prefix less
its own head, moved by the difference in length. So no rebuilt text is made, and a conversation of
any length is only narrow rows.

A node is a group of prefixes of equal depth and fingerprint. Every member holds the reference of
the stored turn that ends it and that turn's digest; a group is one node if all its members come
from one parent and end in equal turns, and with the parents verified alike, the prefixes are
equal. Should a group hold two, all is done anew with other multipliers.

What is summed over subtrees needs no walk through the tree: a conversation is the smallest member
of its nodes from some depth on, so a node's sum is that of its smallest member's own nodes from
here on, and for every other member one number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wattfleet.llm.common import forget, saved
from wattfleet.llm.segmented_scan import running

#: The three largest primes below 2^31.
PRIMES = (2147483647, 2147483629, 2147483587)
#: Own turns that a base's head replaces at most.
HEAD = 5
#: Identifiers in one piece of a list of ends.
PIECE = 10_000
KEYS = ["depth", "f0", "f1", "f2"]


def multipliers(attempt: int) -> list[int]:
    rng = np.random.default_rng(1009 + attempt)
    return [int(rng.integers(1 << 20, p - 1)) for p in PRIMES]


def turn_rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, chars and numbers from the digest of every turn's role and text: t0 .. t2 below the primes, and d0, d1 that no fingerprint uses."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.length(text).cast("long").alias("chars"), digest.alias("_d"))
    word = lambda a, n: F.conv(F.substring("_d", a, n), 16, 10).cast("long")
    numbers = {f"t{i}": word(1 + 8 * i, 8) % p for i, p in enumerate(PRIMES)}
    return rows.select("conv", "turn", "chars", *[v.alias(k) for k, v in numbers.items()], word(33, 15).alias("d0"), word(48, 15).alias("d1"))


def prefixes(turns: DataFrame, bases: Column, heads: Column, x: list[int]) -> DataFrame:
    """Every prefix of every rebuilt conversation, the empty one included: conv, depth, f0 .. f2, parent's p0 .. p2, chars and digest of its last turn, that turn's reference, and whether the conversation ends here.

    bases and heads: of a column conv, the conversation whose head comes first and how many turns that is (5 at most).
    """
    terms = {f"t{i}": (x[i], p) for i, p in enumerate(PRIMES)}
    stored = running(turns, "conv", [F.asc_nulls_first("turn"), "d0", "d1"], terms)
    fields = ["position", "chars", "d0", "d1", *[f"t{i}_run" for i in range(3)]]
    first = F.array_sort(F.collect_list(F.when(F.col("position") < HEAD, F.struct(*fields))))
    convs = saved(stored.groupBy("conv").agg(first.alias("own"), F.count("*").alias("n")).withColumns({"h": heads.cast("int"), "base": bases}), "trie-conversations")
    other = convs.select(F.col("conv").alias("base"), F.col("own").alias("head"))
    convs = convs.join(other, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(convs.schema["own"].dataType)), F.lit(1), F.col("h")))
    k = F.size("head")
    at_head, own_head = (lambda i: F.coalesce(F.try_element_at("head", F.when(k > 0, k))[f"t{i}_run"], F.lit(0))), (lambda i: F.coalesce(F.try_element_at("own", F.when(F.col("h") > 0, F.col("h")))[f"t{i}_run"], F.lit(0)))
    convs = convs.select("conv", "base", "h", "head", k.alias("k"), (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"), *[at_head(i).alias(f"a{i}") for i in range(3)], *[own_head(i).alias(f"b{i}") for i in range(3)])
    convs = saved(convs, "trie-parts")

    def row(depth: Column, f: list[Column], p: list[Column], chars: Column, digest: list[Column], ref: tuple[Column, Column]) -> list[Column]:
        return ["conv", depth.cast("long").alias("depth"), *[c.alias(f"f{i}") for i, c in enumerate(f)], *[c.alias(f"p{i}") for i, c in enumerate(p)], chars.alias("chars"), *[c.alias(f"d{i}") for i, c in enumerate(digest)], ref[0].alias("ref_conv"), ref[1].cast("long").alias("ref_position"), (F.col("length") == depth).alias("last")]

    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select(row(F.lit(0), [zero] * 3, [zero] * 3, zero, [zero] * 2, (none, none)))
    # a head's prefix without its last turn is the one before it
    before = lambda i: F.coalesce(F.try_element_at("head", F.when(F.col("e.position") > 0, F.col("e.position").cast("int")))[f"t{i}_run"], zero)
    taken = convs.filter("k > 0").withColumn("e", F.explode("head"))
    taken = taken.select(row(F.col("e.position") + 1, [F.col(f"e.t{i}_run") for i in range(3)], [before(i) for i in range(3)], F.col("e.chars"), [F.col("e.d0"), F.col("e.d1")], (F.col("base"), F.col("e.position"))))
    own = stored.join(convs.drop("head", "base"), "conv").filter("position >= h")
    moved, without = [], []
    for i, p in enumerate(PRIMES):
        by = F.element_at(F.array(*[F.lit(pow(x[i], -s, p)).cast("long") for s in range(HEAD + 1)]), F.col("h") - F.col("k") + 1)
        whole = (F.col(f"a{i}") + by * F.pmod(F.col(f"t{i}_run") - F.col(f"b{i}"), F.lit(p))) % p
        # the last turn's share is t * x^(depth - 1)
        moved.append(whole)
        without.append(F.pmod(whole - F.col(f"s{i}"), F.lit(p)))
    own = own.withColumn("at", F.col("position") - F.col("h") + F.col("k"))
    own = with_shares(own, x)
    own = own.select(row(F.col("at") + 1, moved, without, F.col("chars"), [F.col("d0"), F.col("d1")], (F.col("conv"), F.col("position"))))
    return saved(roots.union(taken).union(own), "trie-prefixes")


def with_shares(rows: DataFrame, x: list[int]) -> DataFrame:
    """Adds s0 .. s2: t * x^at modulo the primes."""
    names = rows.columns
    a, t = names.index("at"), [names.index(f"t{i}") for i in range(3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(a).to_numpy(zero_copy_only=False)
            places, back = np.unique(at, return_inverse=True)
            shares = [batch.column(c).to_numpy(zero_copy_only=False) * np.array([pow(x[i], int(n), p) for n in places], np.int64)[back] % p for (i, p), c in zip(enumerate(PRIMES), t)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(s, pa.int64()) for s in shares)], [*names, "s0", "s1", "s2"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "s0 long, s1 long, s2 long"])
    return rows.mapInArrow(run, schema)


def node_rows(rows: DataFrame) -> tuple[DataFrame, int]:
    """Groups of prefixes with their smallest member, members, members that end here; and how many groups hold unequal prefixes."""
    same = F.struct("p0", "p1", "p2", "chars", "d0", "d1")
    found = rows.groupBy(*KEYS).agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.count_if("last").alias("n_end"), F.min(same).alias("low"), F.max(same).alias("high"), F.min(F.struct("ref_conv", "ref_position")).alias("ref"))
    seen = Observation()
    out = saved(found.observe(seen, F.count_if(F.col("low") != F.col("high")).alias("unequal")).select(*KEYS, "conv", "n", "n_end", "low.p0", "low.p1", "low.p2", "low.chars", "ref.ref_conv", "ref.ref_position"), "trie-nodes")
    return out, seen.get["unequal"]


def end_hashes(rows: DataFrame) -> DataFrame:
    """KEYS, sha: SHA-256 of the ascending, comma-joined conversations that end in a node.

    Identifiers are sorted over all nodes by ranges and joined in pieces; a node of several pieces
    is hashed piece by piece, in order, so a node at which very many end is never held as a whole.
    """
    order = [*KEYS, "conv"]
    ends = rows.filter("last").select(order).repartitionByRange(*order).sortWithinPartitions(*order)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.int64()] * 5 + [pa.string()], [*KEYS, "start", "piece"]
        key, ids = None, []

        def made(done) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [()] * 6, kinds)], names)

        for batch in batches:
            done = []
            for *now, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key or len(ids) >= PIECE:
                    if ids:
                        done.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = now, []
                ids.append(conv)
            yield made(done)
        if ids:
            yield made([(*key, ids[0], ",".join(map(str, ids)))])

    pieces = saved(ends.mapInArrow(joined, "depth long, f0 long, f1 long, f2 long, start long, piece string"), "trie-ends")
    counts = pieces.groupBy(*KEYS).agg(F.count("*").alias("pieces"))
    long = counts.filter("pieces > 1").select(KEYS)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for batch in batches:
            done = []
            for *now, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    if h:
                        done.append((*key, h.hexdigest()))
                    key, h = now, hashlib.sha256(piece.encode())
                else:
                    h.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [()] * 5, [pa.int64()] * 4 + [pa.string()])], [*KEYS, "sha"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, h.hexdigest())], [*KEYS, "sha"])

    several = pieces.join(long, KEYS, "left_semi").select(*KEYS, "start", "piece").repartition(*KEYS).sortWithinPartitions(*KEYS, "start")
    one = pieces.join(long, KEYS, "left_anti").select(*KEYS, F.sha2(F.col("piece").cast("binary"), 256).alias("sha"))
    return one.union(several.mapInArrow(hashed, "depth long, f0 long, f1 long, f2 long, sha string"))


def prefix_trie(turns: DataFrame, bases: Column | None = None, heads: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", attempt: int = 0) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the stored turn that ends it (turn_conv_id, turn_position; null for the root).

    bases and heads are columns over the identifier `conv`: the conversation whose first turns come
    first, and how many (0 to 5); by default c - c % 100 and crc32(c) % 6, with % as Spark has it
    for negative c.

    Turns are ordered by turn, null first, equal ones by their digests. Null role or text counts as
    empty; rows without an identifier belong to no conversation and are left out. Repeated rows are
    turns of their own. Very long texts are read once, for their digests. A conversation or a node
    may have any share of all rows. An empty table has no node, not even a root. Other columns,
    whatever their names, are left out.
    """
    x = multipliers(attempt)
    conv = F.col("conv")
    rows = turn_rows(turns, conv_col, turn_col, role_col, text_col)
    rows = prefixes(rows, bases if bases is not None else conv - conv % 100, heads if heads is not None else F.crc32(conv.cast("string").cast("binary")) % 6, x)
    nodes, unequal = node_rows(rows)
    if unequal:
        forget(rows, nodes)
        return prefix_trie(turns, bases, heads, conv_col, turn_col, role_col, text_col, attempt + 1)
    # of each conversation: where it starts to be the smallest member, what its nodes save, and whether it stands for a leaf
    worth = (F.col("n") - 1) * F.col("chars")
    own = saved(nodes.groupBy("conv").agg(F.min(F.struct("depth", "p0", "p1", "p2")).alias("top"), F.sum(worth).alias("total"), F.max((F.col("n") == F.col("n_end")).cast("long")).alias("leaf")), "trie-own")
    branches = own.select("conv", F.col("top.depth").alias("depth"), (F.col("top.depth") - 1).alias("up"), *[F.col(f"top.p{i}").alias(f"p{i}") for i in range(3)], "total", "leaf").filter("depth > 0")
    shared = nodes.filter("n > 1")
    above = shared.select(F.col("depth").alias("up"), *[F.col(f"f{i}").alias(f"p{i}") for i in range(3)], F.col("conv").alias("parent"))
    parents = branches.join(above, ["up", "p0", "p1", "p2"]).select("conv", "depth", "parent")
    # from here on in its own nodes
    below = running(shared.select("conv", "depth", worth.alias("worth")), "conv", [F.desc("depth")], {"worth": None}).select("conv", "depth", "worth_run")
    others = rows.select("conv", *KEYS).join(branches.select("conv", F.col("depth").alias("top"), "total", "leaf"), "conv").filter("depth < top AND (total > 0 OR leaf > 0)").groupBy(*KEYS).agg(F.sum("total").alias("total"), F.sum("leaf").alias("leaves"))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(f"p{i}").alias(f"f{i}") for i in range(3)]).agg(F.count("*").alias("children"))
    leaf = own.select("conv", "leaf")
    out = nodes.join(parents, ["conv", "depth"], "left").join(below, ["conv", "depth"], "left").join(leaf, "conv")
    out = out.join(children, KEYS, "left").join(others, KEYS, "left").join(end_hashes(rows), KEYS, "left")
    long = lambda c, d: F.coalesce(c, F.lit(d)).cast("long")
    return out.select(
        F.col("conv").alias(conv_col),
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        long("children", 0).alias("n_children"),
        (F.col("leaf") + long("leaves", 0)).cast("long").alias("n_leaves"),
        (long("worth_run", 0) + long("total", 0)).cast("long").alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        F.col("ref_conv").alias("turn_conv_id"),
        F.col("ref_position").alias("turn_position"),
    )
