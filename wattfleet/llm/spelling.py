"""Spelling variants: words at one edit from each other, by dynamic programming over sorted lists.

Of two words at one edit, the shorter of n code points, the first n // 2 code points agree or the
last n // 2 do, as the edit can't be in both halves. So every word stands in a list sorted forwards
and in one sorted backwards, once for each n // 2 it can have a partner with, and a word is compared
only with those that share that many leading code points.

A list is scanned with all of its words as queries at once, by depth: words that share a prefix are
a range of the list, bounded by adjacent longest common prefixes, and have one row of the edit
matrix in common, of which only the band of width one is kept. A range in whose row nothing is
below two is skipped with all that is in it.

Lists are cut into blocks of a bounded number of words, wherever that falls. Where a prefix goes on
over several blocks, its words are sent to the other blocks as well, but only to those whose common
prefix is within one edit of the word's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wattfleet.llm.common import ascii_lower, forget, saved

#: Words of a block, as a power of two, and queries that are worked on at a time.
BLOCK_BITS, QUERIES = 13, 4096
_NONE = np.uint32(0xFFFFFFFF)
RUN = "[A-Za-zÀ-ÿ]+"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, noise: int = 97) -> DataFrame:
    """word, n: the runs of letters of whole texts, A-Z lower-cased, and how often they occur.

    One run in about `noise` loses a code point, as chosen by a checksum of identifier and run
    (noise 0: none does). Counts have partial sums before the shuffle. Null texts have no words; a
    null identifier counts as empty.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(f"({RUN})"), 1)).alias("run")).filter(F.length("run") >= least_length)
    word = F.col("run")
    if noise:
        at = F.col("h") % F.length("run")
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "_id", "run").cast("binary")))
        word = F.when(F.col("h") % noise == 0, F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run")))).otherwise(word)
    words = runs.select(word.alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


class SortedWords:
    """A stretch of a sorted list: its words' code points, and the longest common prefix of each word and the one before."""

    def __init__(self, texts: list[str]):
        self.codes, self.at, self.size = flat(texts)
        n = len(texts)
        self.lcp = np.zeros(n, np.int64)
        open_, depth = np.arange(1, n), 0
        while len(open_):
            open_ = open_[(self.size[open_] > depth) & (self.size[open_ - 1] > depth)]
            open_ = open_[self.codes[self.at[open_] + depth] == self.codes[self.at[open_ - 1] + depth]]
            depth += 1
            self.lcp[open_] = depth
        self.by_lcp = np.argsort(self.lcp, kind="stable")
        self.sorted_lcp = self.lcp[self.by_lcp]

    def splits(self, depth: int) -> np.ndarray:
        """Where words start that share just `depth` code points with the one before, ascending."""
        a, b = np.searchsorted(self.sorted_lcp, [depth, depth + 1])
        return self.by_lcp[a:b]

    def within_one(self, codes: np.ndarray, at: np.ndarray, size: np.ndarray, start: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) at exactly one edit; each query is compared with the words from start to end, which share its first `depth` code points."""

        def letter(q: np.ndarray, j: int) -> np.ndarray:
            there = (j >= 0) & (j < size[q])
            return np.where(there, codes[np.where(there, at[q] + j, 0)], _NONE)

        q = np.flatnonzero(end > start)
        start, end = start[q], end[q]
        # the band: edits to the query's first depth - 1, depth and depth + 1 code points
        less, same, more = np.ones(len(q), np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)
        queries, words = [], []
        while len(q):
            ends = self.size[start] == depth
            rest = size[q] - depth
            edits = np.select([rest == -1, rest == 0, rest == 1], [less, same, more], 9)
            hit = ends & (edits == 1)
            queries.append(q[hit])
            words.append(start[hit])
            start = start + ends
            go = np.flatnonzero(start < end)
            q, start, end, less, same, more = (x[go] for x in (q, start, end, less, same, more))
            # every range falls into ranges by its next code point
            cuts = self.splits(depth)
            low, high = np.searchsorted(cuts, start, "right"), np.searchsorted(cuts, end, "left")
            n = high - low + 1
            owner = np.repeat(np.arange(len(q)), n)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            padded = np.append(cuts, 0)
            began = np.where(nth == 0, start[owner], padded[np.minimum(low[owner] + nth - 1, len(cuts))])
            ended = np.where(nth == n[owner] - 1, end[owner], padded[np.minimum(low[owner] + nth, len(cuts))])
            q, start, end, less, same, more = q[owner], began, ended, less[owner], same[owner], more[owner]
            c = self.codes[self.at[start] + depth]
            new_less = np.minimum(same + 1, less + (letter(q, depth - 1) != c))
            new_same = np.minimum(np.minimum(more + 1, new_less + 1), same + (letter(q, depth) != c))
            new_more = np.minimum(new_same + 1, more + (letter(q, depth + 1) != c))
            keep = np.flatnonzero(np.minimum(np.minimum(new_less, new_same), new_more) <= 1)
            q, start, end, less, same, more = (x[keep] for x in (q, start, end, new_less.astype(np.int8), new_same.astype(np.int8), new_more.astype(np.int8)))
            depth += 1
        none = np.zeros(0, np.int64)
        return np.concatenate(queries or [none]), np.concatenate(words or [none])


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points, and where each text starts and how many it has."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass") or b"\0\0\0\0", np.uint32)
    return codes, np.cumsum(size) - size, size


class Block:
    """The members of a block, all of one list (direction and prefix length), in order."""

    def __init__(self, backwards: bool, depth: int, texts: list[str], counts: list[int]):
        self.backwards, self.depth, self.list = backwards, depth, SortedWords(texts)
        self.words = [t[::-1] for t in texts] if backwards else texts
        self.counts = np.array(counts, np.int64)
        self.rank = np.argsort(sorted(range(len(texts)), key=self.words.__getitem__)) if backwards else np.arange(len(texts))
        heads = [t[:depth] for t in texts]
        first = [i for i, h in enumerate(heads) if not i or h != heads[i - 1]]
        self.ranges = {heads[i]: (i, j) for i, j in zip(first, [*first[1:], len(heads)])}

    def near(self, texts: list[str]) -> Iterator[tuple[str, int, int, str]]:
        """For each query with partners here: the word, how many, and the count and the word of the best of them."""
        codes, at, size = flat(texts)
        bounds = np.array([self.ranges.get(t[: self.depth], (0, 0)) for t in texts], np.int64).reshape(-1, 2)
        q, w = self.list.within_one(codes, at, size, bounds[:, 0], bounds[:, 1], self.depth)
        # a pair is looked for with half of its shorter word, and backwards only if it isn't found forwards
        keep = np.minimum(size[q], self.list.size[w]) // 2 == self.depth
        if self.backwards:
            shared = keep.copy()
            for j in range(self.depth):
                i = np.flatnonzero(shared)
                shared[i] = codes[at[q[i]] + size[q[i]] - 1 - j] == self.list.codes[self.list.at[w[i]] + self.list.size[w[i]] - 1 - j]
            keep &= ~shared
        q, w = q[keep], w[keep]
        order = np.lexsort((self.rank[w], -self.counts[w], q))
        q, w = q[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else q
        for i, n in zip(first.tolist(), np.diff(np.append(first, len(q))).tolist()):
            text = texts[q[i]]
            yield text[::-1] if self.backwards else text, n, int(self.counts[w[i]]), self.words[w[i]]


def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks (block, query, backwards, depth, text, n), each block's members before its queries, to word, n_near, best_n, best."""
    now, key, members = None, None, ([], [])

    def made(found) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 4, kinds)], ["word", "n_near", "best_n", "best"])

    def asked(texts: list[str]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(texts), QUERIES):
            yield made(now.near(texts[i : i + QUERIES]))

    def closed() -> Iterator[pa.RecordBatch]:
        nonlocal now
        if now is None and members[0]:
            now = Block(key[1], key[2], *members)
            yield from asked(members[0])

    for batch in batches:
        block, query, backwards, depth = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        change = np.flatnonzero((block[1:] != block[:-1]) | (depth[1:] != depth[:-1]) | (backwards[1:] != backwards[:-1]) | (query[1:] != query[:-1])) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), len(block)]):
            if a == b:
                continue
            part, own = batch.slice(a, b - a), (block[a], bool(backwards[a]), int(depth[a]))
            if own != key:
                yield from closed()
                now, key, members = None, own, ([], [])
            texts = part.column(4).to_pylist()
            if not query[a]:
                members[0].extend(texts)
                members[1].extend(part.column(5).to_pylist())
            else:
                yield from closed()
                if now is not None:
                    yield from asked(texts)
    yield from closed()


def blocks(words: DataFrame) -> DataFrame:
    """Rows of blocks for partners(): the sorted lists as members, and words of a prefix that goes on elsewhere as queries."""
    sides = F.array(F.struct(F.lit(False).alias("backwards"), F.col("word").alias("text")), F.struct(F.lit(True).alias("backwards"), F.reverse("word").alias("text")))
    depths = F.array_distinct(F.array((F.length("word") / 2).cast("int"), ((F.length("word") - 1) / 2).cast("int")))
    rows = words.select("n", F.explode(sides).alias("s"), depths.alias("ds")).select("n", "s.*", F.explode("ds").alias("depth"))
    lists = rows.repartitionByRange("backwards", "depth", "text").sortWithinPartitions("backwards", "depth", "text")
    lists = saved(lists.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "spelling-lists")
    # the first and the last prefix of each list's part of a block, with the words between which it lies there
    head = F.substring("text", F.lit(1), F.col("depth"))
    edge = lists.groupBy("block", "backwards", "depth").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    first, last = F.expr("substring(low, 1, depth)"), F.expr("substring(high, 1, depth)")
    common = F.expr("substring(low, 1, aggregate(sequence(1, length(low)), 0, (a, i) -> if(a = i - 1 AND substring(low, i, 1) = substring(high, i, 1), i, a)))")
    parts = F.when(first == last, F.array(F.struct(first.alias("head"), common.alias("shared")))).otherwise(F.array(F.struct(first.alias("head"), first.alias("shared")), F.struct(last.alias("head"), last.alias("shared"))))
    edge = edge.select(F.col("block").alias("to"), "backwards", "depth", F.explode(parts).alias("p")).select("to", "backwards", "depth", "p.*")
    keys = ["backwards", "depth", "head"]
    going_on = edge.join(edge.groupBy(*keys).agg(F.count("*").alias("k")).filter("k > 1").drop("k"), keys)
    close = F.expr("length(shared) <= depth OR levenshtein(substring(text, 1, length(shared) - 1), shared, 1) >= 0 OR levenshtein(substring(text, 1, length(shared)), shared, 1) >= 0 OR levenshtein(substring(text, 1, length(shared) + 1), shared, 1) >= 0")
    sent = lists.withColumn("head", head).join(going_on, keys).filter((F.col("block") != F.col("to")) & close)
    names = ["block", "query", "backwards", "depth", "text", "n"]
    return lists.withColumn("query", F.lit(False)).select(names).union(sent.select(F.col("to").alias("block"), F.lit(True).alias("query"), "backwards", "depth", "text", "n"))


def variants(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n of a saved table of distinct words and their counts.

    n_near: words at exactly one edit (an inserted, deleted or replaced code point). form: the near
    word of largest n, ties to the smallest in code-point order, if it has at least twice the word's n.
    """
    rows = blocks(words).repartition("block").sortWithinPartitions("block", "backwards", "depth", "query", "text")
    found = rows.mapInArrow(partners, "word string, n_near long, best_n long, best string")
    near = found.groupBy(F.col("word").alias("_word")).agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("back"), F.col("best").alias("word"))).alias("best"))
    strong = -F.col("best.back") >= 2 * F.col("n")
    out = words.join(near, F.col("word") == F.col("_word"), "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.back")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of a saved table of (word, form): where forms end, by doubling the steps; counts at least double along forms, so there are few rounds and no cycles."""
    now = saved(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        seen, old = Observation(), now
        on = now.select(F.col("word").alias("_word"), F.col("root").alias("_on"))
        step = now.join(on, F.col("root") == F.col("_word"), "left")
        now = saved(step.select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")).observe(seen, F.count_if("moved").alias("n")).drop("moved"), "spelling-roots")
        forget(old)
        if not seen.get["n"]:
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, noise: int = 97) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents; see word_counts, variants and roots.

    All words take part, whatever their number: a prefix that very many words share is spread over
    blocks, and words as long as a whole text are worked on by code point as others are. Null texts
    and an empty table give no words; repeated rows count each time; other columns, whatever their
    names, are left out.
    """
    words = saved(word_counts(docs, id_col, text_col, least_length, least_count, noise), "spelling-words")
    found = saved(variants(words), "spelling-variants")
    ends = roots(found.filter("form IS NOT NULL"))
    out = found.join(ends.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
