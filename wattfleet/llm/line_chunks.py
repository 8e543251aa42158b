"""Line dedup by content-defined chunks of lines, in DataFrame operations only.

Every line is hashed, a rolling hash (of shifted line hashes, or with `whole` a weighted sum) runs over windows of line hashes, and a
chunk ends where the rolling hash falls into one residue class. So a line put in or taken out
moves only the boundaries near it. Chunks of two or more lines that occur earlier in the corpus
are removed, after their bytes have been compared with those of the occurrence that stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattfleet.llm.common import forget, saved


def line_hash(line: Column) -> Column:
    """The first 56 bits of the line's MD5, so that the rolling hash's shifts stay within a long."""
    return F.conv(F.substring(F.md5(line), 1, 14), 16, 10).cast("long")


def whole_boundaries(hashes: Column, n: Column, divisor: int) -> Column:
    """Like boundaries(), but all three lines count in the rolling hash (odd weights), and no chunk has one line unless the text has no more."""

    def candidate(i: Column) -> Column:
        back = lambda k: F.coalesce(F.get(hashes, i - k), F.lit(0).cast("long"))
        return F.pmod(back(0) + 3 * back(1) + 7 * back(2), F.lit(divisor)) == 0

    # a line next to another candidate, the first and the last but one would leave a line by itself
    return F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | (candidate(i) & ~candidate(i - 1) & (i > 0) & (i != n - 2)))


def boundaries(hashes: Column, n: Column, divisor: int) -> Column:
    """Numbers of the lines that end a chunk: each whose rolling hash over three lines is 0 modulo divisor, and the last."""

    def ends(i: Column) -> Column:
        back = lambda k: F.coalesce(F.get(hashes, i - k), F.lit(0).cast("long"))
        rolled = F.shiftleft(back(2), 2).bitwiseXOR(F.shiftleft(back(1), 1)).bitwiseXOR(back(0))
        return (F.pmod(rolled, F.lit(divisor)) == 0) | (i == n - 1)

    return F.filter(F.sequence(F.lit(0), n - 1), ends)


def chunked(docs: DataFrame, id_col: str, text_col: str, divisor: int, whole: bool = False) -> DataFrame:
    """One row per chunk: _id, _row (hash of the text), _chunk, _first, _lines, _text, _key (digest of the chunk's bytes)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_row"), F.split(F.col(text_col), "\n").alias("_all")).filter("_all IS NOT NULL")
    rows = rows.withColumn("_hashes", F.transform("_all", line_hash)).withColumn("_ends", (whole_boundaries if whole else boundaries)(F.col("_hashes"), F.size("_all"), divisor))
    rows = rows.select("_id", "_row", "_all", F.posexplode(F.arrays_zip(F.concat(F.array(F.lit(-1)), F.slice("_ends", F.lit(1), F.size("_ends") - 1)).alias("before"), F.col("_ends").alias("end"))).alias("_chunk", "_at"))
    first, lines = F.col("_at.before") + 1, F.col("_at.end") - F.col("_at.before")
    rows = rows.select("_id", "_row", "_chunk", first.alias("_first"), lines.alias("_lines"), F.array_join(F.slice("_all", first + 1, lines), "\n").alias("_text"))
    return rows.withColumn("_key", F.substring(F.unhex(F.sha2("_text", 256)), 1, 16))


def with_repeats(docs: DataFrame, id_col: str, text_col: str, divisor: int, whole: bool) -> DataFrame:
    """docs, written, with __lc_id, __lc_row (hash of the text), __lc (chunks that repeat, null if none) and __lc_differ.

    Of a chunk __lc holds _chunk, _first (line number from 0), _lines, _key, _stays. __lc_differ has
    the numbers of those whose bytes are not those of the occurrence that stays, null if none.
    Keys are counted and joined on narrow rows without texts; a text is shuffled once, to meet the
    list of its repeated chunks, and after that only repeated chunks are, to be compared. The joins
    have written tables on their sides, so that Spark can split the copies of one chunk over tasks.
    Both sides grow with the corpus, hence the hints.
    """
    chunks = saved(chunked(docs, id_col, text_col, divisor, whole).filter("_lines > 1").drop("_text"), "chunks")
    here = F.struct("_id", "_chunk", "_row")
    first = saved(chunks.groupBy("_key").agg(F.min(here).alias("_keep"), F.count("*").alias("_count")).filter("_count > 1").drop("_count"), "chunk-keys")
    found = chunks.join(first.hint("merge"), "_key").select("_id", "_row", F.struct("_chunk", "_first", "_lines", "_key", here.eqNullSafe(F.col("_keep")).alias("_stays")).alias("_c"))
    lists = found.groupBy(F.col("_id").alias("__lc_id"), F.col("_row").alias("__lc_row")).agg(F.collect_set("_c").alias("__lc"))
    same = docs[id_col].eqNullSafe(F.col("__lc_id")) & (F.xxhash64(docs[text_col]) == F.col("__lc_row"))
    marked = saved(docs.join(lists.hint("merge"), same, "left"), "chunk-docs")
    forget(chunks, first)
    lines = F.split(F.col(text_col), "\n")
    cut = F.transform("__lc", lambda c: F.struct(c["_chunk"].alias("_chunk"), c["_key"].alias("_key"), c["_stays"].alias("_stays"), F.array_join(F.slice(lines, c["_first"] + 1, c["_lines"]), "\n").alias("_text")))
    texts = marked.filter("__lc IS NOT NULL").select("__lc_id", "__lc_row", F.explode(cut).alias("_c")).select("__lc_id", "__lc_row", "_c.*")
    kept = saved(texts.filter("_stays").groupBy("_key").agg(F.first("_text").alias("_kept")), "chunk-kept")
    differ = texts.filter("NOT _stays").join(kept.hint("merge"), "_key", "left").filter("NOT _text <=> _kept")
    differ = saved(differ.groupBy(F.col("__lc_id").alias("__lc_i"), F.col("__lc_row").alias("__lc_r")).agg(F.collect_set("_chunk").alias("__lc_differ")), "chunk-differ")
    forget(kept)
    return marked.join(differ, F.col("__lc_id").eqNullSafe(F.col("__lc_i")) & (F.col("__lc_row") == F.col("__lc_r")), "left").drop("__lc_i", "__lc_r")


def dedup_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 4, count_col: str | None = "removed_lines", whole: bool = False) -> DataFrame:
    """docs with repeated chunks of lines removed from the text, all other columns as they are.

    Of equal chunks the first stays, by (identifier, chunk number); a null identifier counts as
    smallest. Chunks of one line are never removed; with whole, only a text of one line is one. Lines are compared byte by byte, and those that
    stay are joined by line feeds again. removed_lines counts what went. A null text stays null, an
    empty one is one empty line. Rows equal in identifier and text count as one document. A column
    of docs that has the added name is replaced. An empty table gives no rows; texts may be of any length.
    """
    joined = with_repeats(docs, id_col, text_col, divisor, whole)
    gone = F.filter("__lc", lambda c: ~c["_stays"] & ~F.coalesce(F.array_contains("__lc_differ", c["_chunk"]), F.lit(False)))
    numbers = F.flatten(F.transform(gone, lambda c: F.sequence(c["_first"], c["_first"] + c["_lines"] - 1)))
    joined = joined.withColumn("__lc_gone", F.when(F.size(numbers) > 0, numbers))
    joined = joined.withColumn("__lc_lines", F.when(F.col("__lc_gone").isNotNull(), F.split(F.col(text_col), "\n")))
    lines = F.col("__lc_lines")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__lc_gone"))
    cleaned = F.when(F.col("__lc_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    new = {text_col: cleaned}
    if count_col:
        new[count_col] = F.when(F.col("__lc_gone").isNull(), 0).otherwise(F.size("__lc_gone")).cast("long")
    return joined.withColumns(new).drop("__lc_id", "__lc_row", "__lc", "__lc_differ", "__lc_gone", "__lc_lines")
