"""Exact dedup by a tree-merge of digest runs, in DataFrame operations only.

Every input partition sorts its digests into a run and merges equal ones. Runs then meet in rounds:
in round r, the runs of `fan_in` neighbouring nodes merge in order into one, digest by digest, and
each merge keeps the identifier that stays and the number of copies. A group of copies, however large,
is one row per run after the first step, so no round has a hot key.

Digests merge only when SHA-256, byte length and a second, independent hash of the normalised
text all agree; this is checked again at every level, since all three are the merge key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfleet.llm.common import ascii_lower, saved

KEY = ["_sha", "_bytes", "_xx"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest columns of every row: identifier, SHA-256, byte length and a second hash of the text."""
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("_id"), norm.alias("_norm")).select(
        "_id", F.unhex(F.sha2("_norm", 256)).alias("_sha"), F.octet_length("_norm").alias("_bytes"), F.xxhash64("_norm").alias("_xx")
    )


def merge_runs(rows: DataFrame, runs: int = 256, fan_in: int = 16, keep: str = "largest") -> DataFrame:
    """One row per distinct text: KEY, keep_id, group_size.

    `runs` is the number of leaves of the merge tree (partitions share a leaf beyond it), so there
    are log(runs) / log(fan_in) rounds whatever the input's size.
    """
    best, known = (F.max, F.col("_id").isNotNull()) if keep == "largest" else (F.min, F.col("_id").isNull())
    # a struct, which Spark aggregates in sorted runs: each task sorts its digests and merges equal neighbours
    level = rows.select(*KEY, F.struct(known.alias("known"), F.col("_id").alias("id")).alias("_keep"), F.lit(1).cast("long").alias("group_size"), (F.spark_partition_id() % runs).alias("_node"))
    nodes = runs
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        level = level.withColumn("_node", F.floor(F.col("_node") / fan_in).cast("int"))
        level = level.groupBy("_node", *KEY).agg(best("_keep").alias("_keep"), F.sum("group_size").alias("group_size"))
    return level.select(*KEY, F.col("_keep.id").alias("keep_id"), "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """Which row stays, for every row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts
    the largest (or smallest) identifier stays. A null identifier never wins over another; where
    a group has none but null, keep_id is null and all its rows are kept. Rows that repeat an
    identifier count separately in group_size and share its verdict. An empty table gives no rows; very
    long texts are hashed whole.
    Other columns are ignored.
    """
    rows = saved(digests(docs, id_col, text_col), "exact-digests")
    groups = merge_runs(rows, keep=keep).filter("group_size > 1")
    out = rows.join(groups, KEY, "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", one_row: bool = False) -> DataFrame:
    """docs without the rows that exact_duplicates() doesn't keep; all columns stay as they are.

    With one_row exactly one row of every group of equal texts stays: of rows that repeat the
    identifier kept, or have all none, the one whose values have the smallest hash. Only groups
    with such ties are shuffled for that, with partial aggregation.
    """
    verdict = exact_duplicates(docs, id_col, text_col, keep)
    lost = verdict.filter("NOT kept").select(F.col(id_col).alias("__ed_id"), F.col("text_sha256").alias("__ed_sha")).distinct()
    sha = F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))), 256)
    left = docs.join(lost, docs[id_col].eqNullSafe(F.col("__ed_id")) & (sha == F.col("__ed_sha")), "left_anti")
    if not one_row:
        return left
    ties = saved(verdict.filter("kept AND group_size > 1").groupBy(F.col("text_sha256").alias("__ed_tie")).agg(F.count("*").alias("_n")).filter("_n > 1").select("__ed_tie"), "exact-ties")
    if ties.isEmpty():
        return left
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() != "map"])
    tied = left.join(ties, sha == F.col("__ed_tie")).select("__ed_tie", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__ed_x"), order.alias("__ed_order"))
    one = tied.groupBy("__ed_tie").agg(F.min_by("__ed_x", "__ed_order").alias("__ed_x")).select("__ed_x.*")
    return left.join(ties, sha == F.col("__ed_tie"), "left_anti").union(one)
