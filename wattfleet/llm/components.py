"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wattfleet.llm.common import forget, saved


#: Links that a task handles, so that a small table is worked on in a few tasks, however many partitions a shuffle has.
LINKS = 100_000


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "links") -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of a link.

    Every step is a join of the links with one row per node, both written to the shared folder, so
    that Spark's skew handling can split the links of a hub; the minimum of its neighbours is
    aggregated before the shuffle. Steps grow with the logarithm of the longest chain. Links with a
    null end, and of a node with itself, count for nothing; an empty table gives no rows.
    """
    first, seen = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(a).isNull().alias("x"), F.col(b).isNull().alias("y")).filter("a < b AND NOT x AND NOT y"), Observation()
    now = saved(first.select("a", "b").distinct().observe(seen, F.count(F.lit(1)).alias("n")), name)
    # a step makes no more links than there were
    before, tasks = None, 1 + seen.get["n"] // LINKS
    while True:
        # large star: neighbours above u are linked to the least of u and its neighbours
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks), name)
        large = saved(both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct().coalesce(tasks), name)
        # small star: u and its neighbours below are linked to the least of these
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("b")).select(F.col("x").alias("a"), "b").filter("a < b").distinct()
        seen, old = Observation(), now
        now = saved(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).coalesce(tasks), name)
        forget(old, least, large)
        state = seen.get["n"], seen.get["h"]
        if state == before or not state[0]:
            break
        before = state
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a")).distinct())
