"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import checkpointed, spread_join


#: Edges to a task, and the tasks that few edges get.
TASK_EDGES, LEAST_TASKS = 20_000, 8


def _gathered(rows: DataFrame, total: int) -> DataFrame:
    """rows in tasks of about TASK_EDGES rows: a round has some ten shuffles, and each task of one leaves files on disk and a status in the driver."""
    return rows.coalesce(max(LEAST_TASKS, total // TASK_EDGES + 1))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select(F.col("u"), F.col("v")).union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _gathered(spread_join(both.filter("v > u"), _gathered(least, total), ["u"], "n", "v", 2 * total), total)
    return _gathered(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), total)


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    least = _gathered(least, total)
    moved = _gathered(spread_join(down, least, ["u"], "n", "v", total), total)
    return _gathered(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), total)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (u, v); component is the least node that it reaches.

    Each round writes its edges to the shared checkpoint folder; the edges of a hub are spread over several
    tasks, and the number of rounds grows with the logarithm of the longest path.
    """
    now = checkpointed(edges.filter("u <> v").select("u", "v").distinct())
    mark, total = None, now.count()
    now = _gathered(now, total)
    while True:
        now = checkpointed(_small_star(_large_star(now, total), total))
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark, total = new, new[0]
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
