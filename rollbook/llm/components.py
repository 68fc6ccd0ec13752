"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.scratch import cut


TASK_ROWS = 50_000  # links to a task: rounds take tasks by their links, not by the session's partitions


def merge_join(left: DataFrame, right: DataFrame, on: Column | str, how: str = "inner") -> DataFrame:
    """A join that stays a shuffle, however small a round's tables get: what a round broadcasts would stay with the driver."""
    return left.join(right.hint("merge"), on, how)


def _round(df: DataFrame) -> DataFrame:
    """``df`` written once, without the estimate of its size: a self-join squares it, so over rounds its digits would double without end."""
    out, spark = cut(df), df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(out._jdf.toJavaRDD(), out._jdf.schema()), spark)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``comp`` (the smallest node reachable) of each node that has a link.

    In each round every node hangs on the least of its neighbours, trees are
    flattened by halving the way to their roots, and links become those
    between roots: a round leaves half of the nodes at most, and of many links
    within a group hardly any. Every round is written to the shared folder, so
    a lost executor costs one round at most. No links: no rows.
    """
    ways = F.array(F.struct(F.col("x").alias("node"), F.col("y").alias("near")), F.struct(F.col("y").alias("node"), F.col("x").alias("near")))
    left, labels = _round(links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()), None
    tasks = 1 + left.count() // TASK_ROWS
    while True:
        hung = _round(left.select(F.inline(ways)).groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root")).coalesce(tasks))
        while True:
            above = hung.select(F.col("node").alias("_root"), F.col("root").alias("above"))
            hung = _round(merge_join(hung.select("node", "root"), above, F.col("root") == F.col("_root")).select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")).coalesce(tasks))
            if hung.where("moved").isEmpty():
                break
        roots = hung.select(F.col("node").alias("_node"), "root")
        labels = roots.select(F.col("_node").alias("node"), F.col("root").alias("comp")) if labels is None else _round(merge_join(labels, roots, F.col("comp") == F.col("_node"), "left").select("node", F.coalesce("root", "comp").alias("comp")).coalesce(tasks))
        one = merge_join(left, roots, F.col("x") == F.col("_node")).select(F.col("root").alias("rx"), "y")
        two = merge_join(one, roots, F.col("y") == F.col("_node")).select("rx", F.col("root").alias("ry")).where("rx <> ry")
        left = _round(two.select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct().coalesce(tasks))
        if left.isEmpty():
            return labels
