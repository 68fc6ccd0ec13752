"""Numbering, filling down, folding and streaks within an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suffixed_ids(rows: DataFrame, *, base: str, order: Sequence[str], out: str = "id") -> DataFrame:
    """``base`` as id, with a running number appended where several rows have it."""
    same = Window.partitionBy(base)
    nth = F.row_number().over(same.orderBy(*order))
    return rows.withColumn("_n", F.count("*").over(same)).withColumn(out, F.when(F.col("_n") > 1, F.concat_ws("-", F.col(base), nth.cast("string"))).otherwise(F.col(base))).drop("_n")


def running_number(rows: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "number") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def fill_down(rows: DataFrame, value: Column, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """The last value at or before each row."""
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def leading_streak(rows: DataFrame, by: Sequence[str], newest_first: Sequence[Column], failed: Column) -> DataFrame:
    """How many of the newest rows in a run failed, and how many rows were measured at all."""
    upto = Window.partitionBy(*by).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("_ended", F.sum((~failed).cast("int")).over(upto))
    return seen.groupBy(*by).agg(F.count_if(F.col("_ended") == 0).alias("streak"), F.count("*").alias("measured"))


def fold_groups(groups: DataFrame, *, order: str, size: str, limit: int) -> DataFrame:
    """Whole groups in order while they fit in ``limit`` rows together, the first one always; ``hidden`` is how many rows are left out.

    ``groups`` has one row for each group, few in number.
    """
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = groups.withColumn("_upto", F.sum(size).over(upto))
    total = F.sum(size).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = F.row_number().over(Window.orderBy(order)) == 1
    kept = sums.withColumn("_total", total).withColumn("_keep", first | (F.col("_upto") <= limit)).where("_keep")
    whole = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return kept.withColumn("hidden", F.col("_total") - F.max("_upto").over(whole)).drop("_upto", "_total", "_keep")


def day_spine(counts: DataFrame, *, day: str, value: str, first: str, last: str) -> DataFrame:
    """Every day from ``first`` to ``last``, null where nothing was measured."""
    spine = counts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return spine.join(counts.select(F.col(day).cast("date").alias("_d"), F.col(value).alias(value)), F.col("day") == F.col("_d"), "left").select("day", value)


def activity_state(spine: DataFrame, *, value: str) -> DataFrame:
    """not_measured if no day was, silent if all measured days have 0, else active."""
    counts = spine.agg(F.count(value).alias("measured"), F.count_if(F.col(value) == 0).alias("zero_days"), F.count("*").alias("days"))
    state = F.when(F.col("measured") == 0, "not_measured").when(F.col("measured") == F.col("zero_days"), "silent").otherwise("active")
    return counts.withColumn("state", state)
