"""Running totals within groups of any size, without a group meeting in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.scratch import cut


def running(rows: DataFrame, *, group: str, order: Sequence[str], value: Column | str) -> DataFrame:
    """``rows`` with ``before``, the sum of ``value`` over the rows before it in its group, and ``total``, that over the whole group.

    Rows are range-partitioned by group and order, so a group of any share of
    all rows spreads over tasks; each task's part of a group is summed up, and
    a row adds to the sum of the parts before its own the rows before it in its
    part. The parts (a task's groups) are few; rows never gather by group.
    ``group`` and ``order`` give ascending order, nulls first; rows that tie in
    all of ``order`` stand in any order. No rows: no rows.
    """
    ranged = cut(rows.withColumn("_value", value if isinstance(value, Column) else F.col(value)).repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_of")).agg(F.sum("_value").alias("_sum"))
    by = Window.partitionBy("_group")
    offsets = parts.select("_group", "_of", F.sum("_sum").over(by.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)).alias("_offset"), F.sum("_sum").over(by).alias("total"))
    own = F.sum("_value").over(Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("_own", own).join(offsets, (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_of")))
    zero = F.lit(0).cast("long")
    return placed.withColumn("before", F.coalesce("_offset", zero) + F.coalesce("_own", zero)).drop("_value", "_part", "_group", "_of", "_own", "_offset")
