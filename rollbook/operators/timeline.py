"""Timelines: records of many kinds in one table, their order, counts and folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_kinds(parts: Mapping[str, DataFrame]) -> DataFrame:
    """All parts in one wide table with their ``kind``; columns a part lacks are null."""
    tagged = [df.withColumn("kind", F.lit(kind)) for kind, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def kind_rank(kinds: Sequence[str], kind: str = "kind") -> Column:
    """Place of the kind in ``kinds``, 1 for the first; unknown kinds come last."""
    at = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind))
    return F.when(at > 0, at).otherwise(len(kinds) + 1).cast("int")


def in_order(timeline: DataFrame, kinds: Sequence[str], *, date: str, entry: str) -> DataFrame:
    """Newest first, then by kind, then the greater id first."""
    return timeline.orderBy(F.col(date).desc_nulls_last(), kind_rank(kinds), F.col(entry).desc())


def counts_by_member(members: DataFrame, timeline: DataFrame, kinds: Sequence[str], *, member: str, of: str) -> DataFrame:
    """Entries of each kind for every member, 0 where there are none."""
    counted = timeline.groupBy(F.col(of).alias("_of")).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    return members.select(member).join(counted, F.col(member) == F.col("_of"), "left").select(member, *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in kinds])


def fold_roles(rows: DataFrame, by: Sequence[str], *, order: Sequence[str], carry: Sequence[str], last: Sequence[str] = ()) -> DataFrame:
    """One row for each role: how many rows, attributes of its first row, and of its last."""
    key = F.struct(*order)
    return rows.groupBy(*by).agg(
        F.count("*").alias("times"), *[F.min_by(c, key).alias(f"first_{c}") for c in carry], *[F.max_by(c, key).alias(f"last_{c}") for c in (last or carry)],
    )


def latest_where(rows: DataFrame, by: Sequence[str], values: Mapping[str, Column], *, order: Sequence[str]) -> DataFrame:
    """For each key and value column the latest value that passes its test: pages merged in order, an empty field never overwriting."""
    key = F.struct(*order)
    return rows.groupBy(*by).agg(*[F.max_by(F.when(test, F.col(c)), F.when(test, key)).alias(c) for c, test in values.items()])


def stance(bills: DataFrame, members: DataFrame, *, bill: str, at: str, yes: str, no: str, member: str, group: str, since: str, until: str) -> DataFrame:
    """What a member's group declared on a bill, as an estimate: yes where it is among the yes groups, no among the no groups."""
    sides = bills.select(bill, at, F.explode(F.transform(F.coalesce(F.col(yes), F.array().cast("array<string>")), lambda g: F.struct(g.alias("g"), F.lit("yes").alias("s")))).alias("x")).unionAll(
        bills.select(bill, at, F.explode(F.transform(F.coalesce(F.col(no), F.array().cast("array<string>")), lambda g: F.struct(g.alias("g"), F.lit("no").alias("s")))).alias("x"))
    ).select(bill, at, F.col("x.g").alias("_g"), F.col("x.s").alias("stance"))
    return sides.join(members, (F.col("_g") == F.col(group)) & (F.col(since) <= F.col(at)) & (F.col(at) <= F.coalesce(F.col(until), F.col(since)))).select(bill, member, group, "stance", F.lit(True).alias("estimated")).distinct()
