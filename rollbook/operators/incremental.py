"""Incremental snapshots: what is refetched and carried, guards against loss, and publishing.

Guards compare the snapshot to be published with the one before. All of them
run before anything is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators.quality import require_none
from rollbook.sources.sinks import dealt


def plan_sessions(requested: DataFrame, present: DataFrame, *, session: str) -> DataFrame:
    """Each session requested or present and what happens to it: fetch, or carry."""
    a = requested.select(session).distinct().withColumn("_r", F.lit(True))
    b = present.select(session).distinct().withColumn("_p", F.lit(True))
    return a.join(b, session, "full_outer").select(session, F.when(F.col("_r"), "fetch").otherwise("carry").alias("action"))


def carried_only(carried: DataFrame, fetched: DataFrame, on: Sequence[str]) -> DataFrame:
    """Carried rows that were not fetched anew; nothing fetched leaves all."""
    new = fetched.select(*[F.col(c).alias(f"_{c}") for c in on]).distinct()
    same = None
    for c in on:
        term = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = term if same is None else same & term
    return carried.join(new, same, "left_anti")


def restored(current: DataFrame, fresh: DataFrame, previous: DataFrame, *, key: str, value: str) -> DataFrame:
    """The fresh value of each key, else the previous one; empty counts as absent. ``state``: fresh, restored or missing."""
    a = fresh.select(F.col(key).alias("_a"), F.nullif(F.col(value), F.lit("")).alias("_fresh"))
    b = previous.select(F.col(key).alias("_b"), F.nullif(F.col(value), F.lit("")).alias("_previous"))
    both = current.select(key).join(a, F.col(key) == F.col("_a"), "left").join(b, F.col(key) == F.col("_b"), "left")
    return both.select(key, F.coalesce("_fresh", "_previous").alias(value), F.when(F.col("_fresh").isNotNull(), "fresh").when(F.col("_previous").isNotNull(), "restored").otherwise("missing").alias("state"))


def lost_counts(before: DataFrame, after: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups with fewer rows than before; a group that is gone counts 0."""
    a = before.groupBy(*by).agg(F.count("*").alias("n_before"))
    b = after.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.count("*").alias("_after"))
    on = None
    for c in by:
        term = F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = term if on is None else on & term
    return a.join(b, on, "left").select(*by, "n_before", F.coalesce("_after", F.lit(0)).alias("n_after")).where("n_after < n_before")


def lost_values(before: DataFrame, after: DataFrame, *, key: str, value: str) -> DataFrame:
    """Keys of both snapshots whose value was there and is gone; removed keys don't count."""
    a = before.where(F.coalesce(F.col(value), F.lit("")) != "").select(key, F.col(value).alias("was"))
    b = after.select(F.col(key).alias("_k"), F.coalesce(F.col(value), F.lit("")).alias("_now"))
    return a.join(b, F.col(key) == F.col("_k")).where("_now = ''").select(key, "was")


def publish(snapshot: DataFrame, path: str, *, partition: str, guards: dict[str, DataFrame]) -> None:
    """Write the partitions that ``snapshot`` holds, in place of their like, once every guard is empty.

    A rerun with the same rows writes the same partitions again.
    """
    for what, found in guards.items():
        require_none(found, what)
    dealt(snapshot, partition).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(partition).parquet(path)
