"""Group majority of a roll call and the members who differ from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_majority(votes: DataFrame, *, call: str, group: str, vote: str) -> DataFrame:
    """Tally and majority of each group in each roll call.

    A tie and a group with neither yes nor no have no majority (null). One
    shuffle on (call, group), combined map-side.
    """
    yes, no = F.count_if(F.col(vote) == "yes"), F.count_if(F.col(vote) == "no")
    return (
        votes.groupBy(call, group)
        .agg(yes.alias("yes"), no.alias("no"), F.count("*").alias("total"))
        .withColumn("majority", F.when(F.col("yes") > F.col("no"), "yes").when(F.col("no") > F.col("yes"), "no"))
    )
