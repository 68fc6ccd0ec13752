"""Terms of office: merging of rosters, the term in force, covered sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_terms(rosters: DataFrame, *, member: str, session: str, same: Sequence[str]) -> DataFrame:
    """Runs of consecutive published rosters in which a member's ``same`` columns don't change.

    Consecutive means among the sessions that have a roster at all, so an
    unpublished one doesn't break a run. Rows: member, ``same``, ``since``,
    ``until``, ``nth`` (1 is the newest) and ``current`` (the run reaches the
    newest roster). The list of sessions, one row each, is ranked in one task.
    """
    published = rosters.select(session).distinct()
    ranks = published.withColumn("_rank", F.dense_rank().over(Window.orderBy(session))).withColumnRenamed(session, "_s")
    newest = published.agg(F.max(session).alias("_newest"))
    rows = rosters.join(ranks, F.col(session) == F.col("_s"))
    by = Window.partitionBy(member).orderBy("_rank")
    key = F.struct(*same)
    breaks = ~(F.lag(key).over(by).eqNullSafe(key) & (F.lag("_rank").over(by) == F.col("_rank") - 1))
    runs = rows.withColumn("_break", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn("_run", F.sum("_break").over(by))
    terms = runs.groupBy(member, "_run", *same).agg(F.min(session).alias("since"), F.max(session).alias("until"))
    return terms.crossJoin(F.broadcast(newest)).select(
        member, *same, "since", "until", F.row_number().over(Window.partitionBy(member).orderBy(F.desc("_run"))).alias("nth"), (F.col("until") == F.col("_newest")).alias("current"),
    )


def term_in_force(records: DataFrame, terms: DataFrame, *, record: str, member: str, at: str, value: str, term_member: str, since: str, until: str, pos: str) -> DataFrame:
    """``value`` of the first term that covers the record's session, else of the latest before it; never of a later one.

    Records without such a term are left out.
    """
    side = terms.select(F.col(term_member).alias("_m"), F.col(since).alias("_since"), F.coalesce(F.col(until), F.col(since)).alias("_until"), F.col(value).alias("_value"), F.col(pos).alias("_pos"))
    pairs = records.join(side, (F.col(member) == F.col("_m")) & (F.col("_since") <= F.col(at)))
    covers = F.col(at) <= F.col("_until")
    order = F.struct(covers.alias("c"), F.when(covers, 0).otherwise(F.col("_until")).alias("u"), (-F.col("_pos")).alias("p"))
    return pairs.groupBy(record, member, at).agg(F.max_by("_value", order).alias(value))


def covered_sessions(terms: DataFrame, *, since: str, until: str) -> DataFrame:
    """Each session that some term covers; a term that ends before it begins covers none."""
    return terms.where(F.col(since) <= F.coalesce(F.col(until), F.col(since))).select(F.explode(F.sequence(F.col(since), F.coalesce(F.col(until), F.col(since)))).alias("session")).distinct()


def uncovered_sessions(wanted: DataFrame, terms: DataFrame, *, session: str, since: str, until: str) -> DataFrame:
    """Sessions that are asked for and that no term covers."""
    have = covered_sessions(terms, since=since, until=until).withColumnRenamed("session", "_have")
    return wanted.select(session).distinct().join(have, F.col(session) == F.col("_have"), "left_anti")
