"""Rows carried from the last publication: matched anew where the roster changed, kept where it did not."""

from __future__ import annotations

from dataclasses import astuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators.records import differences
from rollbook.operators.resolve import Terms, resolve, until_of


def changed_keys(before: DataFrame, now: DataFrame, *, t: Terms = Terms()) -> DataFrame:
    """Keys of terms that one version of a roster has and the other has not, with the earliest session that such a term can bear upon (``since``; it may reach beyond its end)."""
    columns = [c for c in astuple(t) if c]
    unlike = differences(before.select(*columns), now.select(*columns))
    return unlike.groupBy(F.col(t.key).alias("_key")).agg(F.min(t.since).alias("_from"))


def match_again(carried: DataFrame, before: DataFrame, now: DataFrame, *, record: str, key: str, at: str, group: str | None = None, date: str | None = None, t: Terms = Terms(), same_group: DataFrame | None = None) -> DataFrame:
    """``carried`` records with ``member`` and ``branch`` as the roster ``now`` gives them, and ``state``: again or kept.

    ``carried`` hold what the roster ``before`` gave. Only records are asked
    again whose key has a changed term that begins by their session: no other
    term can bear upon them, so the outcome is that of matching all anew. Ids
    of those are blanked first, and one that no longer resolves stays without.
    """
    changed = changed_keys(before, now, t=t)
    told = carried.join(changed, F.col(key) == F.col("_key"), "left").withColumn("_stale", F.coalesce(F.col("_from") <= F.col(at), F.lit(False)))
    stale = told.where("_stale").select(*[c for c in carried.columns if c not in ("member", "branch")])
    kept = told.where("NOT _stale").select(*carried.columns, F.lit("kept").alias("state"))
    again = resolve(stale, now, record=record, key=key, at=at, group=group, date=date, t=t, same_group=same_group).withColumn("state", F.lit("again"))
    return kept.unionByName(again)


def lost_matches(before: DataFrame, after: DataFrame, *, call: str, member: str = "member") -> DataFrame:
    """Calls with fewer matched votes than before: a sign of a roster read in part, to be refused."""
    a = before.where(F.col(member).isNotNull()).groupBy(call).agg(F.count("*").alias("n_before"))
    b = after.where(F.col(member).isNotNull()).groupBy(F.col(call).alias("_call")).agg(F.count("*").alias("_after"))
    met = a.join(b, F.col(call) == F.col("_call"), "left").select(call, "n_before", F.coalesce("_after", F.lit(0)).alias("n_after"))
    return met.where("n_after < n_before")


def in_office(entries: DataFrame, terms: DataFrame, *, member: str, at: str, date: str | None = None, t: Terms = Terms()) -> tuple[DataFrame, DataFrame]:
    """Carried ``entries`` whose member the roster has in office at their session, and the others, which must be fetched anew.

    A term covers a session from its first to its last, and one after its last
    if its own end date is not before the entry's. An entry without a session
    or a member is of the others.
    """
    side = terms.select(F.col(t.member).alias("_m"), F.col(t.since).alias("_since"), until_of(t).alias("_until"), (F.col(t.ends) if t.ends else F.lit(None).cast("string")).alias("_ends"))
    day = F.col(date) if date else F.lit(None).cast("string")
    held = (F.col(at) <= F.col("_until")) | F.coalesce((F.col("_ends") != "") & (F.col("_ends") >= day), F.lit(False))
    on = (F.col(member) == F.col("_m")) & (F.col("_since") <= F.col(at)) & held
    return entries.join(side, on, "left_semi"), entries.join(side, on, "left_anti")
