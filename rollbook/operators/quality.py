"""Recounts, coverage and violations. Every check gives its denominator: 0 is not "not measured"."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recount(calls: DataFrame, votes: DataFrame, *, call: str, yes: str, no: str, of: str, vote: str, readable: Column) -> DataFrame:
    """Each roll call's published and counted votes and its ``state``.

    ``state``: no_counts (nothing published), unreadable (a vote that can't be
    read; such calls aren't checked), equal or mismatch.
    """
    counted = votes.groupBy(F.col(of).alias("_of")).agg(F.count_if(F.col(vote) == "yes").alias("counted_yes"), F.count_if(F.col(vote) == "no").alias("counted_no"), F.count_if(~readable).alias("unreadable"))
    both = calls.select(call, F.col(yes).alias("published_yes"), F.col(no).alias("published_no")).join(counted, F.col(call) == F.col("_of"), "left")
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("counted_yes", "counted_no", "unreadable")})
    equal = (F.col("published_yes") == F.col("counted_yes")) & (F.col("published_no") == F.col("counted_no"))
    state = F.when(F.col("published_yes").isNull() | F.col("published_no").isNull(), "no_counts").when(F.col("unreadable") > 0, "unreadable").when(equal, "equal").otherwise("mismatch")
    return both.withColumn("state", state).drop("_of", "unreadable")


def recount_summary(recounted: DataFrame) -> DataFrame:
    """Rows, and how many of each state; one row of zeros for no roll calls."""
    states = ("equal", "mismatch", "no_counts", "unreadable")
    return recounted.agg(F.count("*").alias("rows"), *[F.count_if(F.col("state") == s).alias(s) for s in states])


def session_coverage(votes: DataFrame, roster: DataFrame, *, session: str, date: str, call: str, member: str, name: str, roster_member: str) -> DataFrame:
    """For each session its last date, roll calls, votes, members seen and names unmatched, and how many seats may have changed hands.

    A vote has a member or a name that is none, so both are counted from one
    table of a session's people, and roll calls from one of its calls: what is
    shuffled are those, not a copy of every vote for each thing counted.
    """
    size = roster.agg(F.countDistinct(roster_member).alias("_roster"))
    people = votes.groupBy(F.col(session).alias("_session"), F.col(member).alias("_member"), F.when(F.col(member).isNull(), F.col(name)).alias("_name")).agg(F.max(date).alias("_date"), F.count("*").alias("_votes"))
    counted = people.groupBy("_session").agg(
        F.max("_date").alias("date"), F.sum("_votes").alias("votes"), F.count("_member").alias("seen"), F.count("_name").alias("unmatched_names"), F.coalesce(F.sum(F.when(F.col("_member").isNull(), F.col("_votes"))), F.lit(0)).alias("unmatched_votes"),
    )
    calls = votes.groupBy(session, call).agg(F.lit(1)).groupBy(session).agg(F.count(call).alias("roll_calls"))
    by = calls.join(counted, F.col(session).eqNullSafe(F.col("_session"))).select(session, "date", "roll_calls", "votes", "seen", "unmatched_names", "unmatched_votes")
    absent = F.greatest(F.lit(0), F.col("_roster") - F.col("seen"))
    return by.crossJoin(F.broadcast(size)).select("*", absent.alias("absent"), F.least(absent, F.col("unmatched_names")).alias("seats_changed")).drop("_roster")


def roster_window(votes: DataFrame, *, by: Sequence[str], date: str, as_of: Column) -> DataFrame:
    """First and last vote date, their distance from the roster's date in days, and votes before and after it."""
    return votes.groupBy(*by).agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count_if(F.col(date) < as_of).alias("before"), F.count_if(F.col(date) > as_of).alias("after"),
        F.max(F.datediff(as_of, F.col(date))).alias("days_before"), F.max(F.datediff(F.col(date), as_of)).alias("days_after"),
    )


def link_stats(rows: DataFrame, *, by: str, member: str) -> DataFrame:
    """Records and linked records for each session."""
    return rows.groupBy(by).agg(F.count("*").alias("records"), F.count(member).alias("linked"))


def session_range(rows: DataFrame, *, by: Sequence[str], session: str) -> DataFrame:
    """First and last session, how many there are, and whether some between them are missing."""
    found = rows.where(F.col(session).isNotNull()).groupBy(*by).agg(F.min(session).alias("first"), F.max(session).alias("last"), F.countDistinct(session).alias("sessions"))
    return found.withColumn("gaps", F.col("last") - F.col("first") + 1 > F.col("sessions"))


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """All broken rules as (rule, entity, detail); each rule's table has entity and detail as text."""
    parts = [df.select(F.lit(rule).alias("rule"), F.col("entity").cast("string").alias("entity"), F.col("detail").cast("string").alias("detail")) for rule, df in rules.items()]
    return reduce(DataFrame.unionAll, parts)


def outside_domain(df: DataFrame, entity: str, column: str, allowed: Sequence) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).select(F.col(entity).alias("entity"), F.col(column).alias("detail"))


def not_unique(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("entity")).agg(F.count("*").alias("detail")).where("detail > 1")


def dangling(df: DataFrame, entity: str, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose key is in no row of the target."""
    return df.where(F.col(key).isNotNull()).join(target.select(F.col(target_key).alias("_t")).distinct(), F.col(key) == F.col("_t"), "left_anti").select(F.col(entity).alias("entity"), F.col(key).alias("detail"))


def not_matching(df: DataFrame, entity: str, column: str, pattern: str) -> DataFrame:
    """Rows whose text is absent or doesn't have the whole pattern."""
    return df.where(~F.coalesce(F.col(column).rlike(f"^(?:{pattern})$"), F.lit(False))).select(F.col(entity).alias("entity"), F.col(column).alias("detail"))


def out_of_order(df: DataFrame, by: str, position: str, date: str, entity: str) -> DataFrame:
    """Rows that are newer than the one before them in a list that should be newest first."""
    from pyspark.sql import Window

    before = F.lag(date).over(Window.partitionBy(by).orderBy(position))
    return df.withColumn("_before", before).where(F.col("_before") < F.col(date)).select(F.col(entity).alias("entity"), F.col(date).alias("detail"))


def recount_differs(stated: DataFrame, entity: str, count: str, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose stated count is not the number of rows under them."""
    counted = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    both = stated.join(counted, F.col(entity) == F.col("_k"), "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return both.where(~F.col(count).eqNullSafe(F.col("_n"))).select(F.col(entity).alias("entity"), F.concat_ws("/", F.col(count).cast("string"), F.col("_n").cast("string")).alias("detail"))


def broken_condition(df: DataFrame, entity: str, holds: Column, detail: Column) -> DataFrame:
    """Rows for which a required or forbidden column breaks the condition."""
    return df.where(~F.coalesce(holds, F.lit(False))).select(F.col(entity).alias("entity"), detail.alias("detail"))


def not_quarantined(rows: DataFrame, entity: str, member: str, by: Sequence[str], listed: DataFrame) -> DataFrame:
    """Rows without a member that the list of unmatched names lacks; null keys are equal."""
    keys = listed.select(*[F.col(c).alias(f"_l_{c}") for c in by]).distinct()
    open_ = rows.where(F.col(member).isNull() | (F.col(member).cast("string") == ""))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in by])
    return open_.join(keys, same, "left_anti").select(F.col(entity).alias("entity"), F.concat_ws("/", *[F.col(c).cast("string") for c in by]).alias("detail"))


def orphans(files: DataFrame, path: str, index: DataFrame, index_path: str) -> DataFrame:
    """Files that are there but in no index."""
    return files.join(index.select(F.col(index_path).alias("_p")).distinct(), F.col(path) == F.col("_p"), "left_anti").select(F.col(path).alias("entity"), F.lit("not in the index").alias("detail"))


def bad_source(rows: DataFrame, entity: str, url: str, hosts: DataFrame, *, by: str | None = None) -> DataFrame:
    """Rows without a source by https, from a host that ``hosts`` (``host``) lacks, or, with ``by`` in both, from a host of another house."""
    host = F.lower(F.regexp_extract(F.col(url), "^https://([^/?#:]+)", 1))
    own = rows.select(F.col(entity).alias("entity"), F.col(url).alias("_url"), host.alias("_host"), (F.col(by) if by else F.lit(None).cast("string")).alias("_by"))
    allowed = hosts.groupBy(F.lower("host").alias("_allowed")).agg((F.collect_set(by) if by else F.collect_set(F.lit(""))).alias("_houses"))
    both = own.join(allowed, F.col("_host") == F.col("_allowed"), "left")
    other = F.coalesce(~F.array_contains("_houses", F.col("_by")), F.lit(True)) if by else F.lit(False)
    detail = F.when(F.coalesce("_host", F.lit("")) == "", "no https source").when(F.col("_allowed").isNull(), F.concat(F.lit("host "), "_host")).when(other, F.concat(F.lit("other house "), "_host"))
    return both.select("entity", detail.alias("detail")).where("detail IS NOT NULL")


def best_covered(rows: DataFrame, *, session: str, n: str) -> DataFrame:
    """One row: the session with the greatest count, the later of equals; nulls if there is none."""
    return rows.agg(F.max(F.struct(F.col(n).alias("n"), F.col(session).alias("session"))).alias("_most")).select("_most.session", "_most.n")


class Violated(ValueError):
    """A guard or a rule failed; nothing was written."""


def require_none(found: DataFrame, what: str, *, shown: int = 20) -> None:
    """Refuse to go on if ``found`` has rows; some of them are named in the error."""
    rows = found.limit(shown).collect()
    if rows:
        raise Violated(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))
