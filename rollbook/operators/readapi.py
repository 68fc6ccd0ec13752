"""Questions of readers: search, comparison side by side, coverage, sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(rows: DataFrame, *, equal: dict[str, object], text: str | None, within: Sequence[Column], key) -> DataFrame:
    """Rows that have each given value and, in one of the ``within`` columns, the text; values left open (None) don't restrict."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    if text:
        wanted, hit = key(F.lit(text)), F.lit(False)
        for c in within:
            hit = hit | F.coalesce(F.contains(key(c), wanted), F.lit(False))
        rows = rows.where(hit)
    return rows


def known_value(rows: DataFrame, column: str, value: object) -> object | None:
    """A requested filter value if some row has it, else None."""
    return value if rows.where(F.col(column) == F.lit(value)).limit(1).count() else None


def align(rows: DataFrame, columns: Sequence, *, column: str, record: str, value: str) -> DataFrame:
    """Records that at least two of a few chosen ``columns`` hold, one column for each and null where it doesn't."""
    mine = rows.where(F.col(column).isin(*columns))
    cells = [F.max(F.when(F.col(column) == c, F.col(value))).alias(f"c{i}") for i, c in enumerate(columns)]
    return mine.groupBy(record).agg(*cells, F.countDistinct(column).alias("holders")).where("holders > 1")


def unshared(rows: DataFrame, columns: Sequence, *, column: str, record: str) -> DataFrame:
    """How many records each of the chosen columns alone holds."""
    mine = rows.where(F.col(column).isin(*columns)).select(column, record).distinct()
    alone = mine.groupBy(record).agg(F.count("*").alias("_n"), F.min(column).alias(column)).where("_n = 1")
    every = rows.sparkSession.createDataFrame([(c,) for c in columns], f"{column} {rows.schema[column].dataType.simpleString()}")
    counts = alone.groupBy(F.col(column).alias("_c")).agg(F.count("*").alias("unshared"))
    return every.join(counts, F.col(column) == F.col("_c"), "left").select(column, F.coalesce("unshared", F.lit(0)).alias("unshared"))


def used_sources(members: DataFrame, entries: DataFrame, sources: DataFrame, *, member: str, house: str, kind: str, source: str) -> DataFrame:
    """For each member the sources of their house (or of both) whose kind some entry of theirs has."""
    used = entries.select(F.col(member).alias("_m"), F.col(kind).alias("_k")).distinct()
    mine = members.select(member, F.col(house).alias("_h")).join(used, F.col(member) == F.col("_m"))
    of = sources.select(F.col(source).alias("source"), F.col(house).alias("_sh"), F.col(kind).alias("_sk"))
    return mine.join(of, (F.col("_k") == F.col("_sk")) & ((F.col("_sh") == F.col("_h")) | (F.col("_sh") == "both"))).select(member, "source").distinct()


def coverage(facts: DataFrame, *, by: Sequence[str], current: str) -> DataFrame:
    """Members and current members (null counts as current) of each group and in all (null keys)."""
    rolled = facts.rollup(*by).agg(F.count("*").alias("members"), F.count_if(~F.col(current).eqNullSafe(F.lit(False))).alias("current"), F.grouping_id().alias("_level"))
    return rolled.withColumn("level", F.col("_level").cast("int")).drop("_level")


def distinct_letters(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each code point that some column has, variation selectors aside."""
    each = F.explode(F.array_distinct(F.flatten(F.array(*[F.split(F.coalesce(c, F.lit("")), "") for c in columns]))))
    return rows.select(each.alias("letter")).where((F.col("letter") != "") & ~F.col("letter").rlike("^[\\x{FE00}-\\x{FE0F}]$")).distinct()


def shown(rows: DataFrame, *, by: list[str], source: str) -> DataFrame:
    """How many rows of each group may be shown, as they name a source on the web under ``https``, and how many are held back."""
    good = F.coalesce(F.col(source).startswith("https://"), F.lit(False))
    return rows.groupBy(*by).agg(F.count_if(good).alias("shown"), F.count_if(~good).alias("suppressed"))


def source_scope(sources: DataFrame, *, by: list[str], name: str, pattern: str) -> DataFrame:
    """The first and last session that each group's sources name, read from their names by a pattern whose first group is the number; null, not 0, for a group without one: nothing was measured there."""
    number = F.regexp_extract(name, pattern, 1).try_cast("int")
    return sources.groupBy(*by).agg(F.min(number).alias("since"), F.max(number).alias("until"), F.count(number).alias("sources"))


def measured(counts: DataFrame, value: str) -> DataFrame:
    """Counts that say something: a count of zero is left out, as it can't be told from one not taken."""
    return counts.where(F.col(value) > 0)


def committee_bills(bills: DataFrame, *, kind: str, proposers: str, own: str) -> DataFrame:
    """Bills of a house's own kind that name no proposer: those that a committee proposed."""
    return bills.where((F.col(kind) == own) & (F.coalesce(F.size(proposers), F.lit(0)) <= 0))
