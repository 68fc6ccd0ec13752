"""Small relational steps of assembling records: ids, texts of results, legends, eras, roll-ups of what was not matched."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.text import KANA_ROWS, OTHER_ROW, kana_row, search_key
from rollbook.session import written


def profile_id(prefix: str, profile: Column) -> Column:
    """The prefix and the last six of a seven-digit number; null for any other."""
    return F.when(profile.rlike("^\\d{7}$"), F.concat(F.lit(prefix), F.right(profile, F.lit(6))))


def hashed_id(prefix: str, *parts: Column) -> Column:
    """The prefix and the first ten digits of the SHA-1 of the parts, white space left out, joined by a tab."""
    bare = [F.regexp_replace(p, "[\\s\\u00a0\\u3000\\ufeff]+", "") for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("\t", *bare)), 1, 10))


def capped_id(id_: Column, limit: int) -> Column:
    """An id of at most ``limit`` bytes: a longer one is cut between letters and ends with eight digits of its SHA-256."""
    suffix = F.concat(F.lit("-h"), F.substring(F.sha2(id_, 256), 1, 8))

    @F.pandas_udf(T.StringType())
    def head(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t.encode()[: limit - 10].decode("utf-8", "ignore"))

    return F.when(F.octet_length(id_) <= limit, id_).otherwise(F.concat(head(id_), suffix))


def result_text(decision: Column, yes: Column, no: Column) -> Column:
    """The tally as text, after the decision where there is one."""
    tally = F.concat(F.lit("賛成 "), yes.cast("string"), F.lit("・反対 "), no.cast("string"))
    return F.when(F.nullif(decision, F.lit("")).isNotNull(), F.concat(decision, F.lit("（"), tally, F.lit("）"))).otherwise(tally)


def unlisted(rows: DataFrame, listed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct keys of ``rows`` that the header list lacks."""
    return rows.select(*by).distinct().join(listed.select(*by).distinct(), list(by), "left_anti")


def in_era(rows: DataFrame, eras: DataFrame, *, date: str, name: str, era_name: str, since: str, until: str) -> DataFrame:
    """``rows`` with ``known``: whether the list in force on the date has the name; null where no list covers the date."""
    covered = eras.select(F.col(since).alias("_s"), F.col(until).alias("_u")).distinct()
    own = rows.join(covered, (F.col("_s") <= F.col(date)) & (F.col("_u").isNull() | (F.col(date) < F.col("_u"))), "left")
    names = eras.select(F.col(since).alias("_s2"), F.col(era_name).alias("_n"), F.lit(True).alias("_hit"))
    both = own.join(names, (F.col("_s") == F.col("_s2")) & (F.col(name) == F.col("_n")), "left")
    return both.withColumn("known", F.when(F.col("_s").isNotNull(), F.coalesce("_hit", F.lit(False)))).select(*rows.columns, "known")


def mapped(rows: DataFrame, legend: DataFrame, *, mark: str, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``mapped``, what the legend says of the mark; null for a mark it lacks, which itself stays."""
    return rows.join(legend.select(*by, F.col(mark), "mapped"), [*by, mark], "left")


def unmatched_rollup(rows: DataFrame, by: Sequence[str], record: str) -> DataFrame:
    """Each unmatched name once, with how many records and the sorted list of them as text."""
    return rows.groupBy(*by).agg(F.count("*").alias("records"), F.array_join(F.array_sort(F.collect_set(record)), ",").alias("record_ids"))


def reasons(rows: DataFrame, by: Sequence[str], reason: Column) -> DataFrame:
    """How many candidates were taken and how many dropped for each reason; reasons of none are left out."""
    return rows.groupBy(*by, F.coalesce(reason, F.lit("taken")).alias("reason")).agg(F.count("*").alias("candidates"))


def linked_sums(rows: DataFrame, by: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Sums with null as 0; groups without rows have none."""
    return rows.groupBy(*by).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counts])


def greatest_by(rows: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The value of the greatest row of each group; of equals, that of the later key in ``order``."""
    return rows.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value), F.max(F.struct(*order))[order[0]].alias(order[0]))


def last_wins(kept: DataFrame, newer: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both; of one key in ``newer`` the last, in place of that in ``kept``."""
    latest = newer.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_nth = 1").drop("_nth", order)
    return kept.join(latest.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti").unionByName(latest)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, and which."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))


def newest(rows: DataFrame, session: str, n: int) -> DataFrame:
    """Rows of the ``n`` newest sessions; these alone are sent to the tasks."""
    top = rows.select(F.col(session).alias("_s")).distinct().orderBy(F.desc("_s")).limit(n)
    return rows.join(top, F.col(session) == F.col("_s"), "left_semi")


def natural_key(c: Column) -> list[Column]:
    """Sort keys that put 2 before 10: the text before the number at the end, and the number."""
    return [F.regexp_replace(c, "\\d+$", ""), F.regexp_extract(c, "(\\d+)$", 1).try_cast("long")]


def reachable(links: DataFrame, start: DataFrame, *, src: str, dst: str) -> DataFrame:
    """Pages reached from the start pages and in how many steps at least.

    Breadth-first: each round follows the links of the pages found last, leaves
    out pages met before, and is written to the shared folder; it ends when
    nothing new is found, however far or round about the links lead. Null pages
    are none.
    """
    ways = links.select(F.col(src).alias("_src"), F.col(dst).alias("page")).where("_src IS NOT NULL AND page IS NOT NULL").distinct()
    found = last = written(start.toDF("page").where("page IS NOT NULL").distinct().withColumn("steps", F.lit(0)))
    steps = 0
    while not last.isEmpty():
        steps += 1
        met = ways.join(last.select(F.col("page").alias("_from")), F.col("_src") == F.col("_from")).select("page").distinct()
        last = written(met.join(found.select("page"), "page", "left_anti").withColumn("steps", F.lit(steps)))
        found = found.unionAll(last)
    return found


def ordered_names(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Names of each group in order, as text, and how many."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(name)), ",").alias("names"))


def first_by_parameter(sources: DataFrame, *, url: str, parameter: str, by: Sequence[str], order: str) -> DataFrame:
    """The first source of each group whose URL has the query parameter."""
    found = sources.withColumn("value", F.regexp_extract(url, f"[?&]{parameter}=([^&#]*)", 1)).where("value <> ''")
    return found.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("_nth = 1").select(*by, "value", order)


def kana_groups(members: DataFrame, *, kana: str, tie: str, letters: int = 2) -> DataFrame:
    """``members`` with ``row`` (of the table of fifty sounds), ``head`` (their first letters, katakana as hiragana) and ``place`` among those of one head.

    Readings are in Japanese order, in which katakana stand with hiragana and
    voiced letters after plain ones of the same reading; code points would put
    all katakana last. Readings that are equal in it stand by ``tie``. No group
    is larger than the names that begin alike.
    """
    head = search_key(F.substring(kana, 1, letters))
    by = Window.partitionBy("row", "head").orderBy(F.collate(kana, "ja"), tie)
    return members.withColumns({"row": kana_row(F.col(kana)), "head": head}).withColumn("place", F.row_number().over(by))


def in_kana_order(members: DataFrame, *, kana: str, tie: str) -> DataFrame:
    """``members`` sorted by row, then in Japanese order; readings outside the table come last. One range shuffle."""
    rows = F.array(*[F.lit(r) for r in (*KANA_ROWS, OTHER_ROW)])
    return members.orderBy(F.array_position(rows, kana_row(F.col(kana))), F.collate(kana, "ja"), tie)
