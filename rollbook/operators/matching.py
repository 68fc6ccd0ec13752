"""Names that records list (proposers, supporters, attendees, speakers), resolved and laid back on their records.

Names are the facts and ids follow from them: where a session was asked, ids of
earlier runs never outlive the names. Sessions that no roster covers can be
left unasked; their records pass through as they are and nothing of them counts
as unmatched.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.operators.resolve import Terms, resolve


def mentions(
    records: DataFrame, terms: DataFrame, *, record: str, names: Column, at: str, date: str | None = None, group: str | None = None, house: str | None = None,
    t: Terms = Terms(), covered: DataFrame | None = None, same_group: DataFrame | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """One row for each name that a record lists: ``record``, ``place`` (from 0), ``name``, ``member``, ``branch`` and the columns ``keep``.

    ``names`` is an array; null or empty ones and null names give no row.
    ``house`` is a column of records and terms alike: a name is sought in its
    own house alone. ``covered`` (``session``) lists the sessions to ask about.
    A name is resolved once for each session, date and group it is listed
    under, however many records list it.
    """
    def column(name: str | None) -> Column:
        return F.col(name) if name else F.lit(None).cast("string")

    each = records.select(F.col(record).alias("record"), F.col(at).alias("_at"), column(date).alias("_date"), column(group).alias("_group"), column(house).alias("_house"), *keep, F.posexplode(names).alias("place", "name")).where("name IS NOT NULL")
    if covered is not None:
        each = each.join(covered.select(F.col("session").alias("_session")), F.col("_at") == F.col("_session"), "left_semi")
    each = each.withColumn("_name", F.concat_ws("\t", F.coalesce("_house", F.lit("")), "name"))
    side = terms.withColumn("_term_key", F.concat_ws("\t", F.coalesce(column(house), F.lit("")), F.col(t.key)))
    found = resolve(each, side, record="record", key="_name", at="_at", group="_group" if group else None, date="_date" if date else None, t=replace(t, key="_term_key"), same_group=same_group)
    return found.select("record", "place", "name", "member", "branch", *keep)


def with_members(records: DataFrame, found: DataFrame, *, record: str, out: str, at: str | None = None, covered: DataFrame | None = None) -> DataFrame:
    """``records`` with ``out``, the members found for each in the order of their names; null where none was.

    An ``out`` that a record brings stays only where its session is not in
    ``covered``; without ``covered`` none stays.
    """
    lists = found.where(F.col("member").isNotNull()).groupBy(F.col("record").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("place", "member"))).alias("_found"))
    both = records.join(lists, F.col(record) == F.col("_of"), "left")
    ids = F.col("_found.member")
    if covered is not None and out in records.columns:
        both = both.join(covered.select(F.col("session").alias("_session")).distinct(), F.col(at) == F.col("_session"), "left")
        ids = F.when(F.col("_session").isNotNull(), ids).otherwise(F.col(out))
    return both.select(*[c for c in records.columns if c != out], ids.alias(out))


def unmatched(found: DataFrame, *, unless: Column | None = None) -> DataFrame:
    """Names without a member, but for those that ``unless`` excuses (a speaker who holds an office, say); a null excuses none."""
    open_ = found.where(F.col("member").isNull())
    return open_ if unless is None else open_.where(~F.coalesce(unless, F.lit(False)))


def undated(records: DataFrame, *, record: str, names: Column, date: str) -> DataFrame:
    """Records with names but without the date that would place them: entity and detail, to be refused before any match."""
    return records.where((F.size(names) > 0) & (F.col(date).isNull() | (F.col(date) == ""))).select(F.col(record).cast("string").alias("entity"), F.lit("names without a date").alias("detail"))


def unattested(records: DataFrame, found: DataFrame, *, record: str, ids: str, at: str, covered: DataFrame) -> DataFrame:
    """Records that hold ids which none of their own names resolves to: left over from an earlier run.

    Rows: ``record``, how many ``names`` it lists and ``ids`` it holds, how many
    members the names ``attested``, and the ids that are ``unattested``. Records
    of sessions outside ``covered`` are not judged (see ``attestation``).
    """
    held = records.where(F.size(ids) > 0).join(covered.select(F.col("session").alias("_session")), F.col(at) == F.col("_session"), "left_semi").select(F.col(record).alias("_of"), F.col(ids).alias("_ids"))
    named = found.groupBy("record").agg(F.count("*").alias("_names"), F.collect_set("member").alias("_known"))
    both = held.join(named, F.col("_of") == F.col("record"), "left")
    known = F.coalesce("_known", F.array().cast(found.select(F.array("member")).schema[0].dataType))
    rest = F.filter("_ids", lambda x: ~F.array_contains(known, x))
    return both.select(F.col("_of").alias("record"), F.coalesce("_names", F.lit(0)).alias("names"), F.size("_ids").alias("ids"), F.size(known).alias("attested"), rest.alias("unattested")).where(F.size("unattested") > 0)


def attestation(records: DataFrame, *, ids: str, at: str, covered: DataFrame) -> DataFrame:
    """One row: records with ids that can be ``checked`` against their names, and those ``skipped`` as no roster covers their session. None found means nothing where none was checked."""
    both = records.where(F.size(ids) > 0).join(covered.select(F.col("session").alias("_session")).distinct(), F.col(at) == F.col("_session"), "left")
    return both.agg(F.count_if(F.col("_session").isNotNull()).alias("checked"), F.count_if(F.col("_session").isNull()).alias("skipped"))
