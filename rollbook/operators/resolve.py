"""Entity resolution of names against rosters with validity intervals.

Never guess: a record whose candidates can't be told apart has no match.
Rosters are tables of terms, one row for each member, key and interval of
sessions; ``since`` and ``until`` are inclusive, and a null ``until`` means the
one session ``since``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Terms:
    """Column names of a table of terms. ``ends`` (a date) and ``group`` may be absent; ``pos`` orders a member's terms."""

    member: str = "member"
    key: str = "key"
    since: str = "since"
    until: str = "until"
    group: str | None = "grp"
    ends: str | None = None
    pos: str | None = None


def name_keys(members: DataFrame, keys: Sequence[Column], *, key: str = "key") -> DataFrame:
    """Members once under each of their distinct non-empty keys (a name and a legal name, say)."""
    distinct = F.filter(F.array_distinct(F.array(*keys)), lambda k: k.isNotNull() & (k != ""))
    return members.withColumn(key, F.explode(distinct))


def until_of(t: Terms) -> Column:
    return F.coalesce(F.col(t.until), F.col(t.since))


ASK = ("_key", "_at", "_group", "_date")


def _asks(records: DataFrame, *, key: str, at: str, group: str | None, date: str | None) -> list[Column]:
    column = lambda name: F.col(name) if name else F.lit(None).cast("string")
    return [c.alias(n) for c, n in zip((F.col(key), F.col(at), column(group), column(date)), ASK, strict=True)]


def in_tenure(sessions: DataFrame, terms: DataFrame, *, t: Terms = Terms()) -> DataFrame:
    """One row for each key and session (``_key``, ``_at``) and member of the key that may be in office then: ``direct``, ``over`` and ``group_then``.

    ``direct``: a term covers the session. ``over``: the latest end date of
    the terms whose sessions are past, up to which the member is in office all
    the same; null for those in office directly. ``group_then`` is the group of
    the term in force: the first that covers the session, else the one with the
    latest end before it; later terms never count.
    """
    side = terms.select(
        F.col(t.key).alias("_term_key"), F.col(t.member).alias("member"), F.col(t.since).alias("_since"), until_of(t).alias("_until"),
        (F.col(t.group) if t.group else F.lit(None).cast("string")).alias("_group"), (F.col(t.ends) if t.ends else F.lit(None).cast("string")).alias("_ends"),
        (F.col(t.pos) if t.pos else F.lit(0)).alias("_pos"),
    )
    met = sessions.join(side, (F.col("_key") == F.col("_term_key")) & (F.col("_since") <= F.col("_at")))
    covers = F.col("_at") <= F.col("_until")
    in_force = F.max_by("_group", F.struct(covers.alias("c"), F.when(covers, 0).otherwise(F.col("_until")).alias("u"), (-F.col("_pos")).alias("p")))
    over = F.max(F.when((F.col("_until") < F.col("_at")) & (F.col("_ends") != ""), F.col("_ends")))
    found = met.groupBy("_key", "_at", "member").agg(F.coalesce(F.bool_or(covers), F.lit(False)).alias("direct"), over.alias("over"), in_force.alias("group_then"))
    return found.withColumn("over", F.when(~F.col("direct"), F.col("over"))).where("direct OR over IS NOT NULL")


def _running(asks: DataFrame, people: DataFrame, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """``asks`` with sums over the people of the same ``by`` who are in office directly, or over at least up to the asked date.

    People come before the asks that count them: who is direct before all, then
    by date from the latest. An ask without a date counts the direct alone.
    """
    held = people.withColumnsRenamed({"over": "_date"}).withColumns({"_rank": F.when(F.col("direct"), 0).otherwise(2), "_asks": F.lit(0)})
    asked = asks.withColumns({"_rank": F.when(F.col("_date").isNull(), 1).otherwise(2), "_asks": F.lit(1)})
    so_far = Window.partitionBy(*by).orderBy("_rank", F.desc("_date"), "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = held.unionByName(asked, allowMissingColumns=True).withColumns({n: c.over(so_far) for n, c in sums.items()})
    return both.where("_asks = 1").select(*asks.columns, *sums)


def tallies(records: DataFrame, terms: DataFrame, *, key: str, at: str, group: str | None, date: str | None, t: Terms, same_group: DataFrame | None = None) -> DataFrame:
    """For each distinct key, session, group and date that records ask about: how many members of the key are in office then, of the group, and of the group directly, and the greatest of each.

    ``same_group`` (``roster_group``, ``record_group``) lists groups that are
    one. Records and members never meet in pairs: members are counted for each
    session that their key is asked about, and asks take running sums.
    """
    asks = records.select(*_asks(records, key=key, at=at, group=group, date=date)).where("_key IS NOT NULL AND _at IS NOT NULL").distinct()
    found = in_tenure(asks.select("_key", "_at").distinct(), terms, t=t)
    kinds = ["_key", "_at", "direct", "over"]
    held = found.groupBy(*kinds, *(["group_then"] if group else [])).agg(F.count("*").alias("_c"), F.max("member").alias("_m"))
    everyone = held.groupBy(*kinds).agg(F.sum("_c").alias("_c"), F.max("_m").alias("_m")) if group else held
    counted = _running(asks, everyone, ["_key", "_at"], {"_n": F.sum("_c"), "_one": F.max("_m")})
    if not group:
        return counted.withColumns({"_g": F.lit(0), "_d": F.lit(0), "_of_group": F.lit(None).cast(found.schema["member"].dataType), "_direct": F.lit(None).cast(found.schema["member"].dataType)})
    as_one = F.array("group_then")
    if same_group is not None:
        alias = same_group.groupBy(F.col("roster_group").alias("_rg")).agg(F.collect_set("record_group").alias("_also"))
        held = held.join(alias, F.col("group_then") == F.col("_rg"), "left")
        as_one = F.array_distinct(F.concat(as_one, F.coalesce("_also", F.array().cast("array<string>"))))
    mine = held.withColumn("_group", F.explode(as_one)).where("_group IS NOT NULL").groupBy(*kinds, "_group").agg(F.sum("_c").alias("_c"), F.max("_m").alias("_m"))
    direct = F.col("direct")
    return _running(counted, mine, ["_key", "_at", "_group"], {
        "_g": F.sum("_c"), "_d": F.sum(F.when(direct, F.col("_c"))), "_of_group": F.max("_m"), "_direct": F.max(F.when(direct, F.col("_m"))),
    })


def _told(records: DataFrame, counts: DataFrame, *, key: str, at: str, group: str | None, date: str | None) -> DataFrame:
    """``records``, each with what was counted for what it asks."""
    met = counts.withColumnsRenamed({n: f"_ask{n}" for n in ASK})
    on = (F.col(key) == F.col("_ask_key")) & (F.col(at) == F.col("_ask_at"))
    for name, asked in ((group, "_ask_group"), (date, "_ask_date")):
        on = on & F.col(name).eqNullSafe(F.col(asked)) if name else on
    return records.join(met, on, "left").drop(*[f"_ask{n}" for n in ASK])


def resolve(records: DataFrame, terms: DataFrame, *, record: str, key: str, at: str, group: str | None = None, date: str | None = None, t: Terms = Terms(), same_group: DataFrame | None = None) -> DataFrame:
    """``records`` with ``member`` (null where unresolved) and ``branch``, how it was decided.

    Among members of the key in office then: a single one wins; else the
    single one of the record's group; else, among several of the group, the
    single one that a term covers directly; else none. ``branch``: none,
    single, group, direct or ambiguous. Dates are ISO texts. What several
    records (each known by ``record``) ask alike is decided once.
    """
    ask = dict(key=key, at=at, group=group, date=date)
    counts = tallies(records, terms, **ask, t=t, same_group=same_group)
    branch = F.when(F.coalesce("_n", F.lit(0)) == 0, "none").when(F.col("_n") == 1, "single").when(F.col("_g") == 1, "group").when((F.col("_g") > 1) & (F.col("_d") == 1), "direct").otherwise("ambiguous")
    member = F.when(F.col("_branch") == "single", F.col("_one")).when(F.col("_branch") == "group", F.col("_of_group")).when(F.col("_branch") == "direct", F.col("_direct"))
    return _told(records, counts, **ask).withColumn("_branch", branch).select(*records.columns, member.alias("member"), F.col("_branch").alias("branch"))


def resolve_two_tier(records: DataFrame, terms: DataFrame, fallback: DataFrame, *, record: str, key: str, second_key: str, at: str, date: str | None = None, t: Terms = Terms()) -> DataFrame:
    """``records`` with ``member``, ``matched_by`` and ``reason``: by name, and only where the roster lacks the name, by the second key.

    A name that is in the roster but can't be resolved stops there. By the
    second key one member in office wins; several are ambiguous.
    """
    first = resolve(records, terms, record=record, key=key, at=at, date=date, t=t)
    known = terms.select(F.col(t.key).alias("_known")).distinct()
    first = first.join(known, F.col(key) == F.col("_known"), "left")
    ask = dict(key=second_key, at=at, group=None, date=date)
    both = _told(first, tallies(records, fallback, **ask, t=t), **ask)
    hits = F.when(F.col("member").isNull() & F.col("_known").isNull(), F.col("_n"))
    by_second = F.when(hits == 1, F.col("_one"))
    return both.select(
        *records.columns, F.coalesce("member", by_second).alias("member"),
        F.when(F.col("member").isNotNull(), "name").when(hits == 1, "second").alias("matched_by"),
        F.when(F.col("member").isNotNull() | (F.coalesce(hits, F.lit(0)) == 1), F.lit(None)).when(hits > 1, "ambiguous").otherwise("no-candidate").alias("reason"),
    )


def repeated_members(matched: DataFrame, *, call: str, member: str = "member") -> DataFrame:
    """Members that one roll call holds twice: a sign of broken data, to be refused."""
    return matched.where(F.col(member).isNotNull()).groupBy(call, member).agg(F.count("*").alias("times")).where("times > 1")


def group_mismatches(matched: DataFrame, terms: DataFrame, *, group: str, t: Terms = Terms(), same_group: DataFrame | None = None) -> DataFrame:
    """Matched records whose group is that of none of the member's terms."""
    of = terms.select(F.col(t.member).alias("_m"), F.col(t.group).alias("_g")).distinct()
    if same_group is not None:
        more = of.join(same_group, F.col("_g") == F.col("roster_group")).select("_m", F.col("record_group").alias("_g"))
        of = of.unionByName(more).distinct()
    return matched.where(F.col("member").isNotNull()).join(of, (F.col("member") == F.col("_m")) & F.col(group).eqNullSafe(F.col("_g")), "left_anti")


def agreed_value(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The value of each key whose rows all agree; keys in conflict have none."""
    return rows.where(F.col(value).isNotNull()).groupBy(by).agg(F.countDistinct(value).alias("_kinds"), F.max(value).alias(value)).where("_kinds = 1").drop("_kinds")


def match_with_fallback(records: DataFrame, by_id: DataFrame, by_title: DataFrame, *, id_col: str, title: str, value: str) -> DataFrame:
    """``records`` with ``value`` by id, else by title; only keys whose rows agree count."""
    one = agreed_value(by_id, id_col, value).withColumnsRenamed({id_col: "_i", value: "_v1"})
    two = agreed_value(by_title, title, value).withColumnsRenamed({title: "_t", value: "_v2"})
    return records.join(one, F.col(id_col) == F.col("_i"), "left").join(two, F.col(title) == F.col("_t"), "left").withColumn(value, F.coalesce("_v1", "_v2")).drop("_i", "_v1", "_t", "_v2")


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether all letters of ``short`` (at least two) stand in ``long`` in order."""
    step = F.aggregate(
        F.split(short, ""), F.lit(1),
        lambda at, c: F.when(at == 0, 0).otherwise(F.when(F.position(c, long, at) > 0, F.position(c, long, at) + 1).otherwise(0)),
    )
    return (F.length(short) >= 2) & (step > 0)


def hamming_one(a: Column, b: Column) -> Column:
    """Whether two texts of one length differ in exactly one letter."""
    differ = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda n, x: n + x)
    return (F.length(a) == F.length(b)) & (differ == 1)


def match_names(records: DataFrame, roster: DataFrame, *, key: str, roster_key: str, member: str, how: str, block: str | None = None) -> DataFrame:
    """``records`` with ``member`` (null unless exactly one fits), ``hits`` and the sorted ``candidates``.

    ``how``: exact, prefix (the roster's name begins with the key) or
    subsequence (an exact hit pre-empts it). Distinct keys are matched once;
    ``block`` names a column of both sides that must agree, which keeps the
    non-equi join within it; without one, keys meet the names that begin with
    their first letter (prefix) or hold it (subsequence). An empty key is no
    prefix of any name.
    """
    keys = [key] + ([block] if block else [])
    wanted = records.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).where(F.col("_0").isNotNull()).distinct()
    side = roster.select(F.col(roster_key).alias("_name"), F.col(member).alias("_member"), *([F.col(block).alias("_block")] if block else []))
    within = F.col("_1") == F.col("_block") if block else F.lit(True)
    exact = wanted.join(side, within & (F.col("_0") == F.col("_name")))
    if how == "exact":
        hits = exact
    else:
        fits = F.col("_name").startswith(F.col("_0")) if how == "prefix" else is_subsequence(F.col("_0"), F.col("_name"))
        rest = wanted if how == "prefix" else wanted.join(exact.select(*wanted.columns).distinct(), wanted.columns, "left_anti")
        if block is None:
            letters = F.array(F.substring("_name", 1, 1)) if how == "prefix" else F.array_distinct(F.split("_name", ""))
            side = side.withColumn("_letter", F.explode(letters))
            within = F.substring("_0", 1, 1) == F.col("_letter")
        hits = rest.where("_0 <> ''").join(side, within & fits).select(*wanted.columns, "_name", "_member")
        hits = hits if how == "prefix" else hits.unionByName(exact.select(*hits.columns))
    found = hits.groupBy(*wanted.columns).agg(F.array_sort(F.collect_set("_member")).alias("candidates"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_{i}"))
    n = F.coalesce(F.size("candidates"), F.lit(0))
    return records.join(found, on, "left").select(*records.columns, F.when(n == 1, F.get("candidates", F.lit(0))).alias("member"), n.alias("hits"), F.when(n > 1, F.col("candidates")).alias("candidates"))


def one_letter_apart(roster: DataFrame, *, name: str, member: str) -> DataFrame:
    """Pairs of distinct names of one length that differ in one letter.

    Joined on the name with one place left out, so only likely pairs meet.
    """
    holes = roster.select(F.col(name).alias("name"), F.col(member).alias("member")).where(F.length("name") > 0).distinct().withColumn("at", F.explode(F.sequence(F.lit(1), F.length("name"))))
    holes = holes.withColumn("hole", F.concat(F.substr("name", F.lit(1), F.col("at") - 1), F.substr("name", F.col("at") + 1)))
    other = holes.toDF("name_b", "member_b", "at_b", "hole_b")
    return holes.join(other, (F.col("hole") == F.col("hole_b")) & (F.col("at") == F.col("at_b")) & (F.length("name") == F.length("name_b")) & (F.col("name") < F.col("name_b"))).select("name", "member", "name_b", "member_b").distinct()
