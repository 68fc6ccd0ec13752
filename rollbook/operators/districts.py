"""Postal codes to electoral districts: units of a district table to municipalities, and their union for each code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rollbook.functions.text import place_key, plain_prefecture, without_county

UNKNOWN = "〓"  # a letter that could not be read; fits any one letter
SIGNS = r"[%\\]"  # in a pattern, what does not stand for one letter


def municipalities(postal: DataFrame) -> DataFrame:
    """One row for each municipality code."""
    return postal.select("code", "pref", "city").distinct()


def conflicting_codes(postal: DataFrame) -> DataFrame:
    """Codes with two names: the table is broken and must be refused."""
    return municipalities(postal).groupBy("code").agg(F.count("*").alias("names")).where("names > 1")


def _fitting(units: DataFrame, munis: DataFrame, name: str, *, whole: bool) -> DataFrame:
    """Units with the municipalities of their prefecture whose ``name`` fits, from its first letter on (``whole``) or at its end.

    A pattern's form is the pattern with a dot for every known letter. Names
    are written in the forms that their prefecture has, of their own length or
    for the end of any, so units and names meet where all known letters agree.
    """
    plain = units.where(~F.col("_like").rlike(SIGNS)).withColumn("_form", F.regexp_replace("_like", "(?s)[^_]", "."))
    forms = plain.select(F.col("pref").alias("_of"), "_form", F.length("_form").alias("_n")).distinct()
    blanks = F.filter(F.sequence(F.lit(1), F.greatest("_n", F.lit(1))), lambda i: F.substr("_form", i, F.lit(1)) == "_")
    held = forms.groupBy("_of", *(["_n"] if whole else [])).agg(F.collect_list(F.struct(F.col("_form").alias("form"), F.col("_n").alias("n"), blanks.alias("blanks"))).alias("_forms"))
    long = F.length(name)
    on = (F.col("_pref") == F.col("_of")) & (long == F.col("_n")) if whole else F.col("_pref") == F.col("_of")
    each = munis.join(held, on).select("_pref", "code", "city", name, F.explode(F.filter("_forms", lambda f: f["n"] <= long)).alias("_f"))
    end = F.when(F.col("_f.n") > 0, F.substr(F.col(name), long - F.col("_f.n") + 1)).otherwise("")
    written = each.select("_pref", "code", "city", F.col("_f.form").alias("_own"), F.aggregate("_f.blanks", end, lambda t, i: F.overlay(t, F.lit("_"), i, F.lit(1))).alias("_end"))
    return plain.join(written, (F.col("pref") == F.col("_pref")) & (F.col("_form") == F.col("_own")) & (F.col("_like") == F.col("_end")))


def match_units(units: DataFrame, munis: DataFrame, renames: DataFrame) -> DataFrame:
    """Units (pref, number, unit, partial) with the municipality each names, its tier, and how many fit.

    Tiers, of which the first with a hit counts: 1 the whole name, 2 the
    rename table, 3 a town or village without its county, 4 the name's end.
    The end is sought only for units without any hit before. Units with signs
    that stand for any number of letters are compared with every municipality
    of their prefecture. ``hits`` other than 1 (but in tier 2, where a unit may
    have become several) means that the unit can't be placed.
    """
    pattern = F.replace(place_key(F.col("unit")), F.lit(UNKNOWN), F.lit("_"))
    left = units.withColumn("_like", pattern)
    right = munis.select(F.col("pref").alias("_pref"), "code", "city", place_key(F.col("city")).alias("_city")).withColumn("_town", without_county(F.col("_city")))
    now = renames.select(F.col("pref").alias("_rpref"), F.col("former").alias("_former"), place_key(F.col("name")).alias("_now"), F.col("partial").alias("_rpartial"))
    town = F.col("_like").rlike("[町村]$")
    own = ["pref", "number", "unit"]

    def of_tier(found: DataFrame, tier: Column, partial: str | Column = "partial") -> DataFrame:
        return found.select(*own, partial, "code", "city", tier.alias("tier")).where("tier IS NOT NULL")

    renamed = left.join(now, (F.col("pref") == F.col("_rpref")) & (F.col("unit") == F.col("_former"))).join(right, (F.col("pref") == F.col("_pref")) & (F.col("_now") == F.col("_city")))
    fits = F.when(F.like("_city", F.col("_like")), 1).when(town & F.like("_town", F.col("_like")), 3).when(F.like("_city", F.concat(F.lit("%"), F.col("_like"))), 4)
    sure = (
        of_tier(_fitting(left, right, "_city", whole=True), F.lit(1))
        .unionByName(of_tier(renamed, F.lit(2), (F.col("partial") | F.coalesce("_rpartial", F.lit(False))).alias("partial")))
        .unionByName(of_tier(_fitting(left.where(town), right, "_town", whole=True), F.lit(3)))
        .unionByName(of_tier(left.where(F.col("_like").rlike(SIGNS)).join(right, F.col("pref") == F.col("_pref")), fits))
    )
    rest = left.join(sure.select(*own).distinct(), own, "left_anti")
    every = sure.unionByName(of_tier(_fitting(rest, right, "_city", whole=False), F.lit(4)))
    unit = Window.partitionBy(*own)
    best = every.withColumn("_best", F.min("tier").over(unit)).where("tier = _best").drop("_best")
    return best.withColumn("hits", F.count("*").over(unit))


def fitting_ends(asked: DataFrame, names: DataFrame, *, pattern: str, name: str, within: str) -> DataFrame:
    """``asked`` with each ``name`` of the same ``within`` whose end its ``pattern`` fits (``_`` for any one letter), and whether it fits the ``whole`` name."""
    left = asked.withColumnsRenamed({within: "pref", pattern: "_like"})
    right = names.select(F.col(within).alias("_pref"), F.col(name).alias("code"), F.col(name).alias("city"), F.col(name).alias("_name"))
    signs = left.where(F.col("_like").rlike(SIGNS)).join(right, F.col("pref") == F.col("_pref")).where(F.like("city", F.concat(F.lit("%"), F.col("_like"))))
    columns = [*left.columns, "city"]
    met = _fitting(left, right, "_name", whole=False).select(*columns).unionByName(signs.select(*columns))
    return met.select(*[F.col({within: "pref", pattern: "_like"}.get(c, c)).alias(c) for c in asked.columns], F.col("city").alias(name), F.like("city", F.col("_like")).alias("whole"))


def unplaced_units(units: DataFrame, matched: DataFrame) -> DataFrame:
    """Units that fit no municipality, or several where one was meant."""
    good = matched.where("hits = 1 OR tier = 2").select("pref", "number", "unit").distinct()
    return units.select("pref", "number", "unit").distinct().join(good, ["pref", "number", "unit"], "left_anti")


def municipality_districts(munis: DataFrame, matched: DataFrame) -> DataFrame:
    """Each municipality's district numbers in order, whether it is split, and whether a part of it is listed."""
    by = matched.where("hits = 1 OR tier = 2").groupBy("code").agg(F.array_sort(F.collect_set("number")).alias("numbers"), F.bool_or("partial").alias("partial"))
    return munis.join(by, "code", "left").withColumn("split", F.coalesce(F.size("numbers"), F.lit(0)) > 1)


def incomplete(resolved: DataFrame) -> DataFrame:
    """Municipalities without a district, and partial ones with only one."""
    return resolved.where("numbers IS NULL OR (partial AND size(numbers) < 2)").select(F.col("code").alias("entity"), F.when(F.col("numbers").isNull(), "no district").otherwise("partial in one district").alias("detail"))


def districts_meta(postal: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row of counts: postal codes, municipalities, districts and municipalities in several districts. A district is a prefecture's number."""
    codes = postal.agg(F.countDistinct("zip").alias("zips"))
    split = resolved.agg(F.count("*").alias("municipalities"), F.count_if("split").alias("split_municipalities"))
    numbers = resolved.select("pref", F.explode("numbers").alias("_n")).distinct().agg(F.count("*").alias("districts"))
    return codes.join(split).join(numbers)


def districts_by_zip(postal: DataFrame, resolved: DataFrame) -> DataFrame:
    """The union of districts and municipalities of each postal code; districts in natural order."""
    rows = postal.select("zip", "code").distinct().join(resolved.select("code", "pref", "city", F.explode("numbers").alias("_n")), "code")
    short = plain_prefecture(F.col("pref"))
    ordered = F.array_sort(F.collect_set(F.struct(short.alias("p"), F.col("_n").alias("n"))))
    return rows.groupBy("zip").agg(
        F.transform(ordered, lambda x: F.concat(x["p"], x["n"].cast("string"))).alias("districts"),
        F.transform(F.array_sort(F.collect_set(F.struct("code", F.concat("pref", "city").alias("name")))), lambda x: x["name"]).alias("municipalities"),
    )


def union_sets(rows: DataFrame, *, by: str, value: str, out: str) -> DataFrame:
    """The sorted set of values of each key, as text."""
    return rows.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias(out))


TOKEN = re.compile("[（(]|[）)]|、|第[0-9０-９]+区|[^（()）、第]+|第")
HEADING = re.compile("第([0-9０-９]+)区")


def _cut(text: str | None) -> dict:
    """A text cut at headings (``第N区`` outside all brackets) and at commas outside brackets: what stands before the first heading, each section's number and parts, and how many brackets stay open."""
    depth, parts, sections = 0, [[]], []
    head = parts
    for token in TOKEN.findall(re.sub(r"\s", "", text or "", flags=re.ASCII)):
        depth += (token in "（(") - (token in "）)")
        heading = HEADING.fullmatch(token) if depth == 0 else None
        if heading and int(heading[1]) < 2**31:
            parts = [[]]
            sections.append((int(heading[1]), parts))
        elif token == "、" and depth == 0:
            parts.append([])
        else:
            parts[-1].append(token)
    put = lambda parts: ["".join(p) for p in parts if p]
    return {"open": depth, "headed": "、".join(put(head)), "sections": [{"number": n, "parts": put(p)} for n, p in sections]}


def district_sections(texts: DataFrame, *, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Units of each district (pref, number, place, unit, area, raw) from a prefecture's text, and prefectures refused (entity, detail).

    A text has the prefecture's name, then districts numbered 1, 2, ..., each
    with units between commas outside brackets; a unit may end with an area in
    brackets. A text is refused as a whole, for the first that holds: its
    brackets don't close, it is headed otherwise, it has no district, its
    numbers are not consecutive, a district has no area, or a unit can't be read.
    Each text is read where it is; nothing is shuffled.
    """
    told = T.StructType([texts.schema["pref"], *T.StructType.fromDDL("open int, headed string, sections array<struct<number: int, parts: array<string>>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_pylist([{"pref": pref, **_cut(t)} for pref, t in rows], schema=to_arrow_schema(told))

    fields = "^([^（(]+)(?:[（(](.*)[）)])?$"

    def unit(raw: Column, i: Column) -> Column:
        area = F.when(raw.rlike("[）)]$") & raw.rlike(fields), F.regexp_extract(raw, fields, 2))
        return F.struct((i + 1).alias("place"), F.nullif(F.regexp_extract(raw, fields, 1), F.lit("")).alias("unit"), area.alias("area"), raw.alias("raw"))

    # a generator, past which no filter moves, so that units are worked out once
    read = texts.select("pref", F.col(text).alias("text")).mapInArrow(run, told).select(
        "pref", "open", "headed", F.explode(F.array(F.transform("sections", lambda s: F.struct(s["number"].alias("number"), F.transform(s["parts"], unit).alias("units"))))).alias("sections"))
    some = lambda holds: F.exists("sections", holds)
    reason = (
        F.when(F.col("open") != 0, "brackets left open").when(F.col("headed") != F.col("pref"), "headed otherwise").when(F.size("sections") == 0, "no district")
        .when(F.exists(F.transform("sections", lambda s, i: s["number"] != i + 1), lambda odd: odd), "numbers not consecutive").when(some(lambda s: F.size(s["units"]) == 0), "district without area")
        .when(some(lambda s: F.exists(s["units"], lambda u: u["unit"].isNull())), "unit unreadable")
    )
    judged = read.withColumn("detail", reason)
    good = judged.where("detail IS NULL").select("pref", F.explode("sections").alias("s")).select("pref", "s.number", F.inline("s.units"))
    return good.select("pref", "number", "place", "unit", "area", "raw"), judged.where("detail IS NOT NULL").select(F.col("pref").alias("entity"), "detail")
