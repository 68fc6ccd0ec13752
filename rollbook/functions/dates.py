"""Dates of the Japanese calendar, years left out, numbers in kanji."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The year before each era's first.
ERAS = {"令和": 2018, "平成": 1988, "昭和": 1925}
KANJI_DIGITS = "〇一二三四五六七八九"
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"

_ERA_DATE = "(令和|平成|昭和)\\s*(元|\\d+)年\\s*(\\d{1,2})月\\s*(\\d{1,2})日"
_DATE = "(\\d{4})年\\s*(\\d{1,2})月\\s*(\\d{1,2})日"


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))


def era_to_iso(c: Column) -> Column:
    """The first era date of a text as yyyy-mm-dd, null if there is none. The range of month and day is not checked."""
    part = [F.regexp_extract(c, _ERA_DATE, i) for i in range(1, 5)]
    base = F.create_map(*[F.lit(x) for kv in ERAS.items() for x in kv])
    year = F.try_element_at(base, part[0]) + F.when(part[1] == "元", F.lit(1)).otherwise(part[1].try_cast("int"))
    return F.when(part[0] != "", _iso(year, part[2], part[3]))


def written_to_iso(c: Column) -> Column:
    """The first date of the form yyyy年m月d日."""
    part = [F.regexp_extract(c, _DATE, i) for i in range(1, 4)]
    return F.when(part[0] != "", _iso(*part))


def iso_to_era(date: Column) -> Column:
    """A date as an era date, by calendar year (each year's later era)."""
    year = F.year(date)
    era = F.when(year > ERAS["令和"], "令和").when(year > ERAS["平成"], "平成").otherwise("昭和")
    n = year - F.try_element_at(F.create_map(*[F.lit(x) for kv in ERAS.items() for x in kv]), era)
    return F.concat(era, F.when(n == 1, F.lit("元")).otherwise(n.cast("string")), F.lit("年"), F.month(date).cast("string"), F.lit("月"), F.day(date).cast("string"), F.lit("日"))


def year_of(month: Column, session_year: Column, session_month: Column, *, gap: int = 6, strict: bool = False) -> Column:
    """The year of a date written without one, from the session's year and month.

    A month at least ``gap`` (more, if ``strict``) before the session's month
    is of the next year.
    """
    behind = session_month - month
    return F.when((behind > gap) if strict else (behind >= gap), session_year + 1).otherwise(session_year)


def kanji_number(c: Column) -> Column:
    """Digits in kanji read place by place; null where another letter stands."""
    return F.when(c.rlike(f"^[{KANJI_DIGITS}]+$"), F.translate(c, KANJI_DIGITS, "0123456789").cast("long"))


def number_to_kanji(c: Column) -> Column:
    return F.translate(c.cast("string"), "0123456789", KANJI_DIGITS)


def strict_int(c: Column) -> Column:
    return F.when(c.rlike("^\\d+$"), c.try_cast("int"))


def log_day(c: Column) -> Column:
    """dd/Mon/yyyy as yyyy-mm-dd; the day as written, whatever the offset."""
    part = [F.regexp_extract(c, "^(\\d{2})/([A-Za-z]{3})/(\\d{4})", i) for i in range(1, 4)]
    month = F.ceil(F.position(part[1], F.lit(MONTHS)) / 3)
    return F.when((part[0] != "") & (F.position(part[1], F.lit(MONTHS)) > 0), _iso(part[2], month, part[0]))


def tokyo_date(ts: Column) -> Column:
    """The date in Tokyo of an instant given in UTC."""
    return F.to_date(ts + F.expr("INTERVAL 9 HOURS"))
