"""Kinds of bills, results read back, names that can't be right and why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.text import local_name_key, nfkc, squash

# Kinds of bills as they are published, the two that stand in a category's bracket and those told by a word in it.
GOVERNMENT, GOVERNMENT_NOTE, OTHER = "閣法", "内閣提出", "その他"
HOUSES = ("衆法", "参法")
SUBJECTS = ("予算", "条約", "承認", "決議")
KINDS = (GOVERNMENT, *HOUSES, *SUBJECTS)
# Letters that a name may have, as ranges of code points (marks of repetition, kana, unified letters, the middle dot and spaces).
NAME_LETTERS = "々\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2A6DF}・\\s　"
BROKEN, CONFLICT = "brokenGlyph", "sourceConflict"


def bill_kind(category: Column) -> Column:
    """A category's kind: what its first bracket says, where that tells who proposed it, else the first subject it names, else ``その他``."""
    note = F.regexp_extract(category, "（([^（）]+)）", 1)
    subjects = [F.when(category.contains(s), s) for s in SUBJECTS]
    return F.when(note == GOVERNMENT_NOTE, GOVERNMENT).when(note.isin(*HOUSES), note).otherwise(F.coalesce(*subjects, F.lit(OTHER)))


def known_kind(kind: Column) -> Column:
    """A kind as it is published if it is one of the known, else ``その他``."""
    return F.when(kind.isin(*KINDS), kind).otherwise(OTHER)


def result_parts(result: Column) -> Column:
    """A result's text as a struct of decision, yes and no, the inverse of ``records.result_text``: no decision where it has the tally alone, all null where it is no such text."""
    tally = "賛成 (\\d+)・反対 (\\d+)"
    whole = f"^(?:(.+?)（{tally}）|{tally})$"
    part = lambda i: F.nullif(F.regexp_extract(result, whole, i), F.lit(""))
    return F.struct(part(1).alias("decision"), F.coalesce(part(2), part(4)).cast("int").alias("yes"), F.coalesce(part(3), part(5)).cast("int").alias("no"))


def broken_letters(name: Column) -> Column:
    """The letters of a name that no name can have, each once, in order; what they stood for is not guessed. Variants of letters and invisible selectors are folded first."""
    rest = F.regexp_replace(local_name_key(name), f"[{NAME_LETTERS}]", "")
    return F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(rest), F.lit(1))), lambda i: F.substr(rest, i, F.lit(1))), lambda c: c != ""))


def unmatched_reason(name: Column, conflicts: Column) -> Column:
    """Why a name matched nothing: letters are broken, or (only where they are not) sources differ in it; null for neither."""
    return F.when(F.size(broken_letters(name)) > 0, BROKEN).when(F.coalesce(conflicts, F.lit(False)), CONFLICT)


def name_and_legal(cell: Column) -> Column:
    """A name cell's text (line breaks as newlines) as a struct of name, its first line, and legal, the name that the rest has in square brackets; null where it has none."""
    lines = F.split(cell, "\n", 2)
    rest = squash(F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), "\n", " "))
    inner = F.substr(rest, F.lit(2), F.greatest(F.length(rest) - 2, F.lit(0)))
    held = F.substr(rest, F.lit(1), F.lit(1)).isin("[", "［") & F.substr(rest, F.length(rest), F.lit(1)).isin("]", "］") & (F.trim(inner) != "")
    return F.struct(squash(F.get(lines, F.lit(0))).alias("name"), F.when(held, F.trim(inner)).alias("legal"))


def effective_date(text: Column) -> Column:
    """The first era date of a text as a struct of date (ISO) and text, as written in the text itself with ``発足`` behind it; null fields for none. Full-width figures count."""
    pattern = "(令和|平成)\\s*(元|[0-9]+)年\\s*([0-9]{1,2})月\\s*([0-9]{1,2})日(発足)?"
    folded = nfkc(text)
    hit = F.regexp_extract(folded, pattern, 0)
    year = F.when(F.regexp_extract(folded, pattern, 1) == "令和", 2018).otherwise(1988) + F.when(F.regexp_extract(folded, pattern, 2) == "元", 1).otherwise(F.regexp_extract(folded, pattern, 2).try_cast("int"))
    iso = F.concat_ws("-", year.cast("string"), *[F.lpad(F.regexp_extract(folded, pattern, i), 2, "0") for i in (3, 4)])
    # the compatibility form cuts the text itself only where it has as many letters
    same = F.length(folded) == F.length(text)
    raw = F.when(same, F.substr(text, F.position(hit, folded), F.length(hit))).otherwise(hit)
    return F.struct(F.when(hit != "", iso).alias("date"), F.when(hit != "", raw).alias("text"))
