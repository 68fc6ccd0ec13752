"""Text functions on columns. All run in the JVM but the two that need NFKC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as the records have it, full-width and no-break spaces included.
SPACE = "[\\s\\u00a0\\u3000\\ufeff]"

# Letter variants that are one letter in names, and in local rosters.
NAME_VARIANTS = {"髙": "高", "﨑": "崎", "德": "徳", "濵": "浜", "邊": "辺", "邉": "辺"}
LOCAL_VARIANTS = {"髙": "高", "﨑": "崎", "𠮷": "吉", "德": "徳", "⾧": "長"}
# Rows of the table of fifty sounds; small letters and their full-sized form.
KANA_ROWS = {"あ": "あいうえお", "か": "かきくけこ", "さ": "さしすせそ", "た": "たちつてと", "な": "なにぬねの", "は": "はひふへほ", "ま": "まみむめも", "や": "やゆよ", "ら": "らりるれろ", "わ": "わゐゑをん"}
SMALL_KANA, LARGE_KANA = "ぁぃぅぇぉっゃゅょゎ", "あいうえおつやゆよわ"
OTHER_ROW = "その他"
# How records number an agenda's items, tell where a bill came from, address a member and count those not named.
AGENDA, ORIGINS, HONORIFIC, COMMAS, UNNAMED = "日程第", ("提出", "送付", "発議"), "君", "、，,", "^外\\d+名$"
DIGITS = "0123456789０１２３４５６７８９"
# Glyphs that mean one mark.
MARKS = {"〇": "○", "✕": "×"}

EXCERPT = 200  # code points


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility form; ASCII texts are passed through."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def bare_first_letter(texts: pd.Series) -> pd.Series:
    """The first letter without voicing marks; empty for no letter."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t[:1]) if c not in "゙゚"))


def _swap(c: Column, table: dict[str, str]) -> Column:
    return F.translate(c, "".join(table), "".join(table.values()))


def squash(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def no_space(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", "")


def name_key(c: Column) -> Column:
    return _swap(no_space(nfkc(c)), NAME_VARIANTS)


def local_name_key(c: Column) -> Column:
    """As ``name_key``, without the compatibility form; invisible variation selectors go."""
    return _swap(F.regexp_replace(F.regexp_replace(c, "[\\s\\u3000]", ""), "[\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}]", ""), LOCAL_VARIANTS)


def search_key(c: Column) -> Column:
    """Compatibility form, katakana as hiragana, no white space."""
    kata = "".join(chr(x) for x in range(0x30A1, 0x30F7))
    return no_space(F.translate(nfkc(c), kata, "".join(chr(ord(x) - 0x60) for x in kata)))


def bill_title(c: Column) -> Column:
    """A title without its agenda number in front and its note of origin at the end.

    The note is what the last bracket holds, if it closes the title, holds no
    other and names an origin.
    """
    whole = squash(c)
    behind = F.substr(whole, F.lit(len(AGENDA) + 1))
    bare = F.ltrim(behind, F.lit(DIGITS))
    title = F.when(whole.startswith(AGENDA) & (bare != behind), F.trim(bare)).otherwise(whole)
    note = F.substring_index(title, "（", -1)
    told = F.lit(False)
    for origin in ORIGINS:
        told = told | note.contains(origin)
    closes = title.contains("（") & (F.position(F.lit("）"), note) == F.length(note)) & told
    return F.when(closes, F.trim(F.substr(title, F.lit(1), F.length(title) - F.length(note) - 1))).otherwise(title)


def radicals_folded(c: Column) -> Column:
    """Kangxi radicals (which compatibility form alone would fold) as plain letters."""
    radicals = [chr(x) for x in range(0x2F00, 0x2FD6)]
    return F.translate(c, "".join(radicals), "".join(unicodedata.normalize("NFKC", x) for x in radicals))


def mark_key(c: Column) -> Column:
    return _swap(c, MARKS)


def _kept(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def _plain(name: Column) -> Column:
    """A name without the honorific at its end."""
    return F.when(name.endswith(HONORIFIC), F.substr(name, F.lit(1), F.length(name) - 1)).otherwise(name)


def proposers(c: Column) -> Column:
    """Names split at white space, without the honorific and the count of others."""
    return _kept(F.transform(F.filter(F.split(squash(c), " "), lambda x: ~x.rlike(UNNAMED)), _plain))


def group_list(c: Column) -> Column:
    return _kept(F.transform(F.split(F.regexp_replace(c, "(?i)<br\\s*/?>", ""), "[;；\\n]"), squash_ends))


def squash_ends(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def name_list(c: Column) -> Column:
    return _kept(F.transform(group_list(c), _plain))


def submitters(c: Column) -> Column:
    """Names that each end with the honorific before a comma, a space or the text's end, without the count of others."""
    text = squash(c)
    for comma in COMMAS:
        text = F.replace(F.replace(text, F.lit(f"{HONORIFIC} {comma}"), F.lit(f"{HONORIFIC}{comma}")), F.lit(HONORIFIC + comma), F.lit(f"{HONORIFIC} "))
    parts = F.split(F.concat(text, F.lit(" ")), f"{HONORIFIC} ")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(UNNAMED))


def committee_name(c: Column) -> Column:
    return F.substring_index(c, " ", 1)


def speech_body(c: Column) -> Column:
    """A speech without its leading mark and speaker, white space runs as one space."""
    return squash(F.regexp_replace(c, f"^○[^\\s\\u3000]+{SPACE}+", ""))


def excerpt(c: Column) -> Column:
    return F.substring(speech_body(c), 1, EXCERPT)


def date_and_result(c: Column) -> tuple[Column, Column]:
    """The parts before and after the first full-width slash."""
    parts = F.split(c, "／", 2)
    return squash(F.get(parts, F.lit(0))), squash(F.get(parts, F.lit(1)))


def kana_row(kana: Column) -> Column:
    """The row of the table of fifty sounds in which a reading begins."""
    kata = "".join(chr(x) for x in range(0x30A1, 0x30F7))
    head = F.translate(F.translate(bare_first_letter(kana), kata, "".join(chr(ord(x) - 0x60) for x in kata)), SMALL_KANA, LARGE_KANA)
    rows = F.create_map(*[F.lit(x) for row, letters in KANA_ROWS.items() for c in letters for x in (c, row)])
    return F.coalesce(F.try_element_at(rows, head), F.lit(OTHER_ROW))


def zip_code(c: Column) -> Column:
    """Seven digits, full-width ones and hyphens of all kinds allowed; null for anything else."""
    digits = F.regexp_replace(F.translate(c, "０１２３４５６７８９", "0123456789"), "[\\s\\u3000〒\\-ー－−‐–—]", "")
    return F.when(digits.rlike("^[0-9]{7}$"), digits)


def long_reading(name: Column, kana: Column, ratio: float = 3.5) -> Column:
    """Whether a reading is too long for its name; no reading never is, any reading of an empty name is."""
    n, k = F.length(no_space(F.coalesce(name, F.lit("")))), F.length(no_space(F.coalesce(kana, F.lit(""))))
    return F.when(k == 0, False).when(n == 0, True).otherwise(k > ratio * n)


def plain_prefecture(c: Column) -> Column:
    return F.when(c == "北海道", c).otherwise(F.regexp_replace(c, "[都府県]$", ""))


def place_key(c: Column) -> Column:
    """Place names with spelling variants folded."""
    return F.translate(nfkc(c), "ヶヵ驒", "ケカ騨")


def without_county(c: Column) -> Column:
    return F.regexp_replace(c, "^.*?郡", "")


def top_level_parts(c: Column, comma: str = "、", opening: str = "（(", closing: str = "）)") -> Column:
    """Parts between commas that stand outside all brackets; empty parts are dropped."""
    zero = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("now"), F.lit(0).alias("depth"))

    def step(s: Column, ch: Column) -> Column:
        depth = s["depth"] + F.when(F.position(ch, F.lit(opening)) > 0, 1).when(F.position(ch, F.lit(closing)) > 0, -1).otherwise(0)
        cut = (ch == comma) & (depth == 0)
        return F.struct(F.when(cut, F.array_append(s["parts"], s["now"])).otherwise(s["parts"]).alias("parts"), F.when(cut, F.lit("")).otherwise(F.concat(s["now"], ch)).alias("now"), depth.alias("depth"))

    return _kept(F.aggregate(F.split(c, ""), zero, step, lambda s: F.array_append(s["parts"], s["now"])))


def session_of(session: Column, id_: Column) -> Column:
    """A record's session, else the number its id begins with, else null."""
    return F.coalesce(session, F.expr("NULL").cast("int"), F.regexp_extract(id_, "^(\\d+)-", 1).try_cast("int"))
