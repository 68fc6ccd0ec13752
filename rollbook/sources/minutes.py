"""Minutes of meetings as landed pages of JSON: speeches, attendance and rosters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.dates import kanji_number
from rollbook.functions.text import excerpt, speech_body

RECORD = """speechID string, session int, nameOfHouse string, nameOfMeeting string, issue string, date string, speechOrder int,
speaker string, speakerGroup string, speakerPosition string, speech string, speechURL string"""
PAGE = f"numberOfRecords bigint, nextRecordPosition bigint, speechRecord array<struct<{', '.join(':'.join(x.split()) for x in RECORD.split(','))}>>"


def records(pages: DataFrame, *, json_col: str = "value") -> DataFrame:
    """The records of each page; a page that is no such JSON is refused."""
    page = F.from_json(json_col, PAGE, {"mode": "FAILFAST"})
    return pages.select(page.alias("p")).select(F.inline("p.speechRecord"))


def records_or_faults(pages: DataFrame, *, id_col: str, json_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """The records of the pages that can be read, each with its page's id, and the pages that can't (entity, detail): one bad page stops no other.

    A page is at fault if it is null or empty, is no such JSON or holds a value
    of another kind, or has no list of records though it does not say that
    there are none.
    """
    kind = f"{PAGE}, _unread string"
    page = F.from_json(json_col, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"})
    read = pages.select(F.col(id_col).alias("_page"), F.col(json_col).alias("_json"), page.alias("p"))
    fault = (
        F.when(F.trim(F.coalesce("_json", F.lit(""))) == "", "empty").when(F.col("p._unread").isNotNull() | F.col("p").isNull(), "unreadable")
        .when(F.col("p.speechRecord").isNull() & (F.coalesce("p.numberOfRecords", F.lit(-1)) != 0), "no list of records")
    )
    told = read.withColumn("_fault", fault)
    good = told.where("_fault IS NULL").select(F.col("_page").alias(id_col), F.inline("p.speechRecord"))
    return good, told.where("_fault IS NOT NULL").select(F.col("_page").alias("entity"), F.col("_fault").alias("detail"))


def unfinished(pages: DataFrame, *, json_col: str = "value") -> DataFrame:
    """Next positions that no landed page begins at: the crawl stopped early."""
    page = pages.select(F.from_json(json_col, PAGE).alias("p"), "start")
    return page.where("p.nextRecordPosition IS NOT NULL").select(F.col("p.nextRecordPosition").alias("next")).join(page.select(F.col("start").alias("next")), "next", "left_anti")


def speeches(found: DataFrame) -> DataFrame:
    """Speeches proper (order 0 is the meeting's own header), excerpted, with their length in code points."""
    return found.where("speechOrder <> 0").select(
        F.col("speechID").alias("id"), "session", F.when(F.col("nameOfHouse") == "参議院", "sangiin").otherwise("shugiin").alias("house"), F.col("nameOfMeeting").alias("meeting"), "date",
        F.col("speaker").alias("speaker_text"), F.nullif("speakerGroup", F.lit("")).alias("group"), F.nullif("speakerPosition", F.lit("")).alias("position"),
        excerpt(F.col("speech")).alias("excerpt"), F.length(speech_body(F.col("speech"))).alias("chars"), F.col("speechURL").alias("source_url"),
    )


def headers(found: DataFrame) -> DataFrame:
    """The header of each meeting and its lines."""
    head = found.where("speechOrder = 0")
    return head.select(F.col("speechID").alias("id"), "session", F.col("nameOfHouse").alias("house"), F.col("nameOfMeeting").alias("meeting"), "date", F.posexplode(F.split("speech", "\\r?\\n")).alias("line", "text"))


def _names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([^\\s\\u3000君]+(?:[\\s\\u3000][^\\s\\u3000君]+)?)君(?=[\\s\\u3000]|$)"), 1)


def attendees(header_lines: DataFrame) -> DataFrame:
    """Names on header lines with the role that stands before them, carried down to lines that give none."""
    from pyspark.sql import Window

    role = F.nullif(F.regexp_extract("text", "^[\\s\\u3000]*(委員長|理事|委員|会長|議長|副議長)[\\s\\u3000]", 1), F.lit(""))
    by = Window.partitionBy("id").orderBy("line")
    block = header_lines.withColumn("role", F.last(role, ignorenulls=True).over(by))
    bare = F.regexp_replace("text", "^[\\s\\u3000]*(委員長|理事|委員|会長|議長|副議長)?[\\s\\u3000]+", "")
    return block.where("role IS NOT NULL").select("id", "line", "role", F.explode(_names(bare)).alias("name_text"))


def bill_numbers(header_lines: DataFrame) -> DataFrame:
    """Numbers of the bills that a header names, written place by place in kanji; null where they are not."""
    found = header_lines.select("id", F.explode(F.regexp_extract_all("text", F.lit("第([〇一二三四五六七八九十百]+)号"), 1)).alias("written"))
    return found.select("id", "written", kanji_number(F.col("written")).alias("number"))
