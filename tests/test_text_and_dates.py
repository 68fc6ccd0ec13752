import pytest
from pyspark.sql import functions as F

from rollbook.functions import dates, text
from rollbook.operators import records

TABLE = [
    (text.name_key, "髙橋　 はるみ", "高橋はるみ"), (text.name_key, "﨑山 德", "崎山徳"), (text.name_key, "ＡＢ Ｃ", "ABC"), (text.name_key, None, None),
    (text.local_name_key, "𠮷田\U000e0100 一", "吉田一"), (text.search_key, "アベ ｼﾝ", "あべしん"),
    (text.bill_title, "日程第９　何々法案（内閣提出、衆議院送付）", "何々法案"), (text.bill_title, "何々（第一号）", "何々（第一号）"),
    (text.squash, "　a \n b ", "a b"), (text.excerpt, "○議長（山田君）　本文\n は", "本文 は"), (text.committee_name, "予算委員会 第3号", "予算委員会"),
    (text.mark_key, "〇✕", "○×"), (text.radicals_folded, "⾧野", "長野"),
    (text.kana_row, "ガクト", "か"), (text.kana_row, "ゃま", "や"), (text.kana_row, "x", "その他"), (text.kana_row, "", "その他"),
    (text.zip_code, "〒１００－０００１", "1000001"), (text.zip_code, " 100 − 0001 ", "1000001"), (text.zip_code, "100000a", None), (text.zip_code, "", None),
    (text.plain_prefecture, "北海道", "北海道"), (text.plain_prefecture, "京都府", "京都"), (text.place_key, "青ヶ島", "青ケ島"), (text.without_county, "西多摩郡奥多摩町", "奥多摩町"),
    (dates.era_to_iso, "令和元年5月1日", "2019-05-01"), (dates.era_to_iso, "（平成 31年 4月30日）", "2019-04-30"), (dates.era_to_iso, "明治1年1月1日", None),
    (dates.written_to_iso, "2024年 1月9日", "2024-01-09"), (dates.log_day, "22/Aug/2026:23:59:59 +0900", "2026-08-22"), (dates.log_day, "22/Foo/2026", None),
]


@pytest.mark.parametrize("n", range(0, len(TABLE), 8))
def test_texts(spark, n):
    part = TABLE[n : n + 8]
    df = spark.createDataFrame([tuple(x for _, x, _ in part)], ", ".join(f"c{i} string" for i in range(len(part))))
    got = df.select(*[f(F.col(f"c{i}")).alias(f"r{i}") for i, (f, _, _) in enumerate(part)]).first()
    assert list(got) == [want for _, _, want in part]


def test_lists_and_numbers(spark):
    row = spark.createDataFrame([("打越さく良君 外9名 山田 太郎君", "落合貴之君; 中野洋昌君\n", "緒方 林太郎君、外二名", "甲、乙（丙、丁（戊、己））、、庚", "二〇三", "十二", "12", "1a")], "a string, b string, c string, d string, e string, f string, g string, h string")
    got = row.select(
        text.proposers(F.col("a")), text.name_list(F.col("b")), text.submitters(F.col("c")), text.top_level_parts(F.col("d")),
        dates.kanji_number(F.col("e")), dates.kanji_number(F.col("f")), dates.strict_int(F.col("g")), dates.strict_int(F.col("h")),
        dates.year_of(F.lit(1), F.lit(2025), F.lit(7)), dates.year_of(F.lit(1), F.lit(2025), F.lit(7), strict=True),
        text.long_reading(F.lit("山田"), F.lit("")), text.long_reading(F.lit(""), F.lit("や")), text.long_reading(F.lit("山 田"), F.lit("やまだたろう")), text.long_reading(F.lit("山田"), F.lit("やまだたろうじ　ろう")),
        text.session_of(F.lit(None).cast("int"), F.lit("221-3")), text.session_of(F.lit(None).cast("int"), F.lit("x-3")),
    ).first()
    assert list(got) == [["打越さく良", "山田", "太郎"], ["落合貴之", "中野洋昌"], ["緒方 林太郎", "外二名"], ["甲", "乙（丙、丁（戊、己））", "庚"], 203, None, 12, None, 2026, 2025, False, True, False, True, 221, None]


def test_japanese_order(spark):
    names = ["ア", "が", "か", "カ", "は", "ば", "Z", "亜", "きや", "きゃ", "あい", "アイ"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, kana string").repartition(3)
    got = {r.kana: (r.row, r["head"], r.place) for r in records.kana_groups(df, kana="kana", tie="id").collect()}
    assert got["アイ"] == ("あ", "あい", 2) and got["あい"] == ("あ", "あい", 1) and got["か"] == ("か", "か", 1) and got["カ"] == ("か", "か", 2) and got["が"] == ("か", "が", 1) and got["亜"][0] == "その他"
    assert [r.kana for r in records.in_kana_order(df, kana="kana", tie="id").collect()] == ["ア", "あい", "アイ", "か", "カ", "が", "きゃ", "きや", "は", "ば", "Z", "亜"]
    assert records.kana_groups(df.limit(0), kana="kana", tie="id").count() == 0
