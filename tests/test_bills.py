import pytest
from pyspark.sql import functions as F

from rollbook.functions import bills
from rollbook.operators import districts, readapi, records


def one(spark, f, *values):
    columns = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{c} string" for c in columns)).select(f(*[F.col(c) for c in columns]).alias("o")).first().o


@pytest.mark.parametrize(("category", "kind"), [("法律案（内閣提出）", "閣法"), ("法律案（参法）", "参法"), ("法律案（衆法）（内閣提出）", "衆法"), ("予算（第一号）", "予算"), ("条約の承認", "条約"), ("人事案件", "その他"), ("（）承認", "承認"), ("", "その他")])
def test_bill_kinds(spark, category, kind):
    assert one(spark, bills.bill_kind, category) == kind


def test_known_kinds_and_results(spark):
    assert [one(spark, bills.known_kind, k) for k in ("閣法", "決議", "ＮＨＫ決算", "")] == ["閣法", "決議", "その他", "その他"]
    parts = lambda s: tuple(one(spark, bills.result_parts, s))
    assert [parts(s) for s in ("可決（賛成 12・反対 3）", "賛成 1・反対 0", "可決", "修正（甲）（賛成 0・反対 9）", "", "可決（賛成 1・反対 2）。")] == [("可決", 12, 3), (None, 1, 0), (None, None, None), ("修正（甲）", 0, 9), (None, None, None), (None, None, None)]
    made = spark.createDataFrame([(d, y, n) for d in ("可決", None) for y in (0, 7) for n in (3,)], "d string, y int, n int")
    assert all((r.p.decision, r.p.yes, r.p.no) == (r.d, r.y, r.n) for r in made.select("*", bills.result_parts(records.result_text(F.col("d"), F.col("y"), F.col("n"))).alias("p")).collect())


def test_broken_letters_and_reasons(spark):
    broken = lambda s: list(one(spark, bills.broken_letters, s))
    assert [broken(s) for s in ("青木　一彦", "□村 □子x", "髙﨑\U000e0100 々ーヶ・", "", "𠮷田", "〓")] == [[], ["□", "x"], [], [], [], ["〓"]]
    df = spark.createDataFrame([("□", True), ("甲", True), ("甲", False), ("甲", None)], "n string, c boolean")
    assert [r.r for r in df.select(bills.unmatched_reason(F.col("n"), F.col("c")).alias("r")).collect()] == ["brokenGlyph", "sourceConflict", None, None]


@pytest.mark.parametrize(("cell", "name", "legal"), [("山田　太郎\n[ 鈴木　太郎 ]", "山田 太郎", "鈴木 太郎"), ("蓮舫\n［村田］", "蓮舫", "村田"), ("甲\n乙", "甲", None), ("甲", "甲", None), ("甲\n[]", "甲", None), ("", "", None), ("甲\n[乙\n丙]", "甲", "乙 丙")])
def test_name_cells(spark, cell, name, legal):
    got = one(spark, bills.name_and_legal, cell)
    assert (got.name, got.legal) == (name, legal)


@pytest.mark.parametrize(("text", "date", "raw"), [("（令和８年９月１７日発足）", "2026-09-17", "令和８年９月１７日発足"), ("平成元年 1月 8日", "1989-01-08", "平成元年 1月 8日"), ("昭和63年1月1日", None, None), ("", None, None), ("㍻ 令和2年3月4日", "2020-03-04", "令和2年3月4日")])
def test_effective_dates(spark, text, date, raw):
    got = one(spark, bills.effective_date, text)
    assert (got.date, got.text) == (date, raw)


def test_committee_bills_and_district_counts(spark):
    df = spark.createDataFrame([(1, "参法", []), (2, "参法", ["甲"]), (3, "閣法", []), (4, "参法", None)], "id int, kind string, who array<string>")
    assert {r.id for r in readapi.committee_bills(df, kind="kind", proposers="who", own="参法").collect()} == {1, 4}
    postal = spark.createDataFrame([("1", 1), ("1", 2), ("2", 3)], "zip string, code int")
    resolved = spark.createDataFrame([(1, "甲県", [1, 2], True), (2, "甲県", [2], False), (3, "乙県", None, False)], "code int, pref string, numbers array<int>, split boolean")
    assert districts.districts_meta(postal, resolved).first().asDict() == {"zips": 2, "municipalities": 3, "split_municipalities": 1, "districts": 2}
