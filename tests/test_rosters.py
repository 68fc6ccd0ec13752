from pyspark.sql import functions as F

from rollbook.operators import districts, terms
from rollbook.sources import rosters

W = "　"


def lines(spark, texts):
    rows = [(i, house, n, line) for i, house, text in texts for n, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "id string, house string, line int, text string").repartition(3)


LOWER = f"""会議録
{W}出席委員
{W}{W}委員長　安住　　淳君　{W}
{W}{W}理事　黄川田仁志君　理事　國場幸之助君
{W}{W}理事おおつき紅葉君{W}{W}{W}畑野　君枝君
{W}{W}{W}…………………………
{W}外務大臣　外　君"""
UPPER = f"""前　君
{W}{W}{W}出席者は左のとおり。
{W}{W}{W}{W}委員長{W}{W}{W}{W}{W}和田　政宗君
{W}{W}{W}{W}理　事
{W * 15}甲　一君
{W * 16}乙　二君
{W * 7}低　君
{W * 4}────
{W * 15}続　君
{W * 7}議長　外　君
{W * 4}委　員
{W * 15}丙　三君
{W * 3}国務大臣
{W * 15}大　臣君
{W * 4}会　長　{W}四　君
{W * 15}後　君
{W * 2}本日の会議に付した案件
{W * 15}外　君"""


def test_rosters_of_both_houses(spark):
    found = rosters.rosters(lines(spark, [("a", "衆議院", LOWER), ("b", "参議院", UPPER), ("c", "衆議院", "x\n\n"), ("d", "参議院", ""), ("e", "衆議院", f"{W}出席小委員\n{W}{W}理事君")]))
    got = sorted((r.id, r.line, r.pos, r.role, r.name) for r in found.collect())
    assert [g[3:] for g in got if g[0] == "a"] == [("委員長", "安住淳"), ("理事", "黄川田仁志"), ("理事", "國場幸之助"), ("理事", "おおつき紅葉"), ("委員", "畑野君枝")]
    assert [g[3:] for g in got if g[0] == "b"] == [("委員長", "和田政宗"), ("理事", "甲一"), ("理事", "乙二"), ("理事", "続"), ("委員", "丙三"), ("会長", "四")]
    assert {g[0] for g in got} == {"a", "b", "e"}
    assert [tuple(r) for r in rosters.misread(found).collect()] == [("e", "no name in line 1")]


def test_proposers_and_bills(spark):
    head = f"{W * 7}発議者{W}前　君\n{W * 3}出席者は左のとおり。\n{W * 7}発議者{W * 3}舟山　康江君\n{W * 3}衆議院議員\n{W * 7}発議者{W * 3}衆　君\n{W * 3}委員以外の議員\n{W * 7}発議者{W * 3}外　君\n{W * 2}本日の会議に付した案件\n○種子法案（参第一一号）（継続）\n○閣法案（閣法第二号）"
    people, bills = rosters.proposers_and_bills(lines(spark, [("a", "", head), ("b", "", head.replace("○種子法案（参第一一号）（継続）\n", "")), ("c", "", "")]))
    assert sorted((r.id, r.name) for r in people.collect()) == [("a", "外"), ("a", "舟山康江")]
    assert [(r.id, r.number, r.title) for r in bills.collect()] == [("a", 11, "種子法案")]


def test_district_texts(spark):
    texts = {
        "甲県": "甲県\n第１区\n 一市、二市（第2区に属し（ない）、区域）\n第2区 三郡(四町、五村)、六市", "乙県": "丙県 第1区 一市", "丁県": "丁県第1区一市（", "戊県": "戊県第1区一市第3区二市", "己県": "己県", "庚県": "庚県第1区第2区一市",
        "辛県": "辛県第1区（のみ）", "壬県": "壬県第1区一市（a）b",
    }
    df = spark.createDataFrame(list(texts.items()), "pref string, text string").repartition(2)
    units, refused = districts.district_sections(df)
    assert sorted((r.pref, r.number, r.place, r.unit, r.area) for r in units.collect()) == [("甲県", 1, 1, "一市", None), ("甲県", 1, 2, "二市", "第2区に属し（ない）、区域"), ("甲県", 2, 1, "三郡", "四町、五村"), ("甲県", 2, 2, "六市", None)]
    assert {r.entity: r.detail for r in refused.collect()} == {"乙県": "headed otherwise", "丁県": "brackets left open", "戊県": "numbers not consecutive", "己県": "no district", "庚県": "district without area", "辛県": "unit unreadable", "壬県": "unit unreadable"}
    assert districts.district_sections(df.limit(0))[0].count() == 0


def test_terms_that_end_before_they_begin_cover_nothing(spark):
    t = spark.createDataFrame([(5, 3), (7, None), (1, 2)], "since int, until int")
    assert sorted(r.session for r in terms.covered_sessions(t, since="since", until="until").collect()) == [1, 2, 7]
    assert terms.covered_sessions(t.where(F.lit(False)), since="since", until="until").count() == 0


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_texts_are_cut_where_they_are(spark):
    texts = spark.createDataFrame([("県", "県第１区甲（乙、第１区）、丙第２区丁"), ("府", "府第１区"), ("道", "道（第１区甲"), ("都", None)], "pref string, text string")
    units, refused = districts.district_sections(texts)
    assert exchanges(units) == exchanges(refused) == 0
    assert [(r.number, r.place, r.unit, r.area) for r in units.orderBy("number", "place").collect()] == [(1, 1, "甲", "乙、第１区"), (1, 2, "丙", None), (2, 1, "丁", None)]
    assert {(r.entity, r.detail) for r in refused.collect()} == {("府", "district without area"), ("道", "brackets left open"), ("都", "headed otherwise")}


def test_people_and_bills_come_from_one_shuffle(spark):
    rows = spark.createDataFrame([("a", 1, "出席者は左のとおり"), ("a", 2, "　発議者　甲　君"), ("a", 3, "委員"), ("a", 4, "　　本日の会議に付した案件"), ("a", 5, "○案（参第二号）")], "id string, line int, text string")
    both = rosters.agendas(rows)
    assert exchanges(both) <= 1
    assert [(r.id, [p.name for p in r.people], [(b.number, b.title) for b in r.bills]) for r in both.collect()] == [("a", ["甲"], [(2, "案")])]
