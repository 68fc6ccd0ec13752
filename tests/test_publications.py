import itertools

import pytest
from pyspark.sql import functions as F

from rollbook.operators import agreement, carried, legends, loganalytics, publication, readapi, resolve
from rollbook.sources import minutes


def test_digests_tell_nulls_repeats_and_groups(spark):
    kind = "g string, a string, b string"
    base = [("x", "1", None), ("x", "1", None), (None, "2", "3"), ("y", "4", "4")]
    df = lambda rows: spark.createDataFrame(rows, kind).repartition(3)
    differ = lambda a, b: sorted((tuple(r) for r in agreement.differing_groups(df(a), df(b), by=["g"], columns=["a", "b"]).collect()), key=str)
    assert differ(base, list(reversed(base))) == [] == differ([], [])
    assert differ(base, base[1:]) == [("x", 2, 1)]
    assert differ(base, [base[0], ("x", None, "1"), *base[2:]]) == [("x", 2, 2)]
    assert differ(base, [*base[:2], base[3], ("z", "9", "9")]) == [("z", 0, 1), (None, 1, 0)]


def test_pages_of_a_document_agree(spark):
    rows = spark.createDataFrame([("a", 1, "m", 0), ("a", 1, "n", 1), ("a", 2, "n", 0), ("a", 2, "m", 1), ("b", 1, "m", 0), ("b", 2, "m", 0), ("b", 3, "o", 0), ("c", 1, None, 0)], "doc string, page int, name string, at int")
    assert [tuple(r) for r in agreement.differing_pages(rows, doc="doc", page="page", columns=["name"]).collect()] == [("b", 1, 3)]
    assert sorted(tuple(r) for r in agreement.differing_pages(rows, doc="doc", page="page", columns=["name", "at"]).collect()) == [("a", 1, 2), ("b", 1, 3)]


def test_legends(spark):
    lines = [("a", 0, "○：賛成×：反対議：議長（表決権：なし）"), ("b", 0, "「○」委員長宣告に起立（賛成）した者、「×」反対"), ("b", 1, "「●」〃に起立（賛成）しなかった者"), ("c", 0, "○：賛成"), ("c", 1, "○：反対"), ("d", 0, "凡例"), ("e", 0, "「○」賛成、「×」"), ("f", 0, "「●」〃起立"), ("g", 0, "")]
    df = spark.createDataFrame(lines, "doc string, at int, text string")
    items = F.when(F.col("text").startswith("「"), legends.quoted_items(F.col("text"))).otherwise(legends.colon_items(F.col("text")))
    pairs, refused = legends.legend(df, items)
    got = {(r.doc, r.key): r.meaning for r in pairs.collect()}
    assert got[("b", "●")] == "委員長宣告に起立（賛成）しなかった者" and got[("b", "×")] == "反対" and got[("a", "○")] == "賛成"
    assert {r.entity: r.detail for r in refused.collect()} == {"c": "twice ○", "d": "a line is no legend", "e": "no meaning of ×", "f": "nothing for the ditto mark of ●", "g": "a line is no legend"}
    assert "d" not in {r.entity for r in legends.legend(df, items, strict=False)[1].collect()}


def test_carried_rows_are_those_matched_anew(spark):
    kind = "member string, key string, since int, until int, grp string"
    before = [("m1", "k", 1, 3, "g"), ("m2", "k", 5, 6, "g"), ("m3", "l", 1, None, None), ("m4", "n", 1, 9, "g")]
    now = [("m1", "k", 1, 3, "g"), ("m2", "k", 5, 8, "g"), ("m5", "k", 7, 7, "h"), ("m4", "n", 1, 9, "g"), ("m6", "l", 4, 4, None)]
    records = spark.createDataFrame([(f"{k}{s}{g}", k, s, g) for k, s, g in itertools.product("klnq", range(0, 10), "gh")], "id string, key string, session int, grp string")
    how = dict(record="id", key="key", at="session", group="grp")
    a, b = (spark.createDataFrame(x, kind) for x in (before, now))
    last = resolve.resolve(records, a, **how)
    got = carried.match_again(last, a, b, **how)
    want = {tuple(r) for r in resolve.resolve(records, b, **how).collect()}
    assert {tuple(r)[:-1] for r in got.collect()} == want
    assert {r.id for r in got.where("state = 'again'").collect()} == {f"{k}{s}{g}" for k, s, g in itertools.product("kl", range(0, 10), "gh") if s >= {"k": 5, "l": 1}[k]}
    calls = lambda rows: spark.createDataFrame(rows, "call int, member string")
    lost = carried.lost_matches(calls([(1, "a"), (1, None), (2, "b")]), calls([(1, "c"), (2, None)]), call="call")
    assert [tuple(r) for r in lost.collect()] == [(2, 1, 0)]


def test_entries_of_members_in_office(spark):
    t = resolve.Terms(member="m", key="k", since="s", until="u", group=None, ends="e")
    roster = spark.createDataFrame([("a", "k", 1, 3, "2020-05-01"), ("b", "k", 2, None, "")], "m string, k string, s int, u int, e string")
    entries = spark.createDataFrame([(1, "a", 3, "2020-01-01"), (2, "a", 4, "2020-04-30"), (3, "a", 4, "2020-06-01"), (4, "b", 3, None), (5, None, 2, None), (6, "b", None, None), (7, "b", 2, None)], "id int, who string, at int, day string")
    held, lost = carried.in_office(entries, roster, member="who", at="at", date="day", t=t)
    assert {r.id for r in held.collect()} == {1, 2, 7} and {r.id for r in lost.collect()} == {3, 4, 5, 6}


def test_bad_pages_stop_no_other(spark):
    good = '{"numberOfRecords":1,"speechRecord":[{"speechID":"s","session":3,"speechOrder":0,"speech":"x"}]}'
    pages = [(1, good), (2, good[:-4]), (3, None), (4, "[]"), (5, '{"numberOfRecords":0}'), (6, '{"numberOfRecords":2}'), (7, good.replace("3", '"three"')), (8, "plain")]
    rows, faults = minutes.records_or_faults(spark.createDataFrame(pages, "page int, value string"), id_col="page")
    assert [(r.page, r.session) for r in rows.collect()] == [(1, 3)]
    assert {r.entity: r.detail for r in faults.collect()} == {2: "unreadable", 3: "empty", 4: "unreadable", 6: "no list of records", 7: "unreadable", 8: "unreadable"} or {r.entity for r in faults.collect()} >= {2, 3, 6, 7, 8}


def test_publication_is_one_commit(spark, tmp_path):
    path = str(tmp_path / "site")
    with pytest.raises(FileNotFoundError):
        publication.read(spark, path)
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "x")], "id int, session string")
    b = spark.createDataFrame([(1,)], "n int")
    first = publication.publish({"a": a, "b": b}, path, partitions={"a": "session"}, rows_a_file=1)
    assert sorted((r.id, r.session) for r in first.table("a").collect()) == [(1, "x"), (2, None), (3, "x")] and first.rows == {"a": 3, "b": 1}
    with pytest.raises(Exception, match="gone"):
        publication.publish({"a": a.limit(0)}, path, guards={"gone": a.limit(1)})
    assert publication.versions(spark, path) == [1]
    second = publication.publish({"a": a.limit(0), "b": b}, path)
    assert (second.version, publication.read(spark, path).table("a").count(), first.table("a").count(), publication.read(spark, path, 1).rows["a"]) == (2, 0, 3, 3)


def test_coverage_reads(spark):
    rows = spark.createDataFrame([("a", "https://x", "第5回国会 会議"), ("a", "http://y", "第3回国会"), ("a", None, "x第9回国会"), ("b", "ftp://z", None)], "g string, url string, name string")
    assert {tuple(r) for r in readapi.shown(rows, by=["g"], source="url").collect()} == {("a", 1, 2), ("b", 0, 1)}
    assert {tuple(r) for r in readapi.source_scope(rows, by=["g"], name="name", pattern="^第(\\d+)回国会").collect()} == {("a", 3, 5, 2), ("b", None, None, 0)}
    assert readapi.measured(readapi.shown(rows, by=["g"], source="url"), "shown").count() == 1


@pytest.mark.parametrize(("sent", "site"), [
    ("https://x.example/?q=a|b", "x.example"), ("https://x.example/?q=a b", "x.example"), ("https://x.example/%zz", "x.example"), ("https://own.example/a", "-"), ("http://own.example:80/a", "own.example:80"), ("https://u:p@x.example#f", "u:p@x.example"),
    ("android-app://com.x/y", "android-app://com.x"), ("HTTP://x.example/", "HTTP://x.example"), ("x.example/a", "x.example"), ("/local", "-"), ("https://", "-"), ("-", "-"), ("", "-"), ("a b?c", "a b"), ("1x://y/z", "1x:"),
])
def test_referrers_of_any_letters(spark, sent, site):
    assert spark.createDataFrame([(sent,)], "r string").select(loganalytics.referrer_host(F.col("r"), "own.example").alias("s")).first().s == site


def test_report_lines(spark):
    counts = spark.createDataFrame([("2026-08-22", "/a/", "-", 2), ("2026-08-22", "/a/", "x", 3), ("2026-08-22", "/b/", "-", 2)], "day string, page string, referrer string, pv long")
    days = spark.createDataFrame([("2026-08-22",), ("2026-08-23",)], "day string")
    assert [tuple(r) for r in loganalytics.report(counts, days).orderBy("day", "place").collect()] == [
        ("2026-08-22", 0, "# 2026-08-22\tpv=7\tpages=2\tper-page=3.50"), ("2026-08-22", 1, "2026-08-22\t/a/\tx\t3"), ("2026-08-22", 2, "2026-08-22\t/a/\t-\t2"), ("2026-08-22", 3, "2026-08-22\t/b/\t-\t2"),
        ("2026-08-23", 0, "# 2026-08-23\tpv=0\tpages=0\tper-page=0.00"),
    ]


def test_a_legend_is_told_within_its_document(spark):
    df = spark.createDataFrame([(1, 0, "○：賛成×：反対"), (1, 1, "●：〃成"), (2, 0, "○：甲○：乙"), (3, 0, "凡例")], "doc int, at int, text string")
    pairs, refused = legends.legend(df, legends.colon_items(F.col("text")))
    for found in (pairs, refused):
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {(r.entity, r.detail) for r in refused.collect()} >= {(2, "twice ○"), (3, "a line is no legend")}
