import gzip
import json

import pytest
from pyspark.sql import functions as F

from rollbook.operators import loganalytics
from rollbook.sources import files, minutes, pages, sinks
from rollbook.streaming import pageviews


def logged(path, *, day="22/Aug/2026", method="GET", status=200, referrer="-"):
    return f'- - [{day}:10:00:00 +0900] "{method} {path} HTTP/2.0" {status} 512 "{referrer}"'


def test_access_log(spark, tmp_path):
    lines = [
        logged("/members"), logged("/members/?q=1", referrer="https://own.example/x"), logged("/", referrer="https://other.example/a?b"), logged("/", referrer="android-app://com.app/x"), logged("/", status=304),
        logged("/x", method="POST"), logged("/x", status=404), logged("/assets/a"), logged("/data/b"), logged("/favicon.ico"), logged("/y", day="21/Aug/2026"), "garbage",
    ]
    (tmp_path / "a.log").write_text("\n".join(lines[:6]))
    with gzip.open(tmp_path / "a.log.2.gz", "wt") as f:
        f.write("\n".join(lines[6:]))
    views = loganalytics.visits(files.log_lines(spark, [str(tmp_path / "a.log"), str(tmp_path / "a.log.2.gz")]), own="own.example")
    counts = loganalytics.page_views(views)
    assert {tuple(r) for r in counts.collect()} == {
        ("2026-08-22", "/members/", "-", 2), ("2026-08-22", "/", "other.example", 1), ("2026-08-22", "/", "android-app://com.app", 1), ("2026-08-22", "/", "-", 1), ("2026-08-21", "/y/", "-", 1),
    }
    days = spark.createDataFrame([("2026-08-22",), ("2026-08-23",)], "day string")
    assert {tuple(r) for r in loganalytics.summary(counts, days).collect()} == {("2026-08-22", 5, 2, 2.5), ("2026-08-23", 0, 0, 0.0)}
    loganalytics.write_report(counts, str(tmp_path / "tsv"))
    assert spark.read.options(sep="\t", header=True).csv(str(tmp_path / "tsv")).columns == ["day", "page", "referrer", "pv"]
    assert spark.read.options(sep="\t", header=True).csv(str(tmp_path / "tsv")).count() == 5
    with pytest.raises(FileNotFoundError):
        files.log_lines(spark, [])


def test_pages(spark):
    html = "<title>A &amp; B</title><table><tr><th>件名<td>予算<br>案</tr><tr><td>年<td>令和</table><a href='/x?a=1&amp;b=2'>go</a><script>var a='<td>no</td>'</script>"
    docs = spark.createDataFrame([(1, html), (2, None), (3, "<td>loose"), (4, "<p>no part")], "id int, html string")
    parts = pages.page_parts(docs, id_col="id", html_col="html")
    got = {(r.kind, r.text, r.href) for r in parts.where("id = 1").collect()}
    assert {("title", "A & B", None), ("link", "go", "/x?a=1&b=2")} <= got
    assert {("cell", "件名", None), ("cell", "予算 案", None), ("cell", "年", None), ("cell", "令和", None)} <= got
    assert [(r.kind, r.text) for r in parts.where("id = 3").collect()] == [("cell", "loose")]  # left open, and a cell all the same
    assert {r.entity for r in pages.require_rows(parts, docs, id_col="id").collect()} == {2, 4}
    closed = spark.createDataFrame([(1, "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>")], "id int, html string")
    cells = pages.page_parts(closed, id_col="id", html_col="html")
    assert {(r.label, r.value) for r in pages.labelled_values(cells).collect()} == {("a", "b"), ("c", "d")}
    rows = pages.table_rows(cells, ["x", "y"])
    assert {(r.x, r.y) for r in rows.collect()} == {("a", "b"), ("c", "d")}
    assert [(r.x, r.below) for r in pages.paired_rows(rows, "y", "below").collect()] == [("a", "d")]


def test_minutes(spark):
    record = {"speechID": "s0", "session": 221, "nameOfHouse": "参議院", "nameOfMeeting": "本会議", "date": "2026-01-01", "speechOrder": 0, "speech": "出席者\r\n　委員長　　山田 太郎君\r\n　　　　　　鈴木一郎君　佐藤二郎君\r\n参第一一号、第十号"}
    talk = record | {"speechID": "s1", "speechOrder": 1, "speaker": "山田", "speakerGroup": "", "speech": "○山田太郎君　本文\n です" + "あ" * 300}
    landed = spark.createDataFrame([(1, json.dumps({"numberOfRecords": 2, "nextRecordPosition": 3, "speechRecord": [record, talk]}))], "start long, value string")
    found = minutes.records(landed)
    speech = minutes.speeches(found).collect()
    assert [(r.id, r.house, r.group, r.chars, len(r.excerpt)) for r in speech] == [("s1", "sangiin", None, 305, 200)] and speech[0].excerpt.startswith("本文 です")
    lines = minutes.headers(found)
    assert {(r.role, r.name_text) for r in minutes.attendees(lines).collect()} == {("委員長", "山田 太郎"), ("委員長", "鈴木一郎"), ("委員長", "佐藤二郎")}
    assert {(r.written, r.number) for r in minutes.bill_numbers(lines).collect()} == {("一一", 11), ("十", None)}
    assert [r.next for r in minutes.unfinished(landed).collect()] == [3]
    with pytest.raises(Exception, match="(?i)malformed"):
        minutes.records(spark.createDataFrame([("{",)], "value string")).collect()


def test_files_and_sinks(spark, tmp_path):
    row = '13101,"100  ","1000001","ﾄｳｷﾖｳﾄ","ﾁﾖﾀﾞｸ","ﾁﾖﾀﾞ","東京都","千代田区","千代田",0,0,0,0,0,0\n'
    (tmp_path / "ken.csv").write_bytes(row.encode("shift_jis"))
    assert [tuple(r) for r in files.postal_codes(spark, str(tmp_path / "ken.csv")).collect()] == [("13101", "1000001", "東京都", "千代田区", "千代田")]
    robots = "Disallow: /z\nUser-agent: other\nDisallow: /a\n\nUser-agent: *\nUser-agent: x # c\nDisallow: /b*.pdf\nDisallow: /c$\nDisallow:\nDisallow: /100%"
    rules = files.robots_rules(spark.createDataFrame([("h", i, x) for i, x in enumerate(robots.split("\n"))], "site string, at int, value string"))
    assert {tuple(r)[1:] for r in rules.collect()} == {("other", "/a"), *((a, r) for a in ("*", "x") for r in ("/b*.pdf", "/c$", "/100%"))}
    urls = spark.createDataFrame([(i, "h", u) for i, u in enumerate(["https://h/a", "https://h/b1.pdf", "https://h/c", "https://h/cd", "nothing", None, "https://h/100", "https://h/100%x"])] + [(8, "other", "https://other/c")], "i int, site string, url string")
    assert [r.allowed for r in files.allowed(urls, rules, "me").orderBy("i").collect()] == [True, False, False, True, False, False, True, False, True]
    assert not files.allowed(urls, rules, "Other/2.0").where("i = 0").first().allowed
    nested = spark.createDataFrame([(1, (2, None))], "b int, a struct<d:int,c:int>")
    assert sinks.stable_json(nested, "b").first().json == '{"a":{"d":2},"b":1}'
    sinks.write_shards(spark.createDataFrame([("1000001", 1), ("9999999", 2)], "zip string, n int"), str(tmp_path / "shards"), "zip")
    assert (tmp_path / "shards" / "shard=100").exists()
    assert {r.url for r in sinks.urls({"/members": spark.createDataFrame([("m 1",)], "id string")}, "https://h").collect()} == {"https://h/members/m+1/"}


def test_streamed_counts_equal_the_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    rows.unionAll(rows.limit(50)).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = pageviews.windowed_counts(stream, ts="ts", key="event_type", id_col="event_id", late="60 days").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start.isoformat()[:10], r.event_type): r.n for r in spark.sql("SELECT * FROM counts").collect()}
    want = {(r.d, r.event_type): r["count"] for r in rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d"), "event_type").count().collect()}
    assert got == want


def test_a_page_of_the_engine_is_made_without_a_shuffle_of_texts(spark):
    from rollbook.plans import rollcalls

    plan = rollcalls._cells(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Window" not in plan
