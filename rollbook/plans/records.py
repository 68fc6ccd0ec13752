"""Ids, legends, eras, roll-ups and small set questions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators import records
from rollbook.session import table

ERAS = [("1995-01-01", "1997-07-01", "PROMO"), ("1995-01-01", "1997-07-01", "SMALL"), ("1997-07-01", "2000-01-01", "PROMO"), ("2000-01-01", None, "LARGE")]


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.lpad(F.col("c_custkey").cast("string"), 7, "1")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", records.profile_id("m_", F.when(F.col("c_custkey") % 5 == 0, F.concat(padded, F.lit("x"))).otherwise(padded)).alias("profile"), records.hashed_id("h_", F.col("c_name"), F.col("c_mktsegment")).alias("hashed"),
        records.capped_id(F.concat(F.lit("議員の表決"), F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.lit("の記録である")).otherwise("")), 40).alias("capped"),
    )


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    tally = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("yes"), F.count_if(F.col("l_returnflag") == "R").alias("no"))
    both = tally.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    decision = F.when(F.col("o_orderstatus") == "F", "可決").when(F.col("o_orderstatus") == "P", "")
    return both.select("o_orderkey", records.result_text(decision, F.col("yes"), F.col("no")).alias("result"))


def _unlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("year(o_orderdate) AS yr", "o_orderpriority AS grp")
    return records.unlisted(rows, rows.where("yr < 2000 OR grp < '3'"), ["yr", "grp"])


def _eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    eras = spark.createDataFrame(ERAS, "since string, until string, kind string")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "p_type")
    found = records.in_era(rows, eras, date="day", name="p_type", era_name="kind", since="since", until="until")
    return found.groupBy("p_type", "known").agg(F.count("*").alias("lines"), F.min("day").alias("first_day"))


def _legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    legend = spark.createDataFrame([("A", "賛成"), ("R", "反対")], "l_returnflag string, mapped string")
    return records.mapped(table(spark, sf_dir, "lineitem"), legend, mark="l_returnflag").groupBy("l_returnflag", "mapped").agg(F.count("*").alias("votes"))


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "l_linestatus", "lpad(CAST(l_orderkey AS string), 8, '0') AS call")
    return records.unmatched_rollup(rows, ["l_suppkey", "l_linestatus"], "call")


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(~F.col("url").contains("/en/"), "not-a-session").when(F.col("url").contains("?"), "not-a-candidate").when(~F.col("html").contains("<a "), "no-vote-link")
    return records.reasons(table(spark, sf_dir, "pages").withColumn("site", F.regexp_extract("url", "^([a-z]+)://", 1)), ["site"], reason)


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_nationkey", "if(c_custkey % 3 = 0, NULL, c_custkey) AS votes", "CAST(NULL AS bigint) AS bills")
    return records.linked_sums(rows, ["c_nationkey"], ["votes", "bills"])


def _greatest(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg((F.count("*") / 40).cast("int").alias("names"))
    return records.greatest_by(counts, ["o_orderstatus"], "month", ["names", "month"])


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest stage of each user's day; of one second, the later event."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "date_format(ts, 'yyyy-MM-dd') AS day", "event_type", "event_id")
    return records.greatest_by(rows, ["user_id"], "event_type", ["day", "event_id"])


def _last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_mktsegment AS v")
    newer = table(spark, sf_dir, "events").selectExpr("user_id AS k", "event_type AS v", "event_id AS place")
    return records.last_wins(kept, newer, "k", "place")


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return records.differences(events.where("day(ts) <= 15").select("user_id", "event_type"), events.where("day(ts) > 15").select("user_id", "event_type"))


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "date_format(o_orderdate, 'yyyy-MM') AS month")
    return records.newest(rows, "month", 3)


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(4).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def _natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    return brands.select("p_brand", F.row_number().over(Window.orderBy(*records.natural_key(F.col("p_brand")))).alias("place"))


def _reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "customer").where("c_custkey > 0").selectExpr("c_custkey DIV 3 AS src", "c_custkey AS dst")
    return records.reachable(links, spark.createDataFrame([(7,), (21,)], "page bigint"), src="src", dst="dst")


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.ordered_names(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_name")


def _parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").withColumn("site", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    return records.first_by_parameter(rows, url="url", parameter="page", by=["site"], order="page_id")


QUERIES = {
    "member_ids": (_ids, """WITH l AS (SELECT *, '議員の表決' || c_name || CASE WHEN c_custkey % 2 = 0 THEN 'の記録である' ELSE '' END AS long FROM customer)
      SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'm_' || right(lpad(CAST(c_custkey AS varchar), 7, '1'), 6) END AS profile, 'h_' || substr(sha1(c_name || chr(9) || c_mktsegment), 1, 10) AS hashed,
        CASE WHEN strlen(long) <= 40 THEN long ELSE substr(long, 1, 20) || '-h' || substr(sha256(long), 1, 8) END AS capped FROM l"""),
    "result_text": (_results, """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '可決（賛成 ' || count(*) FILTER (l_returnflag = 'A') || '・反対 ' || count(*) FILTER (l_returnflag = 'R') || '）'
      ELSE '賛成 ' || count(*) FILTER (l_returnflag = 'A') || '・反対 ' || count(*) FILTER (l_returnflag = 'R') END AS result FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus"""),
    "unlisted_groups": (_unlisted, "SELECT DISTINCT year(o_orderdate) AS yr, o_orderpriority AS grp FROM orders WHERE NOT (year(o_orderdate) < 2000 OR o_orderpriority < '3')"),
    "era_list": (_eras, """WITH e(since, until, kind) AS (VALUES ('1995-01-01', '1997-07-01', 'PROMO'), ('1995-01-01', '1997-07-01', 'SMALL'), ('1997-07-01', '2000-01-01', 'PROMO'), ('2000-01-01', NULL, 'LARGE')),
      r AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
      k AS (SELECT day, p_type, CASE WHEN day >= '1995-01-01' THEN EXISTS (SELECT 1 FROM e WHERE since <= day AND (until IS NULL OR day < until) AND kind = p_type) END AS known FROM r)
      SELECT p_type, known, count(*) AS lines, min(day) AS first_day FROM k GROUP BY ALL"""),
    "legend_map": (_legend, "SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN '賛成' WHEN 'R' THEN '反対' END AS mapped, count(*) AS votes FROM lineitem GROUP BY ALL"),
    "unmatched_rollup": (_rollup, """WITH r AS (SELECT l_suppkey, l_linestatus, lpad(CAST(l_orderkey AS varchar), 8, '0') AS call FROM lineitem )
      SELECT l_suppkey, l_linestatus, count(*) AS records, string_agg(DISTINCT call, ',' ORDER BY call) AS record_ids FROM r GROUP BY ALL"""),
    "drop_reasons": (_reasons, """SELECT split_part(url, '://', 1) AS site, CASE WHEN NOT contains(url, '/en/') THEN 'not-a-session' WHEN contains(url, '?') THEN 'not-a-candidate' WHEN NOT contains(html, '<a ') THEN 'no-vote-link' ELSE 'taken' END AS reason,
      count(*) AS candidates FROM pages GROUP BY ALL"""),
    "linked_counts": (_linked, "SELECT c_nationkey, CAST(sum(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey END) AS bigint) AS votes, CAST(0 AS bigint) AS bills FROM customer GROUP BY 1"),
    "greatest_session": (_greatest, """WITH c AS (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month, count(*) // 40 AS names FROM orders GROUP BY ALL)
      SELECT o_orderstatus, arg_max(month, (names, month)) AS month, max(names) AS names FROM c GROUP BY 1"""),
    "latest_stage": (_stages, "SELECT user_id, arg_max(event_type, (CAST(ts AS date), event_id)) AS event_type, strftime(max(ts), '%Y-%m-%d') AS day FROM events GROUP BY 1"),
    "last_wins_index": (_last_wins, "SELECT k, v FROM (SELECT user_id AS k, arg_max(event_type, event_id) AS v FROM events GROUP BY 1) UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)"),
    "multiset_differences": (_differences, """WITH c AS (SELECT user_id, event_type, count(*) FILTER (day(ts) <= 15) - count(*) FILTER (day(ts) > 15) AS d FROM events GROUP BY ALL)
      SELECT user_id, event_type, CASE WHEN d > 0 THEN 'left' ELSE 'right' END AS side FROM (SELECT *, unnest(range(abs(d))) FROM c)"""),
    "newest_sessions": (_newest, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders ORDER BY m DESC LIMIT 3)"),
    "recent_calls": (_recent, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 4"),
    "natural_order": (_natural, "SELECT p_brand, row_number() OVER (ORDER BY regexp_replace(p_brand, '[0-9]+$', ''), CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS integer)) AS place FROM (SELECT DISTINCT p_brand FROM part)"),
    "crawl_reach": (_reach, """WITH RECURSIVE walk(page, steps) AS (SELECT unnest([7, 21]), 0 UNION ALL SELECT c_custkey, steps + 1 FROM walk JOIN customer ON c_custkey // 3 = page AND c_custkey > 0)
      SELECT page, min(steps) AS steps FROM walk GROUP BY 1"""),
    "ordered_names": (_ordered, "SELECT n_regionkey, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1"),
    "source_parameter": (_parameter, """SELECT split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) AS site, arg_min(regexp_extract(url, '[?&]page=([^&#]*)', 1), page_id) AS value, min(page_id) AS page_id
      FROM pages WHERE regexp_extract(url, '[?&]page=([^&#]*)', 1) <> '' GROUP BY 1"""),
}
