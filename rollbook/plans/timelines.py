"""Timelines of customers: orders, the lines under them, and events of the user of the same number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators import incremental, ordering, resolve, timeline
from rollbook.session import table

KINDS = ("order", "line", "event")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return timeline.union_kinds({
        "order": orders.selectExpr("o_custkey AS member", "CAST(o_orderdate AS date) AS day", "concat('o', o_orderkey) AS entry", "o_orderstatus AS value"),
        "line": lines.selectExpr("o_custkey AS member", "CAST(l_shipdate AS date) AS day", "concat('l', l_orderkey, '-', l_linenumber) AS entry", "l_returnflag AS mark"),
        "event": table(spark, sf_dir, "events").selectExpr("user_id AS member", "CAST(ts AS date) AS day", "concat('e', event_id) AS entry", "event_type AS value"),
    })


ENTRIES = """
entries AS (SELECT 'order' AS kind, o_custkey AS member, CAST(o_orderdate AS date) AS day, 'o' || o_orderkey AS entry, o_orderstatus AS value, NULL AS mark FROM orders
  UNION ALL SELECT 'line', o_custkey, CAST(l_shipdate AS date), 'l' || l_orderkey || '-' || l_linenumber, NULL, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'event', user_id, CAST(ts AS date), 'e' || event_id, event_type, NULL FROM events)
"""


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir).withColumn("rank", timeline.kind_rank(KINDS))
    return timeline.in_order(rows, KINDS, date="day", entry="entry").select("member", "kind", F.date_format("day", "yyyy-MM-dd").alias("day"), "entry", "value", "mark", "rank")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.counts_by_member(table(spark, sf_dir, "customer"), entries(spark, sf_dir), KINDS, member="c_custkey", of="member")


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "dayofmonth(ts) AS day", "event_type", "ts", "event_id")
    return timeline.fold_roles(rows, ["user_id", "day", "event_type"], order=["ts", "event_id"], carry=["event_id"])


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    found = timeline.latest_where(rows, ["user_id"], {"value": F.col("value") > 5, "event_type": F.col("event_type") != "error"}, order=["ts", "event_id"])
    return found.select("user_id", F.round("value", 4).alias("value"), "event_type")


def _stance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bill for each year and region: nations with more finished than open orders declare yes, those with fewer no."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    tally = orders.groupBy(F.year("o_orderdate").alias("sess"), F.col("c_nationkey").alias("nation")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    tally = tally.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("nation") == F.col("n_nationkey"))
    side = F.col("nation").cast("string")
    bills = tally.groupBy("sess", "n_regionkey").agg(F.collect_list(F.when(F.col("f") > F.col("o"), side)).alias("yes"), F.collect_list(F.when(F.col("f") < F.col("o"), side)).alias("no"))
    bills = bills.select(F.concat_ws("-", "sess", "n_regionkey").alias("bill"), "sess", "yes", "no")
    members = table(spark, sf_dir, "customer").selectExpr("c_custkey AS member", "CAST(c_nationkey AS string) AS grp", "1993 + c_custkey % 5 AS since", "1996 + c_custkey % 5 AS until")
    return timeline.stance(bills, members, bill="bill", at="sess", yes="yes", no="no", member="member", group="grp", since="since", until="until")


def _unanimous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's status if all its lines agree, else that of its customer's lines, if these do; and a part's mark likewise, else that of its brand and size."""
    lines = table(spark, sf_dir, "lineitem")

    def decided(kind: str, records: DataFrame, of: str, value: str) -> DataFrame:
        own = lines.select(F.col(of).alias("key"), F.col(value).alias("decision"))
        titled = own.join(records, "key").select("title", "decision")
        found = resolve.match_with_fallback(records, own, titled, id_col="key", title="title", value="decision")
        return found.select(F.lit(kind).alias("kind"), "key", "decision")

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("string").alias("title"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat_ws("/", "p_brand", "p_size").alias("title"))
    return decided("order", orders, "l_orderkey", "l_linestatus").unionByName(decided("part", parts, "l_partkey", "l_returnflag"))


def _restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    fresh = orders.where("o_orderdate >= TIMESTAMP_NTZ'1999-01-01'").selectExpr("o_orderkey", "if(o_orderkey % 5 = 0, '', o_orderstatus) AS status")
    previous = orders.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey", "if(o_orderkey % 7 = 0, '', lower(o_orderstatus)) AS status")
    return incremental.restored(orders, fresh, previous, key="o_orderkey", value="status")


def _suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat(date_format(o_orderdate, 'yyyyMMdd'), '-', substring(o_orderpriority, 1, 1)) AS base")
    return ordering.suffixed_ids(rows, base="base", order=["o_orderkey"]).select("o_orderkey", "id")


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd') AS day", "o_orderstatus")
    return ordering.running_number(rows, ["day", "o_orderstatus"], ["o_orderkey"])


def _fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return ordering.fill_down(rows, F.when(F.col("event_type") == "error", F.col("event_id")), ["user_id"], ["ts", "event_id"], "last_error").select("event_id", "user_id", "last_error")


def _streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return ordering.leading_streak(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("event_type").isin("error", "click"))


def _spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    return ordering.day_spine(daily, day="day", value="errors", first="2023-12-28", last="2024-02-02").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "errors")


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    return ordering.activity_state(ordering.day_spine(daily, day="day", value="errors", first="2023-12-28", last="2024-02-02"), value="errors")


SPINE = """
daily AS (SELECT CAST(ts AS date) AS day, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(DATE '2023-12-28', DATE '2024-02-02', INTERVAL 1 DAY)) AS date) AS day)
"""

QUERIES = {
    "timeline_union": (_union, f"WITH {ENTRIES} SELECT member, kind, strftime(day, '%Y-%m-%d') AS day, entry, value, mark, CASE kind WHEN 'order' THEN 1 WHEN 'line' THEN 2 ELSE 3 END AS rank FROM entries"),
    "member_counts": (_counts, f"""WITH {ENTRIES} SELECT c_custkey, count(*) FILTER (kind = 'order') AS n_order, count(*) FILTER (kind = 'line') AS n_line, count(*) FILTER (kind = 'event') AS n_event
      FROM customer LEFT JOIN entries ON c_custkey = member GROUP BY 1"""),
    "role_fold": (_roles, """SELECT user_id, day(ts) AS day, event_type, count(*) AS times, arg_min(event_id, (ts, event_id)) AS first_event_id, arg_max(event_id, (ts, event_id)) AS last_event_id
      FROM events GROUP BY ALL"""),
    "latest_nonempty_merge": (_latest, """SELECT user_id, round(arg_max(value, (ts, event_id)) FILTER (value > 5), 4) AS value, arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'error') AS event_type FROM events GROUP BY 1"""),
    "stance_estimate": (_stance, """WITH tally AS (SELECT year(o_orderdate) AS sess, c_nationkey AS nation, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
      SELECT sess || '-' || n_regionkey AS bill, c_custkey AS member, CAST(nation AS varchar) AS grp, CASE WHEN f > o THEN 'yes' ELSE 'no' END AS stance, true AS estimated
      FROM tally JOIN nation ON nation = n_nationkey JOIN customer ON c_nationkey = nation AND 1993 + c_custkey % 5 <= sess AND sess <= 1996 + c_custkey % 5 WHERE f <> o"""),
    "unanimous_decision": (_unanimous, """WITH records AS (SELECT 'order' AS kind, o_orderkey AS key, CAST(o_custkey AS varchar) AS title FROM orders UNION ALL SELECT 'part', p_partkey, p_brand || '/' || p_size FROM part),
      marks AS (SELECT 'order' AS kind, l_orderkey AS key, l_linestatus AS v FROM lineitem UNION ALL SELECT 'part', l_partkey, l_returnflag FROM lineitem),
      one AS (SELECT kind, key, max(v) AS a FROM marks GROUP BY ALL HAVING count(DISTINCT v) = 1),
      two AS (SELECT kind, title, max(v) AS b FROM marks JOIN records USING (kind, key) GROUP BY ALL HAVING count(DISTINCT v) = 1)
      SELECT kind, key, coalesce(a, b) AS decision FROM records LEFT JOIN one USING (kind, key) LEFT JOIN two USING (kind, title)"""),
    "restore_decisions": (_restored, """WITH fresh AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS a FROM orders WHERE o_orderdate >= '1999-01-01'),
      prev AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN lower(o_orderstatus) END AS b FROM orders WHERE o_orderkey % 3 <> 0)
      SELECT o_orderkey, coalesce(a, b) AS status, CASE WHEN a IS NOT NULL THEN 'fresh' WHEN b IS NOT NULL THEN 'restored' ELSE 'missing' END AS state
      FROM orders LEFT JOIN fresh USING (o_orderkey) LEFT JOIN prev USING (o_orderkey)"""),
    "dup_suffix": (_suffix, """WITH b AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '-' || substr(o_orderpriority, 1, 1) AS base FROM orders)
      SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '-' || row_number() OVER (PARTITION BY base ORDER BY o_orderkey) ELSE base END AS id FROM b"""),
    "running_number": (_numbers, """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus, row_number() OVER (PARTITION BY o_orderdate, o_orderstatus ORDER BY o_orderkey) AS number FROM orders"""),
    "fill_down": (_fill, """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_error FROM events"""),
    "failure_streak": (_streak, """WITH r AS (SELECT user_id, sum(CASE WHEN event_type IN ('error', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS ended
        FROM events) SELECT user_id, count(*) FILTER (ended = 0) AS streak, count(*) AS measured FROM r GROUP BY 1"""),
    "zero_days": (_spine, f"WITH {SPINE} SELECT strftime(day, '%Y-%m-%d') AS day, errors FROM spine LEFT JOIN daily USING (day)"),
    "activity_state": (_state, f"""WITH {SPINE}, c AS (SELECT count(errors) AS measured, count(*) FILTER (errors = 0) AS zero_days, count(*) AS days FROM spine LEFT JOIN daily USING (day))
      SELECT *, CASE WHEN measured = 0 THEN 'not_measured' WHEN measured = zero_days THEN 'silent' ELSE 'active' END AS state FROM c"""),
}
