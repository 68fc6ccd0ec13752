"""Counts, recounts, coverage, guards and violations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions import text
from rollbook.operators import districts, geometry, incremental, ordering, quality, readapi
from rollbook.operators.majority import group_majority
from rollbook.session import table

MARKS = "CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' ELSE 'none' END"


def _recounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published counts that are right but for every seventh order, absent for every eleventh; some marks are unreadable."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", f"{MARKS} AS vote", "l_tax", "l_linenumber")
    published = lines.groupBy("l_orderkey").agg(F.count_if(F.col("vote") == "yes").alias("y"), F.count_if(F.col("vote") == "no").alias("n"))
    published = published.selectExpr("l_orderkey AS call", "if(l_orderkey % 11 = 0, NULL, y + if(l_orderkey % 7 = 0, 1, 0)) AS y", "n")
    return quality.recount(published, lines, call="call", yes="y", no="n", of="l_orderkey", vote="vote", readable=~((F.col("l_linenumber") == 7) & (F.col("l_tax") == 0)))


RECOUNT = """
counted AS (SELECT l_orderkey AS call, count(*) FILTER (l_returnflag = 'A') AS counted_yes, count(*) FILTER (l_returnflag = 'R') AS counted_no, count(*) FILTER (l_linenumber = 7 AND l_tax = 0) AS bad FROM lineitem GROUP BY 1),
pub AS (SELECT call, CASE WHEN call % 11 <> 0 THEN counted_yes + CASE WHEN call % 7 = 0 THEN 1 ELSE 0 END END AS published_yes, counted_no AS published_no, counted_yes, counted_no, bad FROM counted),
recounted AS (SELECT call, published_yes, published_no, counted_yes, counted_no, CASE WHEN published_yes IS NULL THEN 'no_counts' WHEN bad > 0 THEN 'unreadable'
  WHEN published_yes = counted_yes THEN 'equal' ELSE 'mismatch' END AS state FROM pub)
"""


def _dissent(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS roll_call", "l_linestatus AS grp", "l_suppkey AS member", f"{MARKS} AS vote")
    major = group_majority(votes, call="roll_call", group="grp", vote="vote").select(F.col("roll_call").alias("_c"), F.col("grp").alias("_g"), "majority")
    both = votes.join(major, (F.col("roll_call") == F.col("_c")) & (F.col("grp") == F.col("_g")))
    return both.where("vote <> 'none' AND majority IS NOT NULL AND vote <> majority").select("roll_call", "grp", "member", "vote", "majority")


def _session_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "lineitem").selectExpr("date_format(l_shipdate, 'yyyy-MM') AS month", "date_format(l_shipdate, 'yyyy-MM-dd') AS day", "l_orderkey", "if(l_suppkey % 9 = 0, NULL, l_suppkey) AS member", "concat('s', l_suppkey) AS name")
    return quality.session_coverage(votes, table(spark, sf_dir, "supplier"), session="month", date="day", call="l_orderkey", member="member", name="name", roster_member="s_suppkey")


def _roster_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "CAST(l_shipdate AS date) AS day")
    found = quality.roster_window(votes, by=["l_suppkey"], date="day", as_of=F.lit("1998-06-30").cast("date"))
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_date", "last_date")})


def _link_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("year(o_orderdate) AS sess", "if(o_custkey % 4 = 1, NULL, o_custkey) AS member")
    return quality.link_stats(rows, by="sess", member="member")


def _session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey", "year(o_orderdate) * 12 + month(o_orderdate) AS month")
    return quality.session_range(rows, by=["o_custkey"], session="month")


def _by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.year("o_orderdate").alias("sess")).agg(F.count("*").alias("bills"))


def _by_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_nationkey", "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal >= 0 END AS current")
    return rows.groupBy("c_nationkey").agg(F.count("*").alias("members"), F.count_if(~F.col("current").eqNullSafe(F.lit(False))).alias("current"))


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    facts = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("r_name", "n_name", "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal >= 0 END AS current")
    return readapi.coverage(facts, by=["r_name", "n_name"], current="current")


def _align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "l_partkey", "l_returnflag")
    return readapi.align(rows, [1, 2, 3, 5], column="l_suppkey", record="l_partkey", value="l_returnflag")


def _unshared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readapi.unshared(table(spark, sf_dir, "lineitem"), [1, 2, 3, 5], column="l_suppkey", record="l_partkey")


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readapi.search(table(spark, sf_dir, "part"), equal={"p_type": "PROMO", "p_brand": None}, text="RED  ", within=[F.col("p_name"), F.col("p_brand")], key=lambda c: F.lower(text.search_key(c)))
    return found.select("p_partkey", "p_name", "p_brand")


def _letter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.lower(F.substring("p_name", 1, 1))
    row = F.when(first.between("a", "f"), "a").when(first.between("g", "m"), "g").when(first.between("n", "s"), "n").when(first.between("t", "z"), "t").otherwise("other")
    return table(spark, sf_dir, "part").groupBy(row.alias("row")).agg(F.count("*").alias("parts"), F.min("p_name").alias("first_name"))


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("parts"))
    return ordering.fold_groups(sizes, order="p_size", size="parts", limit=200)


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readapi.distinct_letters(table(spark, sf_dir, "part"), ["p_name", "p_type"])


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.createDataFrame([("web", "h0", "click"), ("shop", "both", "purchase"), ("log", "h1", "error"), ("desk", "h0", "signup"), ("tv", "both", "view")], "name string, house string, kind string")
    members = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('h', c_nationkey % 2) AS house")
    found = readapi.used_sources(members, table(spark, sf_dir, "events").selectExpr("user_id AS c_custkey", "event_type AS kind").where("kind <> 'view' OR c_custkey % 2 = 0"), sources.withColumnRenamed("name", "source_name"), member="c_custkey", house="house", kind="kind", source="source_name")
    return found


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", geometry.band_index([0, 10_000, 25_000, 60_000, 104_000], F.col("l_extendedprice")).alias("band"))
    return rows.where("band IS NOT NULL").groupBy("band").agg(F.count("*").alias("lines"), F.round(F.max("l_extendedprice"), 2).alias("highest"))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(geometry.cluster(F.collect_list("l_quantity")).alias("c"))
    return lines.select("l_partkey", F.posexplode("c").alias("pos", "centre")).select("l_partkey", "pos", F.round("centre", 4).alias("centre"))


CLUSTERS = """
WITH RECURSIVE v AS (SELECT l_partkey, l_quantity AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity) AS i FROM lineitem),
walk(l_partkey, i, pos, centre) AS (SELECT l_partkey, i, 0, q FROM v WHERE i = 1
  UNION ALL SELECT v.l_partkey, v.i, CASE WHEN abs(w.centre - v.q) <= 1.5 THEN w.pos ELSE w.pos + 1 END, CASE WHEN abs(w.centre - v.q) <= 1.5 THEN (w.centre + v.q) / 2 ELSE v.q END
  FROM walk w JOIN v ON v.l_partkey = w.l_partkey AND v.i = w.i + 1)
SELECT l_partkey, pos, round(arg_max(centre, i), 4) AS centre FROM walk GROUP BY ALL
"""


def _zip_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    nations = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("o_custkey", F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("nation"))
    return districts.union_sets(nations.distinct(), by="o_custkey", value="nation", out="nations")


def _wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with an unread letter, against all names of the brand: whole name first, then the name's end."""
    from pyspark.sql import Window

    parts = table(spark, sf_dir, "part")
    asked = parts.selectExpr("p_partkey", "p_brand", "if(p_partkey % 2 = 0, concat(substring(p_name, 1, 2), '_', substring(p_name, 4)), concat('_', substring_index(p_name, ' ', -1))) AS pattern")
    names = parts.select("p_brand", "p_name").distinct()
    hits = districts.fitting_ends(asked, names, pattern="pattern", name="p_name", within="p_brand").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("whole"), 1).otherwise(2).alias("tier"))
    best = hits.withColumn("best", F.min("tier").over(Window.partitionBy("p_partkey"))).where("tier = best")
    return best.groupBy("p_partkey").agg(F.min("tier").alias("tier"), F.count("*").alias("hits"), F.when(F.count("*") == 1, F.min("name")).alias("match"))


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines, customers = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    stated = orders.selectExpr("o_orderkey", "if(o_orderkey % 1000 = 1, 0L, NULL) AS n").where("n IS NOT NULL")
    listed = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "-event_id AS place", "date_format(if(event_id % 500 = 3, ts + INTERVAL 40 DAYS, ts), 'yyyy-MM-dd') AS day")
    return quality.violations({
        "domain": quality.outside_domain(orders, "o_orderkey", "o_orderstatus", ["F", "O"]),
        "unique": quality.not_unique(lines.selectExpr("concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS k"), "k"),
        "reference": quality.dangling(table(spark, sf_dir, "events"), "event_id", "user_id", customers.where("c_custkey % 50 <> 0"), "c_custkey"),
        "format": quality.not_matching(customers.selectExpr("c_custkey", "if(c_custkey % 300 = 0, lower(c_name), c_name) AS c_name"), "c_custkey", "c_name", "Customer#\\d{9}"),
        "order": quality.out_of_order(listed, "user_id", "place", "day", "event_id"),
        "recount": quality.recount_differs(stated, "o_orderkey", "n", lines, "l_orderkey"),
        "conditional": quality.broken_condition(orders, "o_orderkey", (F.col("o_orderstatus") != "P") | (F.col("o_totalprice") > 1500), F.col("o_orderstatus")),
    })


VIOLATIONS = """
WITH keyed AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem),
listed AS (SELECT user_id, event_id, strftime(CASE WHEN event_id % 500 = 3 THEN ts + INTERVAL 40 DAYS ELSE ts END, '%Y-%m-%d') AS day FROM events),
before AS (SELECT event_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY -event_id) AS was FROM listed)
SELECT 'domain' AS rule, CAST(o_orderkey AS varchar) AS entity, o_orderstatus AS detail FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'unique', k, CAST(count(*) AS varchar) FROM keyed GROUP BY k HAVING count(*) > 1
UNION ALL SELECT 'reference', CAST(event_id AS varchar), CAST(user_id AS varchar) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)
UNION ALL SELECT 'format', CAST(c_custkey AS varchar), lower(c_name) FROM customer WHERE c_custkey % 300 = 0
UNION ALL SELECT 'order', CAST(event_id AS varchar), day FROM before WHERE was < day
UNION ALL SELECT 'recount', CAST(o_orderkey AS varchar), '0/' || count(l_orderkey) FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 1000 = 1 GROUP BY o_orderkey HAVING count(l_orderkey) > 0
UNION ALL SELECT 'conditional', CAST(o_orderkey AS varchar), o_orderstatus FROM orders WHERE o_orderstatus = 'P' AND NOT o_totalprice > 1500
"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus AS kind", "year(o_orderdate) AS sess", "o_orderpriority")
    return rows, rows.where("NOT (sess = 1997 AND o_orderkey % 3 = 0) AND NOT (sess = 2000 AND kind = 'P')")


def _lost_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.lost_counts(*_snapshots(spark, sf_dir), ["kind"])


def _lost_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.lost_counts(*_snapshots(spark, sf_dir), ["sess", "kind"])


def _lost_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    now = after.selectExpr("o_orderkey", "if(o_orderkey % 13 = 0, '', o_orderpriority) AS o_orderpriority")
    return incremental.lost_values(before, now, key="o_orderkey", value="o_orderpriority")


def _carry_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey", "if(l_suppkey % 10 = 0, NULL, l_returnflag) AS flag")
    return incremental.carried_only(rows.where("l_suppkey < 60"), rows.where("l_suppkey > 40 OR l_orderkey % 2 = 0"), ["l_orderkey", "l_linenumber", "l_suppkey", "flag"])


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").selectExpr("year(o_orderdate) AS sess")
    asked = spark.createDataFrame([(2001,), (2002,)], "sess int")
    return incremental.plan_sessions(asked, years, session="sess")


QUERIES = {
    "dissent_rows": (_dissent, f"""WITH v AS (SELECT l_orderkey AS roll_call, l_linestatus AS grp, l_suppkey AS member, {MARKS} AS vote FROM lineitem),
      m AS (SELECT roll_call, grp, count(*) FILTER (vote = 'yes') AS y, count(*) FILTER (vote = 'no') AS n FROM v GROUP BY ALL)
      SELECT roll_call, grp, member, vote, CASE WHEN y > n THEN 'yes' ELSE 'no' END AS majority FROM v JOIN m USING (roll_call, grp) WHERE vote <> 'none' AND y <> n AND vote <> CASE WHEN y > n THEN 'yes' ELSE 'no' END"""),
    "count_check": (_recounted, f"WITH {RECOUNT} SELECT * FROM recounted"),
    "count_check_summary": (lambda s, d: quality.recount_summary(_recounted(s, d)), f"""WITH {RECOUNT} SELECT count(*) AS rows, count(*) FILTER (state = 'equal') AS equal, count(*) FILTER (state = 'mismatch') AS mismatch,
      count(*) FILTER (state = 'no_counts') AS no_counts, count(*) FILTER (state = 'unreadable') AS unreadable FROM recounted"""),
    "session_roster_coverage": (_session_coverage, """WITH b AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, strftime(max(l_shipdate), '%Y-%m-%d') AS date, count(DISTINCT l_orderkey) AS roll_calls, count(*) AS votes,
        count(DISTINCT CASE WHEN l_suppkey % 9 <> 0 THEN l_suppkey END) AS seen, count(DISTINCT CASE WHEN l_suppkey % 9 = 0 THEN l_suppkey END) AS unmatched_names, count(*) FILTER (l_suppkey % 9 = 0) AS unmatched_votes FROM lineitem GROUP BY 1)
      SELECT *, greatest(0, (SELECT count(DISTINCT s_suppkey) FROM supplier) - seen) AS absent, least(greatest(0, (SELECT count(DISTINCT s_suppkey) FROM supplier) - seen), unmatched_names) AS seats_changed FROM b"""),
    "roster_window": (_roster_window, """SELECT l_suppkey, strftime(min(l_shipdate), '%Y-%m-%d') AS first_date, strftime(max(l_shipdate), '%Y-%m-%d') AS last_date, count(*) FILTER (CAST(l_shipdate AS date) < DATE '1998-06-30') AS before,
      count(*) FILTER (CAST(l_shipdate AS date) > DATE '1998-06-30') AS after, max(DATE '1998-06-30' - CAST(l_shipdate AS date)) AS days_before, max(CAST(l_shipdate AS date) - DATE '1998-06-30') AS days_after FROM lineitem GROUP BY 1"""),
    "link_stats": (_link_stats, "SELECT year(o_orderdate) AS sess, count(*) AS records, count(*) FILTER (o_custkey % 4 <> 1) AS linked FROM orders GROUP BY 1"),
    "session_gaps": (_session_gaps, """WITH m AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS month FROM orders)
      SELECT o_custkey, min(month) AS first, max(month) AS last, count(DISTINCT month) AS sessions, max(month) - min(month) + 1 > count(DISTINCT month) AS gaps FROM m GROUP BY 1"""),
    "bills_by_session": (_by_session, "SELECT o_orderstatus, year(o_orderdate) AS sess, count(*) AS bills FROM orders GROUP BY ALL"),
    "members_by_assembly": (_by_assembly, "SELECT c_nationkey, count(*) AS members, count(*) FILTER (c_custkey % 6 = 0 OR c_acctbal >= 0) AS current FROM customer GROUP BY 1"),
    "coverage_rollup": (_coverage, """SELECT r_name, n_name, count(*) AS members, count(*) FILTER (c_custkey % 6 = 0 OR c_acctbal >= 0) AS current, CAST(grouping(r_name, n_name) AS integer) AS level
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"""),
    "compare_align": (_align, """SELECT l_partkey, max(l_returnflag) FILTER (l_suppkey = 1) AS c0, max(l_returnflag) FILTER (l_suppkey = 2) AS c1, max(l_returnflag) FILTER (l_suppkey = 3) AS c2, max(l_returnflag) FILTER (l_suppkey = 5) AS c3,
      count(DISTINCT l_suppkey) AS holders FROM lineitem WHERE l_suppkey IN (1, 2, 3, 5) GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1"""),
    "compare_unshared": (_unshared, """WITH a AS (SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_suppkey IN (1, 2, 3, 5) GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1)
      SELECT s_suppkey AS l_suppkey, count(l_partkey) AS unshared FROM supplier LEFT JOIN a ON s_suppkey = l_suppkey WHERE s_suppkey IN (1, 2, 3, 5) GROUP BY 1"""),
    "facet_search": (_search, "SELECT p_partkey, p_name, p_brand FROM part WHERE p_type = 'PROMO' AND (contains(lower(replace(p_name, ' ', '')), 'red') OR contains(lower(p_brand), 'red'))"),
    "kana_row_like": (_letter_rows, """SELECT CASE WHEN lower(p_name[1]) BETWEEN 'a' AND 'f' THEN 'a' WHEN lower(p_name[1]) BETWEEN 'g' AND 'm' THEN 'g' WHEN lower(p_name[1]) BETWEEN 'n' AND 's' THEN 'n'
      WHEN lower(p_name[1]) BETWEEN 't' AND 'z' THEN 't' ELSE 'other' END AS row, count(*) AS parts, min(p_name) AS first_name FROM part GROUP BY 1"""),
    "fold_groups": (_folded, """WITH g AS (SELECT p_size, count(*) AS parts FROM part GROUP BY 1), u AS (SELECT *, sum(parts) OVER (ORDER BY p_size) AS upto, row_number() OVER (ORDER BY p_size) AS i FROM g),
      k AS (SELECT * FROM u WHERE i = 1 OR upto <= 200) SELECT p_size, parts, CAST((SELECT sum(parts) FROM g) - (SELECT max(upto) FROM k) AS bigint) AS hidden FROM k"""),
    "distinct_chars": (_letters, "SELECT DISTINCT unnest(string_split(p_name || p_type, '')) AS letter FROM part"),
    "source_usage": (_sources, """WITH s(source, house, kind) AS (VALUES ('web', 'h0', 'click'), ('shop', 'both', 'purchase'), ('log', 'h1', 'error'), ('desk', 'h0', 'signup'), ('tv', 'both', 'view'))
      SELECT DISTINCT c_custkey, source FROM customer JOIN events ON c_custkey = user_id JOIN s ON event_type = kind AND (house = 'both' OR house = 'h' || (c_nationkey % 2)) WHERE event_type <> 'view' OR user_id % 2 = 0"""),
    "band_index": (_bands, """WITH b(band, low, high) AS (VALUES (0, 0, 10000), (1, 10000, 25000), (2, 25000, 60000), (3, 60000, 104000))
      SELECT band, count(*) AS lines, round(max(l_extendedprice), 2) AS highest FROM lineitem JOIN b ON l_extendedprice > low + 1 AND l_extendedprice < high - 1 GROUP BY 1"""),
    "cluster_1d": (_clusters, CLUSTERS),
    "zip_union": (_zip_union, """SELECT o_custkey, string_agg(DISTINCT lpad(CAST(s_nationkey AS varchar), 2, '0'), ',' ORDER BY lpad(CAST(s_nationkey AS varchar), 2, '0')) AS nations
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"""),
    "wildcard_tier_match": (_wildcards, """WITH asked AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 2 = 0 THEN substr(p_name, 1, 2) || '_' || substr(p_name, 4) ELSE '_' || split_part(p_name, ' ', -1) END AS pattern FROM part),
      names AS (SELECT DISTINCT p_brand, p_name AS name FROM part),
      hits AS (SELECT p_partkey, name, CASE WHEN name LIKE pattern THEN 1 WHEN name LIKE '%' || pattern THEN 2 END AS tier FROM asked JOIN names USING (p_brand)),
      best AS (SELECT *, min(tier) OVER (PARTITION BY p_partkey) AS best FROM hits WHERE tier IS NOT NULL)
      SELECT p_partkey, min(tier) AS tier, count(*) AS hits, CASE WHEN count(*) = 1 THEN min(name) END AS match FROM best WHERE tier = best GROUP BY 1"""),
    "violations": (_violations, VIOLATIONS),
    "lost_entries": (_lost_entries, """WITH a AS (SELECT o_orderstatus AS kind, year(o_orderdate) AS sess, o_orderkey FROM orders)
      SELECT kind, count(*) AS n_before, count(*) FILTER (NOT (sess = 1997 AND o_orderkey % 3 = 0) AND NOT (sess = 2000 AND kind = 'P')) AS n_after FROM a GROUP BY 1 HAVING n_after < n_before"""),
    "lost_sessions": (_lost_sessions, """WITH a AS (SELECT o_orderstatus AS kind, year(o_orderdate) AS sess, o_orderkey FROM orders)
      SELECT sess, kind, count(*) AS n_before, count(*) FILTER (NOT (sess = 1997 AND o_orderkey % 3 = 0) AND NOT (sess = 2000 AND kind = 'P')) AS n_after FROM a GROUP BY ALL HAVING n_after < n_before"""),
    "lost_decisions": (_lost_decisions, """SELECT o_orderkey, o_orderpriority AS was FROM orders WHERE o_orderkey % 13 = 0 AND NOT (year(o_orderdate) = 1997 AND o_orderkey % 3 = 0) AND NOT (year(o_orderdate) = 2000 AND o_orderstatus = 'P')"""),
    "carry_dedup": (_carry_dedup, """WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_suppkey % 10 <> 0 THEN l_returnflag END AS flag FROM lineitem)
      SELECT * FROM r WHERE l_suppkey < 60 AND NOT EXISTS (SELECT 1 FROM r f WHERE (f.l_suppkey > 40 OR f.l_orderkey % 2 = 0) AND f.l_orderkey = r.l_orderkey AND f.l_linenumber = r.l_linenumber AND f.l_suppkey = r.l_suppkey AND f.flag IS NOT DISTINCT FROM r.flag)"""),
    "plan_sessions": (_plan, "SELECT sess, CASE WHEN sess >= 2001 THEN 'fetch' ELSE 'carry' END AS action FROM (SELECT DISTINCT year(o_orderdate) AS sess FROM orders UNION SELECT 2001 UNION SELECT 2002)"),
}
