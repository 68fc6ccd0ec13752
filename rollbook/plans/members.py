"""Members and their terms: customers are members, orders the records that name them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators import resolve, terms
from rollbook.session import table

T = resolve.Terms(member="c_custkey", key="name_key", since="since", until="until", group="grp", ends="ends", pos="pos")


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term for each customer; a hundred names a segment, so names repeat."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "concat(c_mktsegment, '-', c_custkey % 100) AS name_key", "concat('R', c_custkey % 61) AS second_key", "1993 + c_custkey % 5 AS since",
        "if(c_custkey % 7 = 0, NULL, 1993 + c_custkey % 5 + c_custkey % 3) AS until", "concat('g', c_nationkey % 5) AS grp",
        "if(c_custkey % 4 = 0, concat(1997 + c_custkey % 5, '-06-30'), '') AS ends", "0 AS pos",
    )


ROSTER = """
roster AS (SELECT c_custkey, c_mktsegment || '-' || (c_custkey % 100) AS name_key, 'R' || (c_custkey % 61) AS second_key, 1993 + c_custkey % 5 AS since,
  CASE WHEN c_custkey % 7 = 0 THEN 1993 + c_custkey % 5 ELSE 1993 + c_custkey % 5 + c_custkey % 3 END AS until, 'g' || (c_nationkey % 5) AS grp,
  CASE WHEN c_custkey % 4 = 0 THEN (1997 + c_custkey % 5) || '-06-30' ELSE '' END AS ends FROM customer)
"""

SEGMENTS = "array('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'UNHEARD')"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"concat({SEGMENTS}[o_orderkey % 6], '-', o_custkey % 100) AS name_key", "concat('R', o_custkey % 97) AS second_key",
        "year(o_orderdate) AS sess", "concat('g', o_orderkey % 7) AS grp", "date_format(o_orderdate, 'yyyy-MM-dd') AS day",
    )


RECORDS = """
records AS (SELECT o_orderkey, (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'UNHEARD'])[o_orderkey % 6 + 1] || '-' || (o_custkey % 100) AS name_key,
  'R' || (o_custkey % 97) AS second_key, year(o_orderdate) AS sess, 'g' || (o_orderkey % 7) AS grp, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
"""

ALIASES = [("g0", "g5"), ("g1", "g6")]
ALIAS_SQL = "(m.grp = r.grp OR (m.grp, r.grp) IN (('g0', 'g5'), ('g1', 'g6')))"


def _aliases(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(ALIASES, "roster_group string, record_group string"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(records(spark, sf_dir), roster(spark, sf_dir), record="o_orderkey", key="name_key", at="sess", group="grp", date="day", t=T, same_group=_aliases(spark))


RESOLVED = f"""
hits AS (SELECT r.o_orderkey, m.c_custkey, m.since <= r.sess AND r.sess <= m.until AS direct, {ALIAS_SQL} AS same FROM records r JOIN roster m ON r.name_key = m.name_key
  WHERE m.since <= r.sess AND (r.sess <= m.until OR (m.ends <> '' AND m.ends >= r.day))),
counts AS (SELECT o_orderkey, count(*) AS n, count(*) FILTER (same) AS g, count(*) FILTER (same AND direct) AS d, max(c_custkey) AS one,
  max(c_custkey) FILTER (same) AS of_group, max(c_custkey) FILTER (same AND direct) AS straight FROM hits GROUP BY 1),
resolved AS (SELECT r.*, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'single' WHEN g = 1 THEN 'group' WHEN g > 1 AND d = 1 THEN 'direct' ELSE 'ambiguous' END AS branch,
  CASE WHEN n = 1 THEN one WHEN g = 1 THEN of_group WHEN g > 1 AND d = 1 THEN straight END AS member FROM records r LEFT JOIN counts USING (o_orderkey))
"""


def _resolve_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("o_orderkey", "name_key", "member", "branch")


def _resolve_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = _resolved(spark, sf_dir).where("member IS NULL")
    return lost.groupBy("sess", "branch").agg(F.count("*").alias("records"), F.countDistinct("name_key").alias("names"))


def _group_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.group_mismatches(_resolved(spark, sf_dir), roster(spark, sf_dir), group="grp", t=T, same_group=_aliases(spark))
    return found.select("o_orderkey", "member", "grp")


def _two_tier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = resolve.Terms(member="c_custkey", key="name_key", since="since", until="until", group=None, ends="ends", pos="pos")
    r = roster(spark, sf_dir)
    second = r.drop("name_key").withColumnRenamed("second_key", "name_key")
    found = resolve.resolve_two_tier(records(spark, sf_dir), r, second, record="o_orderkey", key="name_key", second_key="second_key", at="sess", date="day", t=own)
    return found.select("o_orderkey", "member", F.coalesce("matched_by", "reason").alias("outcome"))


def _rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published roster for each day with events but every ninth: who was there and their commonest kind of event."""
    daily = table(spark, sf_dir, "events").selectExpr("user_id", "dayofmonth(ts) AS day", "event_type").where("day % 9 <> 0")
    kinds = daily.groupBy("user_id", "day", "event_type").agg(F.count("*").alias("n"))
    return kinds.groupBy("user_id", "day").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("grp"))


ROSTERS = """
kinds AS (SELECT user_id, day(ts) AS day, event_type, count(*) AS n FROM events WHERE day(ts) % 9 <> 0 GROUP BY ALL),
rosters AS (SELECT user_id, day, arg_max(event_type, (n, event_type)) AS grp FROM kinds GROUP BY ALL)
"""
MERGED = """
ranks AS (SELECT day, dense_rank() OVER (ORDER BY day) AS k FROM (SELECT DISTINCT day FROM rosters)),
marked AS (SELECT user_id, day, grp, CASE WHEN lag(grp) OVER w = grp AND lag(k) OVER w = k - 1 THEN 0 ELSE 1 END AS brk FROM rosters JOIN ranks USING (day) WINDOW w AS (PARTITION BY user_id ORDER BY day)),
runs AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY day) AS run FROM marked),
merged AS (SELECT user_id, grp, run, min(day) AS since, max(day) AS until FROM runs GROUP BY ALL)
"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.merge_terms(_rosters(spark, sf_dir), member="user_id", session="day", same=["grp"])


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").where("event_type = 'purchase'").selectExpr("event_id", "user_id AS who", "dayofmonth(ts) AS sess")
    return terms.term_in_force(asked, _merged(spark, sf_dir), record="event_id", member="who", at="sess", value="grp", term_member="user_id", since="since", until="until", pos="nth")


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.covered_sessions(roster(spark, sf_dir).where("c_custkey % 5 <> 2"), since="since", until="until")


def _uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.uncovered_sessions(records(spark, sf_dir), roster(spark, sf_dir).where("c_custkey % 5 < 2"), session="sess", since="since", until="until")


def _short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names cut short, as a worn document has them."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "concat(p_brand, '/', p_size) AS p_brand", "concat(substring(p_name, 1, 1), substring(p_name, 3, 2)) AS cut", "substring(p_name, 1, 4) AS head", "p_name").distinct()


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("concat(p_brand, '/', p_size) AS p_brand", "p_name").distinct()


def _subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.match_names(_short_names(spark, sf_dir), _names(spark, sf_dir).withColumnRenamed("p_name", "full_name"), key="cut", roster_key="full_name", member="full_name", how="subsequence", block="p_brand")
    return found.select("p_partkey", "cut", F.col("member").alias("match"), "hits")


def _prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.match_names(_short_names(spark, sf_dir), _names(spark, sf_dir).withColumnRenamed("p_name", "full_name"), key="head", roster_key="full_name", member="full_name", how="prefix", block="p_brand")
    return found.select("p_partkey", "head", F.col("member").alias("match"), "hits")


def _lossy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched pairs whose printed name lacks letters of the full one, and in how many parts."""
    return _subsequence(spark, sf_dir).where("match IS NOT NULL AND cut <> match").groupBy("cut", "match").agg(F.countDistinct("p_partkey").alias("parts"))


NAMES = """
short AS (SELECT DISTINCT p_partkey, p_brand || '/' || p_size AS p_brand, substr(p_name, 1, 1) || substr(p_name, 3, 2) AS cut, substr(p_name, 1, 4) AS head FROM part),
full_names AS (SELECT DISTINCT p_brand || '/' || p_size AS p_brand, p_name FROM part),
"""
SUBSEQ = NAMES + """
subs AS (SELECT s.p_partkey, s.cut, count(n.p_name) AS hits, CASE WHEN count(n.p_name) = 1 THEN max(n.p_name) END AS match FROM short s LEFT JOIN full_names n
  ON s.p_brand = n.p_brand AND n.p_name LIKE '%' || substr(s.cut, 1, 1) || '%' || substr(s.cut, 2, 1) || '%' || substr(s.cut, 3, 1) || '%' GROUP BY ALL)
"""


def _hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.one_letter_apart(table(spark, sf_dir, "supplier"), name="s_name", member="s_suppkey")
    return found.select(F.col("member").alias("a"), F.col("member_b").alias("b"))


QUERIES = {
    "resolve_temporal": (_resolve_temporal, f"WITH {ROSTER}, {RECORDS}, {RESOLVED} SELECT o_orderkey, name_key, member, branch FROM resolved"),
    "resolve_unmatched": (_resolve_unmatched, f"WITH {ROSTER}, {RECORDS}, {RESOLVED} SELECT sess, branch, count(*) AS records, count(DISTINCT name_key) AS names FROM resolved WHERE member IS NULL GROUP BY ALL"),
    "group_mismatch": (_group_mismatch, f"WITH {ROSTER}, {RECORDS}, {RESOLVED} SELECT o_orderkey, member, r.grp FROM resolved r JOIN roster m ON r.member = m.c_custkey WHERE NOT {ALIAS_SQL}"),
    "two_tier_match": (_two_tier_query, f"""WITH {ROSTER}, {RECORDS},
      fits AS (SELECT o_orderkey, c_custkey, r.name_key = m.name_key AS by_name FROM records r JOIN roster m ON (r.name_key = m.name_key OR r.second_key = m.second_key)
        WHERE m.since <= r.sess AND (r.sess <= m.until OR (m.ends <> '' AND m.ends >= r.day))),
      one AS (SELECT o_orderkey, count(*) AS n, max(c_custkey) AS member FROM fits WHERE by_name GROUP BY 1),
      two AS (SELECT o_orderkey, count(*) AS n, max(f.c_custkey) AS member FROM fits f JOIN records r USING (o_orderkey) JOIN roster m USING (c_custkey) WHERE r.second_key = m.second_key GROUP BY 1),
      known AS (SELECT DISTINCT name_key FROM roster)
      SELECT o_orderkey, CASE WHEN one.n = 1 THEN one.member WHEN k.name_key IS NULL AND two.n = 1 THEN two.member END AS member,
        CASE WHEN one.n = 1 THEN 'name' WHEN k.name_key IS NULL AND two.n = 1 THEN 'second' WHEN k.name_key IS NULL AND two.n > 1 THEN 'ambiguous' ELSE 'no-candidate' END AS outcome
      FROM records LEFT JOIN one USING (o_orderkey) LEFT JOIN two USING (o_orderkey) LEFT JOIN known k USING (name_key)"""),
    "merge_terms": (_merged, f"""WITH {ROSTERS}, {MERGED} SELECT user_id, grp, since, until, row_number() OVER (PARTITION BY user_id ORDER BY run DESC) AS nth,
      until = (SELECT max(day) FROM rosters) AS current FROM merged"""),
    "asof_term": (_asof, f"""WITH {ROSTERS}, {MERGED}, asked AS (SELECT event_id, user_id AS who, day(ts) AS sess FROM events WHERE event_type = 'purchase')
      SELECT event_id, who, sess, arg_max(grp, CASE WHEN sess <= until THEN 1000 ELSE until END) AS grp FROM asked JOIN merged ON who = user_id AND since <= sess GROUP BY ALL"""),
    "covered_sessions": (_covered, f"WITH {ROSTER} SELECT DISTINCT unnest(range(since, until + 1)) AS session FROM roster WHERE c_custkey % 5 <> 2"),
    "uncovered_sessions": (_uncovered, f"WITH {ROSTER}, {RECORDS} SELECT DISTINCT sess FROM records WHERE sess NOT IN (SELECT unnest(range(since, until + 1)) FROM roster WHERE c_custkey % 5 < 2)"),
    "subsequence_match": (_subsequence, f"WITH {SUBSEQ} SELECT p_partkey, cut, match, hits FROM subs"),
    "prefix_match": (_prefix, f"""WITH {NAMES} found AS (SELECT s.p_partkey, s.head, count(n.p_name) AS hits, CASE WHEN count(n.p_name) = 1 THEN max(n.p_name) END AS match
      FROM short s LEFT JOIN full_names n ON s.p_brand = n.p_brand AND starts_with(n.p_name, s.head) GROUP BY ALL) SELECT p_partkey, head, match, hits FROM found"""),
    "lossy_pairs": (_lossy, f"WITH {SUBSEQ} SELECT cut, match, count(DISTINCT p_partkey) AS parts FROM subs WHERE match IS NOT NULL AND cut <> match GROUP BY ALL"),
    "hamming1_match": (_hamming, "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON length(a.s_name) = length(b.s_name) AND a.s_name < b.s_name AND hamming(a.s_name, b.s_name) = 1"),
}
