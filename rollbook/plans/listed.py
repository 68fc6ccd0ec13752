"""Names that records list: orders name two customers each, one by its own key and one by another segment's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators import matching, quality, terms, timeline
from rollbook.plans.members import RECORDS, ROSTER, SEGMENTS, T, records, roster
from rollbook.session import table


def _bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.expr(f"concat({SEGMENTS}[(o_orderkey + 1) % 6], '-', o_orderkey % 100)")
    return records(spark, sf_dir).withColumns({"names": F.array("name_key", other), "ids": F.array("o_orderkey")})


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.covered_sessions(roster(spark, sf_dir), since="since", until="until")


def _mentions(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return matching.mentions(_bills(spark, sf_dir), roster(spark, sf_dir), record="o_orderkey", names=F.col("names"), at="sess", date="day", t=T, covered=_covered(spark, sf_dir), keep=keep)


def _listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir).select("record", "place", "name", "member", "branch")


def _listed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = matching.with_members(_bills(spark, sf_dir), _mentions(spark, sf_dir), record="o_orderkey", out="ids", at="sess", covered=_covered(spark, sf_dir))
    return laid.select("o_orderkey", "sess", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def _listed_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = matching.unmatched(_mentions(spark, sf_dir), unless=F.col("place") == 1)
    return open_.groupBy("name", "branch").agg(F.count("*").alias("records"))


def _role_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _mentions(spark, sf_dir, keep=("sess", "day")).where("member IS NOT NULL")
    roles = timeline.fold_roles(found, ["member", "sess"], order=["day", "record"], carry=["day"])
    return roles.select("member", "sess", "times", "first_day", "last_day")


def _stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third order holds a customer that its names may not give; the rest hold what a run before found for the first name."""
    first = _mentions(spark, sf_dir).where("place = 0 AND member IS NOT NULL").select(F.col("record").alias("_of"), "member")
    bills = _bills(spark, sf_dir).join(first, F.col("o_orderkey") == F.col("_of"), "left")
    return bills.withColumn("ids", F.when(F.col("o_orderkey") % 3 == 0, F.array(F.col("o_orderkey") % 150)).when(F.col("member").isNotNull(), F.array(F.col("member").cast("long"))))


def _listed_unattested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.unattested(_stale(spark, sf_dir), _mentions(spark, sf_dir).withColumn("member", F.col("member").cast("long")), record="o_orderkey", ids="ids", at="sess", covered=_covered(spark, sf_dir))
    return rows.select("record", "names", "ids", "attested", F.element_at("unattested", 1).alias("unattested"))


def _attestation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.attestation(_stale(spark, sf_dir), ids="ids", at="sess", covered=_covered(spark, sf_dir))


def _best_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.best_covered(records(spark, sf_dir).groupBy("sess").agg(F.count("*").alias("n")), session="sess", n="n")


def _page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of hosts other than those of even pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.where("page_id % 2 = 0").select(F.regexp_extract("url", "^https://([^/?#:]+)", 1).alias("host")).where("host <> ''")
    return quality.bad_source(pages, "page_id", "url", hosts)


LISTED = f"""
{ROSTER}, {RECORDS},
covered AS (SELECT DISTINCT unnest(generate_series(since, until)) AS session FROM roster),
listed AS (SELECT o_orderkey, sess, day, 0 AS place, name_key AS name FROM records UNION ALL
  SELECT o_orderkey, sess, day, 1, (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'UNHEARD'])[(o_orderkey + 1) % 6 + 1] || '-' || (o_orderkey % 100) FROM records),
named AS (SELECT * FROM listed WHERE sess IN (SELECT session FROM covered)),
fits AS (SELECT n.o_orderkey, n.place, count(*) AS hits, max(c_custkey) AS one FROM named n JOIN roster m ON n.name = m.name_key
  WHERE m.since <= n.sess AND (n.sess <= m.until OR (m.ends <> '' AND m.ends >= n.day)) GROUP BY ALL),
found AS (SELECT n.*, CASE WHEN hits IS NULL THEN 'none' WHEN hits = 1 THEN 'single' ELSE 'ambiguous' END AS branch, CASE WHEN hits = 1 THEN one END AS member
  FROM named n LEFT JOIN fits USING (o_orderkey, place))
"""

STALE = """stale AS (SELECT r.o_orderkey, r.sess, CASE WHEN r.o_orderkey % 3 = 0 THEN r.o_orderkey % 150 ELSE f.member END AS id
  FROM records r LEFT JOIN found f ON r.o_orderkey = f.o_orderkey AND f.place = 0 WHERE r.o_orderkey % 3 = 0 OR f.member IS NOT NULL)"""

QUERIES = {
    "listed_names": (_listed_names, f"WITH {LISTED} SELECT o_orderkey AS record, place, name, member, branch FROM found"),
    "listed_members": (_listed_members, f"""WITH {LISTED}, lists AS (SELECT o_orderkey, string_agg(CAST(member AS VARCHAR), ',' ORDER BY place) AS ids FROM found WHERE member IS NOT NULL GROUP BY ALL)
      SELECT r.o_orderkey, r.sess, CASE WHEN r.sess IN (SELECT session FROM covered) THEN l.ids ELSE CAST(r.o_orderkey AS VARCHAR) END AS ids FROM records r LEFT JOIN lists l USING (o_orderkey)"""),
    "listed_unmatched": (_listed_unmatched, f"WITH {LISTED} SELECT name, branch, count(*) AS records FROM found WHERE member IS NULL AND place <> 1 GROUP BY ALL"),
    "role_spans": (_role_spans, f"WITH {LISTED} SELECT member, sess, count(*) AS times, min(day) AS first_day, max(day) AS last_day FROM found WHERE member IS NOT NULL GROUP BY ALL"),
    "listed_unattested": (_listed_unattested, f"""WITH {LISTED}, {STALE}, known AS (SELECT o_orderkey, count(*) AS names, list(DISTINCT member) FILTER (member IS NOT NULL) AS members FROM found GROUP BY ALL)
      SELECT s.o_orderkey AS record, names, 1 AS ids, coalesce(len(members), 0) AS attested, s.id AS unattested FROM stale s JOIN known k USING (o_orderkey)
      WHERE s.sess IN (SELECT session FROM covered) AND NOT coalesce(list_contains(members, s.id), false)"""),
    "attestation": (_attestation, f"WITH {LISTED}, {STALE} SELECT count(*) FILTER (sess IN (SELECT session FROM covered)) AS checked, count(*) FILTER (sess NOT IN (SELECT session FROM covered)) AS skipped FROM stale"),
    "best_session": (_best_session, f"WITH {RECORDS}, n AS (SELECT sess, count(*) AS n FROM records GROUP BY ALL) SELECT sess AS session, n FROM n ORDER BY n.n DESC, sess DESC LIMIT 1"),
    "page_sources": (_page_sources, """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https://([^/?#:]+)', 1)) AS host FROM pages), ok AS (SELECT DISTINCT host FROM h WHERE page_id % 2 = 0 AND host <> '')
      SELECT page_id AS entity, CASE WHEN coalesce(host, '') = '' THEN 'no https source' ELSE 'host ' || host END AS detail FROM h WHERE coalesce(host, '') = '' OR host NOT IN (SELECT host FROM ok)"""),
}
