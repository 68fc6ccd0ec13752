"""Landed files: postal code tables, access logs, robots rules, published JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POSTAL = "code string, old_zip string, zip string, pref_kana string, city_kana string, town_kana string, pref string, city string, town string, f1 int, f2 int, f3 int, f4 int, f5 int, f6 int"


def postal_codes(spark: SparkSession, path: str, encoding: str = "Shift_JIS") -> DataFrame:
    """The postal code table: exactly fifteen columns, of which five are kept; anything else is refused."""
    if encoding.upper() != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows = spark.read.schema(POSTAL).option("encoding", encoding).option("mode", "FAILFAST").csv(path)
    return rows.select("code", "zip", "pref", "city", "town")


def log_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of current and rotated logs, gzipped ones too. No log at all is an error, not an empty result."""
    if not paths:
        raise FileNotFoundError("no access log to read")
    return spark.read.text(paths)


def published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A published JSON table; a record of another shape is refused."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def robots_rules(lines: DataFrame, *, site: str = "site", at: str = "at", line: str = "value") -> DataFrame:
    """Site, agent and rule from the numbered lines of sites' robots files; ``*`` is any agent.

    Neighbouring agent lines head one block, whose rules hold for all of them;
    empty rules and what stands before any agent are none.
    """
    text = F.substring_index(line, "#", 1)
    field, value = F.lower(F.trim(F.substring_index(text, ":", 1))), F.trim(F.substr(text, F.instr(text, ":") + 1))
    rows = lines.where(text.contains(":")).select(F.col(site).alias("site"), F.col(at).alias("at"), field.alias("field"), value.alias("value")).where("field RLIKE '^[a-z-]+$'")
    order = Window.partitionBy("site").orderBy("at")
    heads = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    blocks = rows.withColumn("_head", heads.cast("int")).withColumn("block", F.sum("_head").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    agents = blocks.where("field = 'user-agent' AND value <> ''").select("site", "block", F.lower("value").alias("agent"))
    rules = blocks.where("field = 'disallow' AND value <> ''").select("site", "block", F.col("value").alias("rule"))
    return agents.join(rules, ["site", "block"]).select("site", "agent", "rule").distinct()


def allowed(urls: DataFrame, rules: DataFrame, agent: str, *, site: str = "site", url: str = "url") -> DataFrame:
    """``urls`` with ``allowed``: no rule for ``agent`` on its site fits path and query (``*`` any letters, ``$`` at the end the end). What is no URL is not allowed."""
    fits = F.lit(agent.lower()).startswith(F.col("agent")) | (F.col("agent") == "*")
    plain = F.regexp_replace(F.col("rule"), r"[%_\\]", r"\\\\$0")
    pattern = F.when(plain.endswith("$"), F.rtrim(plain, F.lit("$"))).otherwise(F.concat(plain, F.lit("%")))
    of_site = rules.where(fits).select(F.col("site").alias("_site"), F.replace(pattern, F.lit("*"), F.lit("%")).alias("_pattern")).groupBy("_site").agg(F.collect_set("_pattern").alias("_patterns"))
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    rest = F.substring_index(F.substr(url, F.instr(url, "://") + F.length(authority) + 3), "#", 1)
    target = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    both = urls.join(of_site, F.col(site) == F.col("_site"), "left")
    hit = F.exists(F.coalesce("_patterns", F.array().cast("array<string>")), lambda p: F.like(target, p))
    return both.withColumn("allowed", F.coalesce(authority.isNotNull() & ~hit, F.lit(False))).drop("_site", "_patterns")
