"""URL filter: rules on hosts and paths, found by hashed expressions of each URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# More rules than this are joined by shuffle, not broadcast.
BROADCAST_RULES = 100_000

RULES_SCHEMA = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("verdict", T.StringType())])


def split_url(url: str) -> tuple[Column, Column]:
    """Host and path of a URL column; both empty for null and where there is no ``://``."""
    u = F.col(url)
    after = F.when(F.locate("://", u) > 0, F.expr(f"substr({url}, locate('://', {url}) + 3)")).otherwise(F.lit(""))
    authority = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(authority, upper, lower), path


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """The verdict of the most specific rule on each URL.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains
    where the URL's path starts with the rule's path. Each URL becomes
    host-suffix and path-prefix expressions (as many labels and letters as rules
    have), which meet the rules by the first ``prefix_hex`` digits of
    their SHA-256; the full digest then confirms. The longest rule wins; of
    equally long ones the longer host, and of one rule given twice, block.
    Distinct URLs are judged once; the join back to a hot URL's rows is left to
    the skew join of adaptive execution, as one judgement meets many rows.

    Rows: the id, host, path, rule (host and path as written, else null) and
    verdict (``default`` without a rule). Null, empty and relative URLs have
    empty host and path and no rule. Rows with equal or null ids are all kept.
    """
    host, path = split_url("_url")
    rule = rules.groupBy("host", "path").agg(F.min_by("verdict", F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("r_verdict")).select(
        F.concat("host", "path").alias("r_rule"), F.length("host").alias("r_host"), F.length("path").alias("r_path"), "r_verdict",
        F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("r_digest"),
    ).withColumn("r_prefix", F.substring("r_digest", 1, prefix_hex))
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        rule = F.broadcast(rule)
    # one number for each length that a rule's path has, and for each number of labels of its host: they grow with the longest, not with the rules
    def lengths(c: Column) -> Column:
        found = [r[0] for r in rules.select(c).distinct().collect() if r[0] is not None]
        return F.array(*[F.lit(n) for n in sorted(found)]).cast("array<int>")

    path_lengths, host_labels = lengths(F.length("path")), lengths(F.size(F.split("host", r"\.")))

    urls = pages.select(F.col(url_col).alias("_url")).distinct().select("_url", host.alias("_host"), path.alias("_path"))
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.filter(host_labels, lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    starts = F.transform(F.filter(path_lengths, lambda n: n <= F.length("_path")), lambda n: F.substr("_path", F.lit(1), n))
    spread = (
        urls.withColumn("_suffix", F.explode(suffixes)).withColumn("_start", F.explode(starts))
        .withColumn("_digest", F.sha2(F.concat_ws("\n", "_suffix", "_start"), 256))
    )
    hit = spread.join(rule, (F.substring("_digest", 1, prefix_hex) == F.col("r_prefix")) & (F.col("_digest") == F.col("r_digest")))
    best = hit.groupBy("_url").agg(F.max(F.struct(F.col("r_host") + F.col("r_path"), "r_host", "r_rule", "r_verdict")).alias("_best"))
    # rows without a host have no rule: they are dealt out by their id
    ruled = F.when(F.col(url_col).contains("://"), F.col(url_col)).otherwise(F.sha2(F.col(id_col).cast("string"), 256))
    judged = pages.select(F.col(id_col), F.col(url_col).alias("_url"), ruled.alias("_key"))
    return judged.join(best.withColumnRenamed("_url", "_of"), F.col("_key") == F.col("_of"), "left").select(
        id_col, host.alias("host"), path.alias("path"), F.col("_best.r_rule").alias("rule"),
        F.coalesce("_best.r_verdict", F.lit(default)).alias("verdict"),
    )
