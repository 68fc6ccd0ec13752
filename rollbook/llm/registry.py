"""The operators' queries over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import bpe, curriculum, decontam, hardneg, langid, merkle, neardup, passages, scratch, sketch, tokenfile, toxicity, urlfilter, warc
from rollbook.llm.wordcode import default_vocabulary
from rollbook.session import table

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
END_ID = 2
WARC_DATE = "2024-01-01T00:00:00Z"


def id_remainder(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.responses(table(spark, sf_dir, "pages"), date=WARC_DATE)
    return warc.derivatives(found).withColumnRenamed("id", "page_id")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("first_id").alias("component_id"), (F.col("id") == F.col("first_id")).alias("kept"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, urlfilter.RULES_SCHEMA)
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return model.score(docs).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "tokens")
    return tokenfile.token_file(table(spark, sf_dir, "documents"), path, default_vocabulary(), end_id=END_ID)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 3) == 1
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that loses text to an earlier one, and for each that it loses it to."""
    found = passages.removed(table(spark, sf_dir, "documents").select("doc_id", "text")).where("_spans > 0")
    return found.select("doc_id", F.explode("_keepers").alias("first_doc_id"), F.col("_spans").alias("n_repeats"), (F.length("text") - F.length("_clean")).alias("chars_removed"), F.sha2("_clean", 256).alias("clean_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), default_vocabulary())


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hardneg.hard_negatives(table(spark, sf_dir, "embeddings"), anchor=F.col("vec_id") % 100 == 0, label=label)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = F.when(id_remainder("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.checked(table(spark, sf_dir, "documents"), tampered=stripped)


def op13_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: what the mix takes of it in all, and when first."""
    stream = curriculum.mix(table(spark, sf_dir, "documents"))
    return stream.where("repeat = 0").select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


OP4_SQL = """
WITH rules(rhost, rpath, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (SELECT page_id, arg_max(rhost || rpath, length(rhost) + length(rpath)) AS rule, arg_max(v, length(rhost) + length(rpath)) AS v
  FROM cut, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM cut LEFT JOIN best USING (page_id)
"""

OP11_SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS bigint) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS double)) AS bigint)) AS ints
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.ints::double[], r.ints::double[]) AS bigint) AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT * FROM (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS integer) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score) WHERE rank <= 5
"""

# crc32 by its table of 256 remainders, each of eight steps
OP12_SQL = """
WITH RECURSIVE crc_table AS (SELECT list(r ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END) AS r FROM (SELECT unnest(range(256)) AS b))),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS varchar), ''), lambda c: CAST(ascii(c) AS bigint))),
    lambda r, c: xor(r >> 8, t[1 + (xor(r, c) & 255)])), 4294967295) AS crc FROM documents, crc_table),
f AS (SELECT doc_id, source, text, concat(coalesce(strlen(CAST(doc_id AS varchar)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS varchar)) || ':' || n_chars, '-')) AS head,
    CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS found FROM documents LEFT JOIN crc USING (doc_id)),
leaves AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(found) || ':' || found, '-')) AS now FROM f),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
tree(g, level, pos, node, n) AS (SELECT g, 0, pos, leaf, n FROM placed
  UNION ALL SELECT g, max(level) + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 2) // 3 FROM tree WHERE n > 1 GROUP BY g, pos // 3),
subroots AS MATERIALIZED (SELECT g, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top(level, pos, node, n) AS (SELECT 0, pos, subroot, n FROM subroots
  UNION ALL SELECT max(level) + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY pos // 3),
root AS (SELECT node AS root FROM top WHERE n = 1),
heights AS (SELECT g, max(level) AS h FROM tree GROUP BY g),
steps AS (SELECT p.doc_id, p.g, p.pos AS leaf_at, t.level AS step, string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < x) AS lefts, string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > x) AS rights
    FROM (SELECT g, doc_id, pos, level, pos // CAST(pow(3, level) AS bigint) AS x FROM placed JOIN heights USING (g), unnest(range(h)) AS u(level)) p JOIN tree t ON t.g = p.g AND t.level = p.level AND t.pos // 3 = x // 3 GROUP BY ALL
  UNION ALL SELECT p.doc_id, p.g, p.leaf_at, h + t.level, string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < x), string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > x)
    FROM (SELECT l.g, l.doc_id, l.pos AS leaf_at, h, level, s.pos // CAST(pow(3, level) AS bigint) AS x FROM placed l JOIN heights USING (g) JOIN subroots s ON s.g = l.g, (SELECT unnest(range((SELECT max(level) FROM top))) AS level)) p JOIN top t ON t.level = p.level AND t.pos // 3 = x // 3 GROUP BY ALL),
ways AS MATERIALIZED (SELECT g, leaf_at, list(coalesce(lefts, '') ORDER BY step) AS lefts, list(coalesce(rights, '') ORDER BY step) AS rights, string_agg(coalesce(lefts, '') || coalesce(rights, ''), '' ORDER BY step) AS others FROM steps GROUP BY g, leaf_at),
fold(g, pos, step, node) AS (SELECT g, pos, 0, now FROM placed
  UNION ALL SELECT f.g, f.pos, step + 1, sha256(lefts[step + 1] || node || rights[step + 1]) FROM fold f JOIN ways w ON w.g = f.g AND w.leaf_at = f.pos WHERE step < len(lefts))
SELECT p.doc_id, leaf, subroot, root, sha256(coalesce(others, '')) AS proof_sha256, node AS folded_root, node = root AS verified
FROM placed p JOIN subroots s ON s.g = p.g CROSS JOIN root LEFT JOIN ways w ON w.g = p.g AND w.leaf_at = p.pos JOIN fold f ON f.g = p.g AND f.pos = p.pos AND f.step = coalesce(len(lefts), 0)
"""

OP13_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, coalesce('0' || source, '1') AS key, md5(CAST(doc_id AS varchar)) AS place_of, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
s AS (SELECT key, CAST(sum(size) AS bigint) AS source_size, row_number() OVER (ORDER BY key) - 1 AS place FROM d GROUP BY key),
w AS (SELECT *, [5, 2, 1][1 + place % 3] AS weight, source_size * CAST(2.0 AS double) AS most, source_size * CAST(2.0 AS double) / [5, 2, 1][1 + place % 3] AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS double) - coalesce(sum(most) OVER (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(most, max(level) OVER () * weight) AS target FROM l),
k AS (SELECT key, source_size, target, place + CAST(0.5 AS double) AS pos, count(*) OVER () AS sources, sum(target) OVER () AS everything FROM t),
n AS (SELECT *, CASE WHEN everything > 0 THEN sum(target * (pos / sources)) OVER () / everything - pos / sources ELSE 0 END AS lean FROM k),
b AS (SELECT d.*, source_size, target, target * (1 + lean) AS d0, target * (1 - lean) AS d1, CAST(coalesce(sum(size) OVER (PARTITION BY key ORDER BY place_of, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS before, CAST(floor(target + CAST(0.5 AS double)) AS bigint) AS budget FROM d JOIN n USING (key)),
x AS (SELECT *, greatest(0, least(size, budget - before)) AS now, CAST(greatest(0, least(size, budget - before)) + greatest(0, least(size, budget - before - source_size)) AS bigint) AS taken FROM b)
SELECT doc_id, size, source_size, target, taken, CASE WHEN now > 0 AND before = 0 THEN CAST(0 AS double) WHEN now > 0 THEN round(2 * before / (d0 + sqrt(greatest(d0 * d0 + (d1 - d0) * before * 2, 0))), 6) END AS position FROM x
"""


def queries() -> dict:
    return {
        "op1_warc_derivatives": op1_warc_derivatives,
        "op2_document_fingerprints": op2_document_fingerprints,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_url_filter": op4_url_filter,
        "op5_decontaminate": op5_decontaminate,
        "op6_toxicity": op6_toxicity,
        "op7_token_file": op7_token_file,
        "op8_language": op8_language,
        "op9_repeated_passages": op9_repeated_passages,
        "op10_bpe": op10_bpe,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_curriculum_mix": op13_curriculum_mix,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": OP4_SQL, "op11_hard_negatives": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_curriculum_mix": OP13_SQL}
