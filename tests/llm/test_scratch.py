"""What a table written between rounds leaves behind."""

import time

from pyspark.sql import functions as F

from rollbook.llm.components import _round, components
from rollbook.llm.scratch import ROUND, cut


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffle_files_go_with_the_job(spark):
    before = _shuffle_files(spark)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert len(cut(counts).collect()) == 7
    until = time.monotonic() + 10
    while _shuffle_files(spark) - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before


def test_rounds_of_self_joins_leave_nothing_to_infer_from(spark):
    held = {k: spark.conf.get(k, None) for k in ROUND}
    rows = cut(spark.range(8).select("id", (F.col("id") % 4).alias("up")).where("up >= 0"))
    for _ in range(3):
        above = rows.select(F.col("id").alias("_id"), F.col("up").alias("top"))
        rows = cut(rows.join(above, F.col("up") == F.col("_id")).select("id", F.least("up", "top").alias("up")))
    assert rows._jdf.queryExecution().analyzed().constraints().isEmpty()
    assert sorted(map(tuple, rows.collect())) == [(i, i % 4) for i in range(8)]
    assert {k: spark.conf.get(k, None) for k in ROUND} == held


def test_a_long_path_is_one_component(spark):
    n = 300
    links = spark.range(n - 1).select((F.col("id") * 7 % n).alias("a"), ((F.col("id") + 1) * 7 % n).alias("b"))
    assert {(r.node, r.comp) for r in components(links).collect()} == {(i, 0) for i in range(n)}


def test_rounds_take_tasks_by_their_links(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components(spark.range(10).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
        assert found.rdd.getNumPartitions() == 1 and found.where("comp = 0").count() == 11
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rounds_do_not_square_the_estimated_size(spark):
    rows = _round(spark.range(9).select("id", (F.col("id") % 3).alias("up")))
    for _ in range(3):
        above = rows.select(F.col("id").alias("_id")).hint("merge")
        rows = _round(rows.join(above, F.col("up") == F.col("_id")).select("id", "up"))
    assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64
    assert sorted(map(tuple, rows.collect())) == [(i, i % 3) for i in range(9)]
