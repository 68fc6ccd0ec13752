from pyspark.sql import functions as F

from rollbook.llm import registry, toxicity

SF = "/root/testdata/sf0.1"


def test_features_of_odd_texts():
    for text in (None, "", " ", "!!!", "日本", "a" * 50000):
        f = toxicity.features(text, {"bad": 1.0})
        assert len(f) == len(toxicity.FEATURES) and all(x == x for x in f)
    f = dict(zip(toxicity.FEATURES, toxicity.features("You are BAD bad b@d, really!", {"bad": 2.0}), strict=True))
    assert f["lexicon_count"] > 0 and f["near_second_person"] > 0 and f["shouted"] > 0 and f["disguised_lexicon"] > 0 and f["exclamations"] > 0


def test_one_class_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.train(docs, labels).score(docs).collect()} == {(0.0, 0)}
    assert toxicity.train(docs, labels.limit(0)).score(docs).count() == 4
    assert toxicity.train(docs, labels).score(docs.limit(0)).count() == 0


def test_few_rows_of_every_split(spark):
    """One to six labelled rows, in the calibration part or not: no table is too small or lies wrong."""
    ids = range(200)
    fold = {r.i: r.f for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", (F.pmod(F.xxhash64("i", F.lit(31)), F.lit(4)) == 0).alias("f")).collect()}
    inside, outside = [i for i in ids if fold[i]], [i for i in ids if not fold[i]]
    docs = spark.createDataFrame([(i, f"you are bad number {i}!" if i % 2 else f"fine words {i}", 7, "x") for i in ids] + [(None, None, 1, "y")], "doc_id long, text string, _label int, _features string")
    for chosen in (outside[:2], inside[:2], inside[:6], outside[:6], inside[:1] + outside[:1], inside[:3] + outside[:3], outside[:1]):
        labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(chosen)], "doc_id long, toxic int")
        got = toxicity.train(docs, labels, rounds=2).score(docs).collect()
        assert len(got) == 201 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        if len(chosen) > 1:
            assert len({r.score for r in got}) >= 1


def test_held_out_ranking_and_calibration(spark):
    got = registry.op6_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out AND toxic IS NOT NULL")
    rows = [(r.score, r.toxic) for r in got.select("score", "toxic").collect()]
    bad, good = [s for s, t in rows if t == 1], [s for s, t in rows if t == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good))
    assert len(bad) > 10 and wins > 0.9
    assert abs(sum(s for s, _ in rows) / len(rows) - len(bad) / len(rows)) < 0.05
    assert got.where((F.col("score") < 0) | (F.col("score") > 1) | (F.col("predicted") != (F.col("score") >= 0.5).cast("int"))).count() == 0
