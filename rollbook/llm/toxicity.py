"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.scratch import cut

SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi vous votre vos ton tes du dich dir dein deine ihr euch tú ti usted ustedes vuestro".split())
LEET = str.maketrans("@$01357", "asoiest")
WORD = regex.compile(r"\p{L}+")
DISGUISED = regex.compile(r"\p{L}+[@$01357*]+\p{L}+")
SHOUTED = regex.compile(r"\b\p{Lu}{3,}\b")
NEAR = 5  # words to either side that count as close to the second person

FEATURES = (
    "lexicon_density", "lexicon_weight", "lexicon_count", "lexicon_kinds", "near_second_person", "second_person", "capitals", "shouted",
    "exclamations", "questions", "punctuation", "disguised", "disguised_lexicon", "repeats", "log_words",
)


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The dense features of one whole text; all 0 for null and empty texts."""
    if not text:
        return [0.0] * len(FEATURES)
    low = text.lower()
    words = WORD.findall(low)
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if hits and second:
        at = np.searchsorted(second, hits)
        s = np.array([-(10**9), *second, 10**9])
        near = int((np.minimum(np.array(hits) - s[at], s[at + 1] - np.array(hits)) <= NEAR).sum())
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    count = np.bincount(data, minlength=256)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum() + (data >= 192).sum()))
    marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    disguised = DISGUISED.findall(low) if count[36] + count[42] + count[64] + count[48:58].sum() else []
    repeats = int(((data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])).sum()) if len(data) > 2 else 0
    return [
        100 * len(hits) / n, 100 * sum(lexicon[words[i]] for i in hits) / n, float(np.log1p(len(hits))), float(len({words[i] for i in hits})), float(np.log1p(near)),
        100 * len(second) / n, int(count[65:91].sum()) / letters, 100 * len(SHOUTED.findall(text)) / n,
        100 * int(count[33]) / len(data), 100 * int(count[63]) / len(data), 100 * marks / len(data),
        100 * len(disguised) / n, 100 * sum(w.translate(LEET) in lexicon for w in disguised) / n, 100 * repeats / len(data), float(np.log1p(len(words))),
    ]


def feature_array(text_col: str, lexicon: dict[str, float], spark: SparkSession) -> Column:
    sent = spark.sparkContext.broadcast(lexicon)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([features(t, sent.value) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<double>")(F.col(text_col))


def learning_rows(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, bound: int) -> DataFrame:
    """About ``bound`` labelled documents of each class at most, chosen by a hash of the id, weighted back to the classes' true shares."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label"))
    sizes = known.groupBy("_label").agg(F.count("*").alias("_n"))
    draw = F.pmod(F.xxhash64("_id", F.lit(29)), F.lit(1 << 30)) / (1 << 30)
    # at most about 2 * bound ids: small enough to send to every task
    chosen = known.join(F.broadcast(sizes), "_label").where(draw * F.col("_n") < bound).select("_id", "_label", F.greatest(F.col("_n") / bound, F.lit(1.0)).alias("_weight"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return texts.join(F.broadcast(chosen), "_id")


def learn_lexicon(rows: DataFrame, *, least: int = 5, least_odds: float = 2.0, most: int = 400) -> dict[str, float]:
    """Words that toxic learning texts use far more often: log odds of the share of texts, ``most`` words at most."""
    n = {r._label: r.n for r in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if not n.get(1.0) or not n.get(0.0):
        return {}
    words = rows.select("_label", F.explode(F.array_distinct(F.split(F.lower("_text"), r"[^\p{L}]+"))).alias("word")).where("length(word) > 1")
    seen = words.groupBy("word").agg(F.count_if(F.col("_label") == 1).alias("toxic"), F.count_if(F.col("_label") == 0).alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n[1.0] + 1)) - F.log((F.col("clean") + 0.5) / (n[0.0] + 1))
    top = seen.where(F.col("toxic") >= least).withColumn("odds", odds).where(F.col("odds") >= least_odds).orderBy((F.col("odds") * F.col("toxic")).desc(), "word").limit(most)
    return {r.word: r.odds for r in top.collect()}


@dataclass
class Toxicity:
    """Fitted parts; ``share`` alone is the score where only one class was learnt."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    share: float

    def score(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Id, score (0 to 1) and predicted (1 from 0.5 on) of each whole text, in its own task.

        Null and empty texts are scored as texts without any feature; rows
        with equal or null ids are all kept; extra columns are left out.
        """
        if self.trees is None:
            score = docs.select(id_col, F.lit(self.share).alias("score"))
        else:
            dense = docs.select(F.col(id_col).alias("_id"), array_to_vector(feature_array(text_col, self.lexicon, docs.sparkSession)).alias("_features"))
            raw = self.trees.transform(dense).select("_id", vector_to_array("probability").getItem(1).alias("_raw"))
            score = self.curve.transform(raw).select(F.col("_id").alias(id_col), F.least(F.greatest(F.col("_score"), F.lit(0.0)), F.lit(1.0)).alias("score"))
        return score.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = 4000, rounds: int = 20, depth: int = 3) -> Toxicity:
    """Fit on about ``bound`` documents of each class (a documented bound on a hash-chosen sample).

    The lexicon and the trees learn from three quarters of the sample, the
    calibration curve from the rest. A sample so small that either part would
    lack a class is not parted: all of it serves both. Where one class alone
    was learnt, every score is that class's; where nothing was, 0.
    """
    rows = cut(learning_rows(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, bound=bound))
    fold = F.pmod(F.xxhash64("_id", F.lit(31)), F.lit(4)) == 0
    shares = {r._label: r.w for r in rows.groupBy("_label").agg(F.sum("_weight").alias("w")).collect()}
    if len(shares) < 2:
        return Toxicity({}, None, None, 1.0 if 1.0 in shares else 0.0)
    parted = rows.select("_label", fold.alias("_fold")).distinct().count() == 4
    learn, hold = (~F.col("_fold"), F.col("_fold")) if parted else (F.lit(True), F.lit(True))
    lexicon = learn_lexicon(rows.withColumn("_fold", fold).where(learn))
    dense = cut(rows.select("_label", "_weight", fold.alias("_fold"), array_to_vector(feature_array("_text", lexicon, docs.sparkSession)).alias("_features")).coalesce(8))
    trees = GBTClassifier(
        featuresCol="_features", labelCol="_label", weightCol="_weight", predictionCol="_class",
        maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7,
    ).fit(dense.where(learn))
    held = trees.transform(dense.where(hold)).select("_label", "_weight", vector_to_array("probability").getItem(1).alias("_raw"))
    curve = IsotonicRegression(featuresCol="_raw", labelCol="_label", weightCol="_weight", predictionCol="_score").fit(held)
    return Toxicity(lexicon, trees, curve, 0.0)
