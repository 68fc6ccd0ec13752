"""Mixing sources to target weights that change over training.

A source's schedule is its share of the mix at knots of training time (0 to 1),
linear between them. Its integral is the source's cumulative demand for words;
its documents, laid end to end in an order that only their ids decide, are
assigned the times at which demand reaches them, by the inverse of that
integral; and the mix is all documents range-sorted by those times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.running import running
from rollbook.llm.scratch import cut

SPACE = "\\x20\\x09-\\x0D"
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    """Runs of anything but space and tab to carriage return; 0 for null."""
    marked = F.regexp_replace(text, f"[^{SPACE}]+", "x")
    return F.coalesce(F.length(F.regexp_replace(marked, f"[{SPACE}]+", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source key, source_size; sources in order of key) with ``weight``, ``target`` and ``place`` (0, 1, ...).

    Weights repeat along the sources, which share ``share`` times all words; a
    target stops at ``most`` times its source's words, and what it leaves is
    shared by weight among the others until none is above. In order of what a
    source holds for its weight, the level that the sources from one on would
    share rises as long as those before it are full and then falls: its
    greatest value is the one that holds. One row a source: the windows are
    over that list alone.
    """
    place = F.row_number().over(Window.orderBy("key")) - 1
    listed = sizes.withColumn("place", place).withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.col("place") % len(weights)))
    held = listed.withColumn("_most", F.col("source_size") * most).withColumn("_ratio", F.col("_most") / F.col("weight"))
    order, everything = Window.orderBy("_ratio", "key"), Window.partitionBy()
    full = F.coalesce(F.sum("_most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = held.withColumn("_level", (F.sum("source_size").over(everything) * share - full) / open_)
    return level.withColumn("target", F.least("_most", F.max("_level").over(everything) * F.col("weight"))).drop("_most", "_ratio", "_level")


def tilted(planned: DataFrame) -> DataFrame:
    """``planned`` targets with ``knots``: each source begins above or below its mean share and ends as far on the other side.

    Sources early in order come sooner, late ones later, by as much as they
    stand before or after the mix's mean place; all shares add up to the same
    at any time, and each source's integral is its target.
    """
    every = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # sums of doubles in one order: reruns agree
    at = (F.col("place") + 0.5) / F.count("*").over(every)
    whole = F.sum("target").over(every)
    lean = F.when(whole > 0, F.sum(F.col("target") * at).over(every) / whole - at).otherwise(0.0)
    knot = lambda t, sign: F.struct(F.lit(t).alias("t"), (F.col("target") * (1 + sign * F.col("_lean"))).alias("share"))
    return planned.withColumn("_lean", lean).withColumn("knots", F.array(knot(0.0, 1), knot(1.0, -1))).drop("_lean")


def demand(planned: DataFrame) -> DataFrame:
    """``planned`` with ``spans``: from each knot to the next, the words asked for before and by its end, and the densities at both.

    Knots (t, share) ascend in t from 0 to 1, shares are not negative. They are
    scaled so that a source's integral is its target.
    """
    legs = planned.withColumn("_legs", F.transform(F.sequence(F.lit(0), F.size("knots") - 2), lambda i: F.struct(F.get("knots", i).alias("a"), F.get("knots", i + 1).alias("b"))))
    area = lambda leg: (leg["b"]["t"] - leg["a"]["t"]) * (leg["a"]["share"] + leg["b"]["share"]) / 2
    whole = legs.withColumn("_area", F.aggregate("_legs", F.lit(0.0), lambda s, leg: s + area(leg))).withColumn("_scale", F.when(F.col("_area") > 0, F.col("target") / F.col("_area")).otherwise(0.0))
    upto = lambda i: F.aggregate(F.slice("_legs", F.lit(1), i), F.lit(0.0), lambda s, leg: s + area(leg)) * F.col("_scale")
    spans = F.transform("_legs", lambda leg, i: F.struct(upto(i).alias("low"), upto(i + 1).alias("high"), leg["a"]["t"].alias("t"), (leg["b"]["t"] - leg["a"]["t"]).alias("length"), (leg["a"]["share"] * F.col("_scale")).alias("d0"), (leg["b"]["share"] * F.col("_scale")).alias("d1")))
    return whole.withColumn("spans", spans).drop("_legs", "_area", "_scale", "knots")


def time_of(words: Column, spans: Column) -> Column:
    """The time at which demand reaches ``words``: the inverse of the integral of a density linear between knots."""
    span = F.get(F.filter(spans, lambda s: words < s["high"]), F.lit(0))
    past = words - span["low"]
    slope = (span["d1"] - span["d0"]) / span["length"]
    root = F.sqrt(F.greatest(span["d0"] * span["d0"] + slope * past * 2, F.lit(0.0)))
    return F.when(past <= 0, span["t"]).otherwise(span["t"] + past * 2 / (span["d0"] + root))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0, schedule=tilted) -> DataFrame:
    """The training stream, range-sorted by ``position``: one row for each time that a document is taken.

    Columns: doc_id, size, source_size, target, taken (the document's words in
    the whole mix), repeat (0, 1, ...), words (of this time) and position (0 to
    1). A source's documents follow each other by the digest of their id,
    again and again until its target is filled; the document in which it is
    reached gives its first words only, so that a source misses its target by
    less than a word. A document that is not taken has one row with repeat 0,
    no words and a null position. ``schedule`` adds knots to the targets.
    Null and empty texts have no words; null ids come first, repeated ids
    are documents of their own; other columns are not looked at.
    """
    key = F.coalesce(F.concat(F.lit("0"), F.col(f"`{source}`").cast("string")), F.lit("1"))  # null last
    sized = cut(docs.select(key.alias("key"), F.md5(F.col(f"`{id_col}`").cast("string")).alias("place_of"), F.col(f"`{id_col}`").alias("doc_id"), n_words(F.col(f"`{text}`")).alias("size")))
    planned = cut(demand(schedule(targets(sized.groupBy("key").agg(F.sum("size").alias("source_size")), weights=weights, share=share, most=most))))
    laid = running(sized, group="key", order=["place_of", "doc_id", "size"], value="size").drop("total")
    met = laid.join(planned.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"))
    budget = F.floor(F.col("target") + 0.5)
    start = lambda r: F.col("before") + F.col("source_size") * r
    words = lambda r: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - start(r)))
    rounds = F.sequence(F.lit(0), F.lit(max(0, -int(-most // 1) - 1)))
    met = met.withColumn("_times", F.transform(rounds, lambda r: F.struct(r.alias("repeat"), words(r).alias("words"), F.when(words(r) > 0, time_of(start(r).cast("double"), F.col("spans"))).alias("position"))))
    met = met.withColumn("taken", F.aggregate("_times", F.lit(0).cast("long"), lambda s, x: s + x["words"]))
    times = F.filter("_times", lambda x: (x["repeat"] == 0) | (x["words"] > 0))
    stream = met.select("doc_id", "size", "source_size", "target", "taken", "place_of", F.inline(times))
    return stream.repartitionByRange("position", "place_of").sortWithinPartitions("position", "place_of", "doc_id", "repeat").drop("place_of")
