"""Document fingerprints: threshold-scaled sketches of word shingles, by Spark's own functions alone.

The sketch of a text is the set of its distinct 64-bit shingle hashes that lie
in a fixed fraction of the hash range. Whether a hash is kept depends on that
hash alone, so the sketch of two texts put together is the union of theirs,
and a short text's share in a long one can be estimated as well as two equals'
likeness. Words are runs of other characters than space and tab to carriage
return, with A-Z as a-z; a text of fewer words than a shingle is one shingle.

A text that keeps no hash (a short one by chance) has the hash of its whole
word sequence, marked ``=``, as fingerprint, so equal texts still have equal
fingerprints and meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.scratch import cut

WIDTH = 5  # words in a shingle
FRACTION = 8  # one of so many hashes is kept
BUCKETS = 16  # runs of consecutive documents for each shuffle partition

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    words = F.split(F.translate(text, _UPPER, _LOWER), "[ \\t-\\r]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` words (of all words if fewer), in order and with repeats; none for no words."""
    whole = F.array(F.xxhash64(hashes))
    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
    return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).when(F.size(hashes) < width, whole).otherwise(runs)


def sketch(text: Column, *, width: int = WIDTH, fraction: int = FRACTION) -> Column:
    """Struct of ``kept`` (sorted distinct hashes below the threshold) and ``whole`` (hash of the whole word sequence; null without words)."""
    # the transforms below bind their argument, so the words are hashed once
    limit = F.lit(-(1 << 63) + (1 << 64) // fraction - 1)
    return F.transform(
        F.array(word_hashes(F.coalesce(text, F.lit("")))),
        lambda h: F.struct(
            F.array_sort(F.array_distinct(F.filter(shingle_hashes(h, width), lambda x: x <= limit))).alias("kept"),
            F.when(F.size(h) > 0, F.xxhash64(h)).alias("whole"),
        ),
    )[0]


def fingerprint(s: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal, or ``=`` and the whole sequence's hash where none was kept."""
    return F.when(F.size(s["kept"]) > 0, F.array_join(F.transform(s["kept"], lambda x: F.lower(F.hex(x))), ",")).otherwise(F.concat(F.lit("="), F.coalesce(F.lower(F.hex(s["whole"])), F.lit(""))))


def _common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a["kept"], b["kept"]))


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the share of shingles in both among those in either. Where neither kept a hash: 1 for equal word sequences, else 0."""
    return F.transform(
        F.array(F.struct(_common(a, b).alias("both"), (F.size(a["kept"]) + F.size(b["kept"])).alias("all"))),
        lambda n: F.when(n["all"] > 0, n["both"] / (n["all"] - n["both"])).otherwise(a["whole"].eqNullSafe(b["whole"]).cast("double")),
    )[0]


def containment(a: Column, b: Column) -> Column:
    """Estimate of the share of a's shingles that b has; null where a kept none."""
    return F.when(F.size(a["kept"]) > 0, _common(a, b) / F.size(a["kept"]))


def merged(sketches: DataFrame, by: list[str], kept: str = "kept") -> DataFrame:
    """The sketch of each group's texts put together: the union of their hashes, combined map-side."""
    return sketches.select(*by, F.explode(kept).alias("_h")).distinct().groupBy(*by).agg(F.array_sort(F.collect_list("_h")).alias(kept))


def _buckets(docs: DataFrame, id_col: str) -> tuple[Column, list]:
    """A column that numbers runs of consecutive ids, and the ids at which all runs but the first begin.

    Ids whose hash falls in a fixed share are the borders: some for each
    shuffle partition, so their number grows with the partitions alone and
    reaches the driver as a range partitioner's sample does.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"))
    wanted = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = max(1, rows.count() // wanted)
    borders = sorted(r.id for r in rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(step)) == 0).distinct().collect())
    if not borders:
        return F.lit(0), borders
    # halving: each step asks whether the border so far ahead is still at or below the id
    steps = [1 << b for b in reversed(range(len(borders).bit_length()))]
    list_ = F.lit(borders)
    found = F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when(F.get(list_, at + s - 1) <= F.col(id_col), at + s).otherwise(at))
    return found, borders


def with_next(docs: DataFrame, columns: dict[str, Column], *, id_col: str) -> DataFrame:
    """``docs`` with ``columns``, and a struct ``next`` of those of the document with the next id, the first after the last.

    One shuffle, by runs of consecutive ids; a run's last document gets the
    next run's first from a second reading of those border documents alone.
    Null ids come first; rows with equal ids follow each other by text hash.
    """
    bucket, borders = _buckets(docs, id_col)
    order, tie = F.struct(*[F.col(c) for c in columns]), F.xxhash64(*[c for c in docs.columns if c != id_col])
    rows = docs.withColumns({"_tie": tie, "_bucket": bucket, "_extra": F.lit(0)}).withColumns(columns)
    least = F.coalesce(F.min(F.when(F.col(id_col).isNull(), F.lit(True))), F.lit(False)).alias("nulls"), F.min(id_col).alias("id")
    first = docs.agg(*least).first()
    spark = docs.sparkSession
    # what follows each run: the row at the border after it, and after the last run the table's first
    heads = [(i, b) for i, b in enumerate(borders)] + [(len(borders), None if first.nulls else first.id)]
    id_type = docs.schema[id_col].dataType.simpleString()
    ahead = spark.createDataFrame(heads, f"_run int, _border {id_type}")
    whole = F.struct(*[F.col(c) for c in docs.columns])
    firsts = docs.join(F.broadcast(ahead), F.col(id_col).eqNullSafe(F.col("_border"))).groupBy("_run").agg(F.min_by(whole, tie).alias("_own"))
    extra = firsts.select("_own.*", F.col("_run").alias("_bucket"), F.lit(1).alias("_extra")).withColumns({"_tie": tie, **columns})
    both = rows.unionByName(extra, allowMissingColumns=True)
    run = Window.partitionBy("_bucket").orderBy("_extra", F.col(id_col).asc_nulls_first(), "_tie")
    return both.withColumn("next", F.lead(order).over(run)).where("_extra = 0").drop("_bucket", "_extra", "_tie")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, fraction: int = FRACTION) -> DataFrame:
    """Each whole text's fingerprint, that of its edited text, and their likeness.

    The edited text has its last quarter (floor of the code points / 4)
    replaced by as much of the next document's beginning (all, if shorter);
    next is by ascending id, and the first after the last. Rows: the id,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next`` (likeness to the edited text and to the
    next document), ``held_edited`` and ``held_next`` (share of its shingles
    in those; null where it kept no hash). A null text counts as empty;
    repeated rows, equal ids (ordered by text hash) and null ids (first) are
    all kept; other columns of ``docs`` are left out; no rows give no rows.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(own, {"text": F.col("text"), "sketch": sketch(F.col("text"), width=width, fraction=fraction)}, id_col="id")
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - quarter), F.substr(F.col("next.text"), F.lit(1), quarter))
    rows = rows.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), width=width, fraction=fraction))
    a, e, n = F.col("sketch"), F.col("edited_sketch"), F.col("next.sketch")
    return rows.select(
        F.col("id").alias(id_col), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(a).alias("fingerprint"), fingerprint(e).alias("edited_fingerprint"),
        likeness(a, e).alias("near_edited"), likeness(a, n).alias("near_next"), containment(a, e).alias("held_edited"), containment(a, n).alias("held_next"),
    )
