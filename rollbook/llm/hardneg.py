"""Hard negatives by a vector-approximation file.

Each dimension of a vector is quantised into cells; the file holds a byte a
dimension. For an anchor, a table of each dimension's cells gives the least and
the greatest product that a component in that cell can have, and a sum of
table entries bounds a vector's score from both sides. Only vectors whose
bounds leave them a place among the first few, or in a window of scores, are
scored exactly.

File and anchors meet in blocks of bounded size, each pair of blocks in a task
of its own, and each gives its first few alone: nothing grows with a label, a
common vector or the number of anchors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.scratch import cut

CELLS = 64
ROWS, MOST_ROWS = 1024, 65536  # vectors in a block
ANCHORS, MOST_ANCHORS = 256, 8192  # anchors in a block
AT_ONCE = 1 << 20  # pairs of vector and anchor whose bounds are held at a time
NEAR = "anchor_id long, vec_id long, score long"
FOUND = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def sound(vector: Column) -> Column:
    """Whether all components are there and finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


class Cells:
    """Bounds of each dimension's cells: of equal width from the least to the greatest component of all rows."""

    def __init__(self, low: Sequence[int], high: Sequence[int], cells: int = CELLS):
        self.low = np.array(low, np.int64)
        self.width = np.maximum(1, -(-(np.array(high, np.int64) - self.low + 1) // cells))
        self.n = cells

    def column(self, ints: Column) -> Column:
        low, width = (F.array(*[F.lit(int(x)) for x in a]) for a in (self.low, self.width))
        return F.transform(ints, lambda x, i: F.floor((x - F.get(low, i)) / F.get(width, i)).cast("tinyint"))

    def tables(self, d: int, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest product of dimension ``d`` for each cell and anchor."""
        first = self.low[d] + np.arange(self.n, dtype=np.int64) * self.width[d]
        a, b = first[:, None] * anchors[None, :, d], (first + self.width[d] - 1)[:, None] * anchors[None, :, d]
        return np.minimum(a, b), np.maximum(a, b)

    def bounds(self, cells: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of rows (down) and anchors (across)."""
        low = np.zeros((len(cells), len(anchors)), np.int64)
        high = np.zeros_like(low)
        for d in range(cells.shape[1]):
            least, most = self.tables(d, anchors)
            low += least[cells[:, d]]
            high += most[cells[:, d]]
        return low, high


def _matrix(block: pa.Table, name: str, d: int) -> np.ndarray:
    return block.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _kth(low: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each column; below all for fewer."""
    return np.partition(low, len(low) - k, axis=0)[len(low) - k] if len(low) >= k else np.full(low.shape[1], np.iinfo(np.int64).min)


def _first(order: Sequence[np.ndarray], k: int) -> np.ndarray:
    """Places of the first ``k`` of each group: groups by the first key, order by all."""
    at = np.lexsort(tuple(reversed(order)))
    group = order[0][at]
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(at) else at
    rank = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)])) if len(at) else at
    return at[rank < k]


def _scores(rows: np.ndarray, anchors: np.ndarray, r: np.ndarray, a: np.ndarray) -> np.ndarray:
    step = max(1, AT_ONCE // max(1, rows.shape[1]))
    return np.concatenate([np.zeros(0, np.int64), *[np.einsum("ij,ij->i", rows[r[i : i + step]], anchors[a[i : i + step]]) for i in range(0, len(r), step)]])


def _by_label(rows: pa.Table, anchors: pa.Table, d: int, other: bool) -> Iterator[tuple]:
    """Rows that an anchor's label admits, with the anchors of that label, a bounded number of pairs at a time."""
    r_label, a_label = rows.column("label").to_numpy(), anchors.column("label").to_numpy()
    r_id, a_id = rows.column("vec_id").to_numpy(), anchors.column("vec_id").to_numpy()
    cells, ints, query = _matrix(rows, "cells", d), _matrix(rows, "ints", d), _matrix(anchors, "ints", d)
    for label in np.unique(a_label):
        mine, theirs = np.flatnonzero(a_label == label), np.flatnonzero((r_label != label) if other else (r_label == label))
        if not len(theirs):
            continue
        step = max(1, AT_ONCE // len(theirs))
        for i in range(0, len(mine), step):
            part = mine[i : i + step]
            yield part, a_id[part], query[part], r_id[theirs], cells[theirs], ints[theirs]


def _meet(file: DataFrame, anchors: DataFrame, scan, schema: str) -> DataFrame:
    """Every block of the file with every block of anchors, one pair a task's call."""
    n, m = file.count(), anchors.count()
    rows = min(MOST_ROWS, max(ROWS, n // 64))
    each = min(MOST_ANCHORS, max(ANCHORS, m // 64))
    g, j = max(1, -(-n // rows)), max(1, -(-m // each))
    left = file.withColumn("_g", F.pmod(F.xxhash64("vec_id"), F.lit(g))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(j - 1)).cast("array<bigint>")))
    right = anchors.withColumn("_j", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(j))).withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(g - 1)).cast("array<bigint>")))
    return left.groupBy("_g", "_j").cogroup(right.groupBy("_g", "_j")).applyInArrow(scan, schema)


def nearest(file: DataFrame, anchors: DataFrame, cells: Cells, *, k: int) -> DataFrame:
    """The first ``k`` other rows of each anchor's label by score, ties by smaller id."""
    d = len(cells.low)

    def scan(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        if rows.num_rows and queries.num_rows:
            for _, a_id, query, r_id, codes, ints in _by_label(rows, queries, d, other=False):
                low, high = cells.bounds(codes, query)
                self = r_id[:, None] == a_id[None, :]
                low[self] = np.iinfo(np.int64).min
                r, a = np.nonzero((high >= _kth(low, k)) & ~self)
                score = _scores(ints, query, r, a)
                best = _first([a, -score, r_id[r]], k)
                for col, x in zip(out, (a_id[a[best]], r_id[r[best]], score[best]), strict=True):
                    col.append(x)
        return pa.table(dict(zip(("anchor_id", "vec_id", "score"), map(np.concatenate, out), strict=True)))

    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    return _meet(file, anchors, scan, NEAR).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def in_windows(file: DataFrame, anchors: DataFrame, cells: Cells, *, k: int, low_percent: int) -> DataFrame:
    """The first ``k`` rows of other labels whose score lies from ``low_percent`` hundredths of a positive's to all of it, for each anchor and positive (``positives``: array of vec_id, score)."""
    d = len(cells.low)
    never = np.iinfo(np.int64).min

    def scan(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] for _ in range(5)]
        if rows.num_rows and queries.num_rows:
            held = queries.column("positives").to_pylist()
            for part, a_id, query, r_id, codes, ints in _by_label(rows, queries, d, other=True):
                low, high = cells.bounds(codes, query)
                places = max(len(held[i]) for i in part)
                ids, tops = np.zeros((2, places, len(part)), np.int64)
                there = np.zeros((places, len(part)), bool)
                for x, i in enumerate(part):
                    for p, positive in enumerate(held[i]):
                        ids[p, x], tops[p, x], there[p, x] = positive["vec_id"], positive["score"], True
                maybe = np.zeros(low.shape, bool)
                for p in range(places):
                    sure = np.where((100 * low >= low_percent * tops[p]) & (high <= tops[p]), low, never)
                    maybe |= there[p] & (100 * high >= low_percent * tops[p]) & (low <= tops[p]) & (high >= _kth(sure, k))
                r, a = np.nonzero(maybe)
                score = _scores(ints, query, r, a)
                for p in range(places):
                    fits = np.flatnonzero(there[p][a] & (100 * score >= low_percent * tops[p][a]) & (score <= tops[p][a]))
                    best = fits[_first([a[fits], -score[fits], r_id[r[fits]]], k)]
                    for col, x in zip(out, (a_id[a[best]], ids[p][a[best]], tops[p][a[best]], r_id[r[best]], score[best]), strict=True):
                        col.append(x)
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"), map(np.concatenate, out), strict=True)))

    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return _meet(file, anchors, scan, FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def approximated(rows: DataFrame, *, k: int, cells: int = CELLS) -> tuple[DataFrame, Cells | None]:
    """The file: vec_id, label, ints (padded with zeros to one length) and cells; without rows, no cells.

    Of rows with equal label and vector the first ``k`` + 1 by id are held:
    they score alike and tie by id, so no later one is ever among the first
    ``k`` of its label or of others.
    """
    copies = Window.partitionBy("_hash", "label", "ints").orderBy("vec_id")
    held = cut(rows.withColumn("_hash", F.xxhash64("label", "ints")).withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k + 1).select("vec_id", "label", "ints"))
    spans = held.select(F.posexplode("ints").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("d").collect()  # a row a dimension
    if held.isEmpty():
        return held, None
    # zeros that pad shorter vectors lie in the cells too; empty vectors alone are padded to one zero
    low, high = [min(0, s.low) for s in spans] or [0], [max(0, s.high) for s in spans] or [0]
    of = Cells(low, high, cells)
    most = max(*map(abs, low), *map(abs, high))
    if 100 * len(low) * (most + int(of.width.max())) ** 2 >= 1 << 63:
        raise ArithmeticError(f"scores of components up to {most} pass 64 bits")
    padded = _padded(F.col("ints"), len(low))
    return cut(held.select("vec_id", "label", padded.alias("ints")).withColumn("cells", of.column(F.col("ints")))), of


def _padded(ints: Column, d: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.coalesce(F.get(ints, i), F.lit(0).cast("long")))


def hard_negatives(vectors: DataFrame, *, anchor: Column, label: Column | str = "label", vector: str = "embedding", id_col: str = "vec_id", scale: int = 256, positives: int = 5, negatives: int = 5, low_percent: int = 80, cells: int = CELLS) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels scoring in the window.

    Scores are inner products of components scaled and floored, higher first,
    ties by smaller id. The window of a positive score s is from
    ``low_percent`` hundredths of s to s; a negative s has none. Rows with a
    null id, label or vector, or a component that is null or not finite, take
    no part. A vector shorter than the longest counts as ended by zeros.
    An id is one row: of repeated ids the least label and vector stands.
    Components so great that a score would not fit 64 bits are an error.
    No anchors, positives or negatives: no rows. Other columns are not looked at.
    """
    given = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(f"`{vector}`").alias("_v"), anchor.alias("_anchor"))
    rows = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound(F.col("_v"))).select("vec_id", "label", scaled(F.col("_v"), scale).alias("ints"), "_anchor")
    one = cut(rows.withColumn("_n", F.row_number().over(Window.partitionBy("vec_id").orderBy("label", "ints"))).where("_n = 1").drop("_n"))
    file, of = approximated(one, k=max(positives, negatives), cells=cells)
    if of is None:
        empty = one.sparkSession.createDataFrame([], FOUND)
        return empty.withColumn("rank", F.lit(1))
    anchors = cut(one.where("_anchor").select("vec_id", "label", _padded(F.col("ints"), len(of.low)).alias("ints")))
    near = nearest(file, anchors, of, k=positives)
    held = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "score"))).alias("positives"))
    asking = cut(anchors.join(held, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"))
    return in_windows(file, asking, of, k=negatives, low_percent=low_percent)
