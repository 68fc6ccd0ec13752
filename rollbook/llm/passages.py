"""Substring dedup: paragraphs that repeat across documents, by MinHash banding.

A paragraph is a line of a text. Each has a short MinHash signature cut into
bands; paragraphs that share a band are joined, their exact Jaccard likeness is
verified, and links are gathered into components.

Texts are looked at again whatever their line breaks, so that a passage set in
the midst of different words or wrapped otherwise is found too: every window of
``SEED + EVERY - 1`` words is a paragraph as well, with one band of one
coordinate, the least hash of its ``SEED``-word shingles. Neighbouring windows
mostly have the same one, so a text is posted under one seed for every nine
words or so. Texts that share ``SEED + EVERY - 1`` words in a row share a seed;
two passages of 50 words or more within the threshold do, as no more edits fit.
A seed is widened to the passage around it, over edits, and the passage's
Jaccard likeness is verified. Seeds whose first document has them among other
words are sought again by all windows that hold them.

Of a component or a seed, the document with the least id keeps its text; the
others lose it. Texts equal as a whole are told by their hash alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm import scratch, workers
from rollbook.llm.components import merge_join
from rollbook.llm.linking import link
from rollbook.llm.neardup import SEND_NODES, _confirmed as confirmed, _shared_sizes as shared_sizes
from rollbook.llm.scratch import cut
from rollbook.llm.words import Runs, Words, blocks, distinct, mix

WIDTH = 5  # words in a shingle
PERCENT = 80  # likeness of paragraphs that are copies
SHORTEST = 24  # words in the shortest line that is a paragraph: briefer ones repeat innocently
PASSAGE = 24  # words in the shortest repeat within other words
SEED, EVERY = 8, 17  # words; two texts that share 24 words in a row share a seed
GAP = 12  # words that an edit within a passage may change at most
ROWS = 2  # coordinates in a band: at the threshold a band is shared with probability 0.64
REACH = 64  # words on either side of a found passage that are held against the keeper's text
BANDS = 10  # bands of a line: of pairs at the threshold, all but one in 27,000 share one

SEEDS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("node", T.LongType())]))
LINES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]))


def _least_places(values: np.ndarray, first: np.ndarray, ends: np.ndarray, span: int) -> np.ndarray:
    """The places that hold the least value of some ``span`` neighbouring ones (the first of equals), within each run from ``first`` to ``ends``."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(1, int(n).bit_length()))
    held = (values >> bits << bits) | np.arange(n, dtype=np.uint64)
    least, have = held, 1
    while have * 2 <= min(span, n):
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    rest = min(span, n) - have
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    # windows that begin in a run and end in it
    mark = np.zeros(n + 1, np.int32)
    long = ends - first >= span
    np.add.at(mark, first[long], 1)
    np.add.at(mark, ends[long] - span + 1, -1)
    found = [least[np.cumsum(mark)[: len(least)] > 0]]
    brief = ~long & (ends > first)
    found.append(np.array([held[a:z].min() for a, z in zip(first[brief], ends[brief], strict=True)], np.uint64))
    places = np.concatenate(found) & ((np.uint64(1) << bits) - np.uint64(1))
    return np.unique(places).astype(np.int64)


class Units:
    """Lines and seeds of a block of texts; words are counted through the block."""

    def __init__(self, texts: list[bytes], seeds: bool = True):
        self.words = words = Words(texts)
        self.runs = Runs(words.hashes)
        breaks = np.flatnonzero(words.data == 10)
        cuts = np.unique(np.concatenate([words.first, np.searchsorted(words.starts, breaks)]))
        firsts, ends = cuts[:-1], cuts[1:]
        long = ends - firsts >= SHORTEST
        self.firsts, self.ends = firsts[long], ends[long]
        self.line_text = np.searchsorted(words.first, self.firsts, side="right") - 1
        # an empty text begins where the next one does; the last of equal beginnings holds the words
        self.line_node = self.runs.spans(self.firsts, self.ends).view(np.int64)
        self.shingles = self.runs.all(WIDTH)
        if seeds:
            nodes = self.runs.all(SEED)
            first, upto = words.first[:-1], np.maximum(words.first[1:] - SEED + 1, words.first[:-1])
            self.seeds = _least_places(nodes, np.minimum(first, len(nodes)), np.minimum(upto, len(nodes)), EVERY)
            self.seed_node = nodes[self.seeds].view(np.int64)
            self.seed_text = np.searchsorted(words.first, self.seeds, side="right") - 1

    def bands(self) -> np.ndarray:
        """The bands of each line."""
        out = np.zeros((len(self.firsts), BANDS), np.uint64)
        if len(self.firsts):
            edges = np.stack([self.firsts, self.ends - WIDTH + 1], 1).ravel()
            values = np.append(self.shingles, np.uint64(0xFFFFFFFFFFFFFFFF))
            for b in range(BANDS):
                two = []
                for c in (2 * b, 2 * b + 1):
                    salt = mix(np.array([c + 1], np.uint64))[0]
                    x = (values ^ salt) * (mix(np.array([salt], np.uint64))[0] | np.uint64(1))
                    x ^= x >> np.uint64(32)
                    x *= np.uint64(0xBF58476D1CE4E5B9)
                    x[-1] = np.uint64(0xFFFFFFFFFFFFFFFF)
                    two.append(np.minimum.reduceat(x, edges)[::2])
                out[:, b] = mix(mix(two[0] + np.uint64(b)) + two[1])
        return out.view(np.int64)


def _lists(which: np.ndarray, texts: int) -> pa.Array:
    """Where each text's entries begin and end, as offsets."""
    return pa.array(np.searchsorted(which, np.arange(texts + 1)).astype(np.int32))


def units(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """One row for each document: id, ``t`` (hash of the text), ``words``, its ``seeds`` (start, node) and its ``lines`` (start, end, node, bands)."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("_text"))
    schema = T.StructType([source.schema["id"], T.StructField("t", T.LongType()), T.StructField("words", T.IntegerType()), T.StructField("seeds", SEEDS), T.StructField("lines", LINES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.free()
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                for at, held in blocks(batch.column(2).to_pylist()):
                    u, n = Units(held), len(held)
                    base = u.words.first
                    seeds = pa.StructArray.from_arrays([pa.array((u.seeds - base[u.seed_text]).astype(np.int32)), pa.array(u.seed_node)], ["start", "node"])
                    own = base[u.line_text]
                    bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(u.firsts) + 1, BANDS, dtype=np.int32)), pa.array(u.bands().ravel()))
                    lines = pa.StructArray.from_arrays([pa.array((u.firsts - own).astype(np.int32)), pa.array((u.ends - own).astype(np.int32)), pa.array(u.line_node), bands], ["start", "end", "node", "bands"])
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(np.diff(base).astype(np.int32)),
                        pa.ListArray.from_arrays(_lists(u.seed_text, n), seeds), pa.ListArray.from_arrays(_lists(u.line_text, n), lines),
                    ], names=schema.names)

    return source.mapInArrow(run, schema)


def _texts_of(docs: DataFrame, keys: DataFrame, *, text_col: str, others: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``docs`` as ``row`` with ``_t``, the hash of their text, that are among ``keys`` (t), and the others.

    Up to ``SEND_NODES`` keys are sent to every task, so that the other texts
    are never shuffled; with more of them all rows are among the first, and
    the join that follows parts them.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text_col).alias("_t"))
    known = cut(keys.select(F.col("t").alias("_known")).distinct())
    if known.count() > SEND_NODES:
        return keyed, None
    on = F.col("_t") == F.col("_known")
    return keyed.join(F.broadcast(known), on, "left_semi"), keyed.join(F.broadcast(known), on, "left_anti") if others else None


def _sets_of(docs: DataFrame, wanted: DataFrame, *, text_col: str) -> DataFrame:
    """``node`` and whole shingle set of the ``wanted`` (node, t) lines, read again from the documents that hold them."""
    keys = cut(wanted.groupBy("t").agg(F.collect_list("node").alias("nodes")))
    held, _ = _texts_of(docs, keys, text_col=text_col)
    source = merge_join(held, keys, F.col("_t") == F.col("t")).select(F.col("row")[text_col].alias("_text"), "nodes")
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.free()
        for whole in batches:
            for low in range(0, whole.num_rows, 200):
                batch = whole.slice(low, 200)
                asked = [np.array(x, np.int64) for x in batch.column(1).to_pylist()]
                for at, held in blocks(batch.column(0).to_pylist()):
                    u = Units(held, seeds=False)
                    mine = np.flatnonzero(np.isin(u.line_node, np.concatenate(asked[at : at + len(held)])))
                    mine = np.array([i for i in mine if u.line_node[i] in asked[u.line_text[i] + at]], np.int64)
                    if len(mine):
                        sizes = u.ends[mine] - u.firsts[mine] - WIDTH + 1
                        begins = np.concatenate([[0], np.cumsum(sizes)])
                        values = u.shingles[np.arange(begins[-1]) - np.repeat(begins[:-1] - u.firsts[mine], sizes)]
                        hashes, begins = distinct(values, begins)
                        yield pa.RecordBatch.from_arrays([pa.array(u.line_node[mine]), pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=schema.names)

    return source.mapInArrow(run, schema)


def _line_links(docs: DataFrame, lines: DataFrame, *, text_col: str, percent: int) -> DataFrame:
    """The component of each line (node, t, bands) that is like another: joined by bands, verified on whole sets."""
    def listed(posts: DataFrame) -> DataFrame:
        shared = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").withColumnRenamed("token", "_token")
        return merge_join(posts, shared, F.col("token") == F.col("_token")).drop("_token")

    posts = cut(listed(lines.select("node", F.explode("bands").alias("token"))).drop("df"))
    met = posts.select(F.col("node").alias("_met")).distinct()
    wanted = cut(merge_join(lines.select("node", "t"), met, F.col("node") == F.col("_met"), "left_semi"))
    sets = cut(_sets_of(docs, wanted, text_col=text_col).dropDuplicates(["node"]))
    # lines that share too few shingles with all others can't be like any
    sizes = merge_join(sets.select("node", F.size("hashes").cast("long").alias("n")), shared_sizes(sets), F.col("node") == F.col("_of"), "left").select(F.col("node").alias("_node"), "n", (F.col("n") - F.coalesce("_alone", F.lit(0))).alias("s"))
    sized = merge_join(posts, sizes.where(F.col("s") * 100 >= F.col("n") * percent), F.col("node") == F.col("_node")).select("token", "node", "n", "s")
    posts = cut(listed(sized))
    # the commoner a line's bands, the more typical it is of a group of copies
    weights = posts.groupBy(F.col("node").alias("_node")).agg(F.sum("df").alias("weight"))
    posts = cut(merge_join(posts, weights, F.col("node") == F.col("_node")).drop("_node"))
    return link(posts, sets, confirmed(sets, percent), percent=percent)[1]


def _own(keeper: str) -> Column:
    """Whether a document (id, t) keeps the text itself: it has the keeper's id, and among null ids its text."""
    return F.col("id").eqNullSafe(F.col(f"{keeper}.id")) & (F.col("id").isNotNull() | (F.col("t") == F.col(f"{keeper}.t")))


def _order() -> Column:
    """Documents by id, nulls last, then by their texts' hashes."""
    return F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("t").alias("t"))


def _of_lines(docs: DataFrame, found: DataFrame, *, text_col: str, percent: int) -> DataFrame:
    """Repeated lines (id, t, start, end, passage, first_id)."""
    held = found.select("id", "t", F.inline("lines"))
    # each line under each of its bands once, whatever the number of its copies
    lines = cut(held.groupBy("node").agg(F.min("t").alias("t"), F.min_by("bands", "t").alias("bands"), F.max("t").alias("t1"), F.min(_order()).alias("first")))
    linked = _line_links(docs, lines.select("node", "t", "bands"), text_col=text_col, percent=percent)
    known = linked.select(F.col("node").alias("_node"), "comp")
    of_comp = merge_join(lines.select("node", "first"), known, F.col("node") == F.col("_node")).groupBy("comp").agg(F.min("first").alias("first"))
    of_linked = merge_join(known, of_comp.withColumnRenamed("comp", "_comp"), F.col("comp") == F.col("_comp")).select("_node", "first")
    alone = merge_join(lines.where("t <> t1").select("node", "first"), linked.select(F.col("node").alias("_linked")), F.col("node") == F.col("_linked"), "left_anti")
    several = alone.select(F.col("node").alias("_node"), "first").unionAll(of_linked)
    hit = merge_join(held.select("id", "t", "start", "end", "node"), several, F.col("node") == F.col("_node"))
    return cut(hit.where(~_own("first")).select("id", "t", "start", "end", F.lit(False).alias("passage"), F.col("first.id").alias("first_id")))


def _of_copies(found: DataFrame) -> DataFrame:
    """Whole texts of ``PASSAGE`` words or more that an earlier document has as they are."""
    texts = found.where(F.col("words") >= PASSAGE).select("id", "t", "words")
    first = texts.groupBy(F.col("t").alias("_t")).agg(F.min(_order()).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    hit = merge_join(texts, first, F.col("t") == F.col("_t")).where(~_own("first"))
    return cut(hit.select("id", "t", F.lit(0).alias("start"), F.col("words").alias("end"), F.lit(True).alias("passage"), F.col("first.id").alias("first_id")).distinct())


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Units of texts that an earlier document holds as well.

    Rows: ``id``, ``t`` (hash of the text), ``start`` and ``end`` (words of
    the whole text), ``passage`` (false for whole lines) and ``first_id``, the
    id of the document that keeps the unit's component: the smallest, null
    where all are null. Repeats within a text or among texts of one id,
    passages under ``PASSAGE`` words, and null and empty texts have none; rows
    equal in id and text count as one document.
    """
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)
    path = scratch.new_path(spark, "units")
    units(docs, id_col=id_col, text_col=text_col).write.parquet(path)
    found = spark.read.parquet(path)
    copies = _of_copies(found)
    of_lines = _of_lines(docs, found, text_col=text_col, percent=percent)
    held = _in_several(found.select("id", "t", F.inline("seeds")))
    scratch.drop_path(spark, path)
    wide = _widened(docs, _runs(held, SEED), id_col=id_col, text_col=text_col, percent=percent)
    # the first document may hold a seed among other words than those that later ones share
    failed = wide.where("NOT passage").select(F.col("t").alias("_t"), F.col("start").alias("a"), F.col("end").alias("z"))
    doubtful = merge_join(held, failed, (F.col("t") == F.col("_t")) & F.col("start").between(F.col("a"), F.col("z"))).select(F.col("node").alias("_node")).distinct()
    again = cut(merge_join(held, doubtful, F.col("node") == F.col("_node"), "left_semi"))
    wider = _widened(docs, _runs(_in_several(_windows_of(docs, again, text_col=text_col)), SEED + EVERY - 1), id_col=id_col, text_col=text_col, percent=percent)
    return copies.unionAll(of_lines).unionAll(wide.where("passage")).unionAll(wider.where("passage"))


def _in_several(seeds: DataFrame) -> DataFrame:
    """Those of the seeds (id, t, start, node) that more than one text has."""
    shared = seeds.groupBy("node").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).where("t0 <> t1").select(F.col("node").alias("_node"))
    return cut(merge_join(seeds, shared, F.col("node") == F.col("_node")).drop("_node"))


def _windows_of(docs: DataFrame, seeds: DataFrame, *, text_col: str) -> DataFrame:
    """All windows of ``SEED + EVERY - 1`` words that hold one of the seeds (id, t, start), as seeds in their turn."""
    size = SEED + EVERY - 1
    asked = cut(seeds.groupBy("t").agg(F.collect_set("start").alias("starts")))
    held, _ = _texts_of(docs, asked, text_col=text_col)
    source = merge_join(held, asked, F.col("_t") == F.col("t")).select("t", F.col("row")[text_col].alias("_text"), "starts")
    schema = seeds.select("t", "start", "node").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.free()
        for whole in batches:
            for low in range(0, whole.num_rows, 200):
                batch = whole.slice(low, 200)
                which, places, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for i, (text, starts) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    runs = Runs(Words([text.encode("utf-8", "replace")]).hashes)
                    at = np.unique(np.array(starts)[:, None] - np.arange(EVERY))
                    at = at[(at >= 0) & (at + size <= runs.n)]
                    which.append(np.full(len(at), i)), places.append(at), nodes.append(runs.spans(at, at + size))
                rows = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(nodes).view(np.int64))], names=schema.names)

    of_texts = cut(source.mapInArrow(run, schema).dropDuplicates(["t", "start"]))
    ids = seeds.select("id", F.col("t").alias("_t")).distinct()
    return merge_join(of_texts, ids, F.col("t") == F.col("_t")).select("id", "t", "start", "node")


def _runs(held: DataFrame, size: int) -> DataFrame:
    """Found seeds (id, t, start, node) of ``size`` words that follow one another in the same way in the keeper's text, as one.

    Rows: the document, the words ``start`` to ``end`` of its text, the keeper's
    ``keeper`` and ``kt``, and the words ``at`` to ``upto`` of its text.
    """
    first = held.groupBy(F.col("node").alias("_node")).agg(F.min(F.struct(_order().alias("doc"), F.col("start"))).alias("first"))
    hit = merge_join(held, first, F.col("node") == F.col("_node")).where(~_own("first.doc"))
    hit = hit.select("id", "t", "start", F.col("first.doc.id").alias("keeper"), F.col("first.doc.t").alias("kt"), (F.col("start") - F.col("first.start")).alias("way"))
    by_way = Window.partitionBy("t", "id", "kt", "way").orderBy("start")
    apart = F.coalesce(F.col("start") > F.lag("start").over(by_way) + size, F.lit(True))
    numbered = hit.withColumn("_new", apart.cast("int")).withColumn("_run", F.sum("_new").over(by_way.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("t", "id", "kt", "way", "_run").agg(F.min("keeper").alias("keeper"), F.min("start").alias("start"), (F.max("start") + size).cast("int").alias("end"))
    return runs.select("id", "t", "keeper", "kt", "start", "end", (F.col("start") - F.col("way")).cast("int").alias("at"), (F.col("end") - F.col("way")).cast("int").alias("upto"))


def _around(docs: DataFrame, runs: DataFrame, *, text_col: str) -> DataFrame:
    """16 bits of each of the ``REACH`` words before and after each place where a run begins or ends in its keeper's text; a text has as many places as words at most."""
    places = runs.select(F.col("kt").alias("t"), F.explode(F.array("at", "upto")).alias("place"))
    asked = cut(places.groupBy("t").agg(F.collect_set("place").alias("places")))
    held, _ = _texts_of(docs, asked, text_col=text_col)
    source = merge_join(held, asked, F.col("_t") == F.col("t")).select(F.col("row")[text_col].alias("_text"), "t", "places")
    schema = T.StructType([T.StructField("_kt", T.LongType()), T.StructField("_place", T.IntegerType()), T.StructField("before", T.BinaryType()), T.StructField("after", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.free()
        for whole in batches:
            for low in range(0, whole.num_rows, 200):
                batch = whole.slice(low, 200)
                out = [[] for _ in schema]
                for text, t, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    w = _short_hashes(text)
                    for p in places:
                        for held, value in zip(out, (t, p, w[max(0, p - REACH) : p].tobytes(), w[p : p + REACH].tobytes()), strict=True):
                            held.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=schema.names)

    return cut(source.mapInArrow(run, schema).dropDuplicates(["_kt", "_place"]))


def _short_hashes(text: str) -> np.ndarray:
    return (Words([text.encode("utf-8", "replace")]).hashes >> np.uint64(48)).astype(np.uint16)


# Places at which two texts may agree again, as words passed over in either: the nearest first.
_AGAIN = np.array(sorted(((p, q) for p in range(GAP + 1) for q in range(GAP + 1)), key=lambda x: (x[0] + x[1], abs(x[0] - x[1]), x[0])))
_PAD = 2 * GAP + 2 * WIDTH  # words of no text behind each row


def _rows(values: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, width: int, step: int, none: int) -> np.ndarray:
    """For each place of ``firsts`` the ``sizes`` words from it on, forwards or backwards, as a row of ``width`` filled up with ``none``."""
    k = np.arange(width + _PAD)
    at = firsts[:, None] + step * k
    out = values[np.clip(at, 0, max(0, len(values) - 1))].astype(np.int32) if len(values) else np.zeros(at.shape, np.int32)
    out[k >= sizes[:, None]] = none
    return out


def _same(equal: np.ndarray) -> np.ndarray:
    """Length of the run of true values that each row begins with."""
    return np.where(equal.all(1), equal.shape[1], equal.argmin(1))


def _reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How far each row of ``a`` and ``b`` have words in common from their beginnings, with ever more edits.

    Returns words of either and shared shingles (rows x edits), and which of
    these there are. After each run, the nearest place where ``WIDTH`` words
    agree again goes on; an edit passes over ``GAP`` words at most.
    """
    n = len(a)
    width = min(a.shape[1], b.shape[1])
    i = _same(a[:, :width] == b[:, :width])
    j, shared = i.copy(), np.zeros(n, np.int64)
    reached = [(i, j, shared, np.ones(n, bool))]
    live = np.arange(n)
    span = np.arange(GAP + WIDTH)
    while len(live):
        x = np.take_along_axis(a[live], np.minimum(i[live, None] + span, a.shape[1] - 1), 1)
        y = np.take_along_axis(b[live], np.minimum(j[live, None] + span, b.shape[1] - 1), 1)
        equal = x[:, :, None] == y[:, None, :]
        again = equal[:, : GAP + 1, : GAP + 1].copy()
        for k in range(1, WIDTH):
            again &= equal[:, k : k + GAP + 1, k : k + GAP + 1]
        ranked = again[:, _AGAIN[:, 0], _AGAIN[:, 1]]
        on = ranked.any(1)
        over = _AGAIN[ranked[on].argmax(1)]
        live = live[on]
        if not len(live):
            break
        ni, nj = i[live] + over[:, 0], j[live] + over[:, 1]
        far = np.arange(width)
        x = np.take_along_axis(a[live], np.minimum(ni[:, None] + far, a.shape[1] - 1), 1)
        y = np.take_along_axis(b[live], np.minimum(nj[:, None] + far, b.shape[1] - 1), 1)
        run = _same(x == y)
        i, j, shared, there = i.copy(), j.copy(), shared.copy(), np.zeros(n, bool)
        i[live], j[live], shared[live], there[live] = ni + run, nj + run, shared[live] + run - WIDTH + 1, True
        reached.append((i, j, shared, there))
    return tuple(np.stack(x, 1) for x in zip(*reached, strict=True))


def _widest(left: tuple, right: tuple, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words to the left and right of runs of ``size`` the widest passages reach whose shingles are enough alike."""
    (la, lb, ls, lt), (ra, rb, rs, rt) = left, right
    own = (size + la[:, 0] + ra[:, 0] - WIDTH + 1)[:, None, None]
    both = own + ls[:, :, None] + rs[:, None, :]
    a, b = la[:, :, None] + ra[:, None, :], lb[:, :, None] + rb[:, None, :]
    either = a + b + 2 * (size - WIDTH + 1)[:, None, None] - both
    fits = lt[:, :, None] & rt[:, None, :] & (both * 100 >= either * percent)
    fits[:, 0, 0] = True
    best = np.where(fits, a, -1).reshape(len(size), -1).argmax(1)
    at = np.arange(len(size))
    return la[at, best // ra.shape[1]], ra[at, best % ra.shape[1]]


def _slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a column of packed words, and where each row begins and how many it has."""
    packed = column.cast(pa.large_binary())
    offsets = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
    words = np.frombuffer(packed.buffers()[2] or b"", np.uint16)
    return words, offsets[:-1] // 2, np.diff(offsets) // 2


def _widened(docs: DataFrame, runs: DataFrame, *, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Runs as the whole passages of ``PASSAGE`` words or more that their documents and the keepers' have in common, edits included; shorter ones as they are, with ``passage`` false."""
    runs = cut(runs)
    around = _around(docs, runs, text_col=text_col)
    begins = merge_join(runs, around.select("_kt", "_place", "before"), (F.col("kt") == F.col("_kt")) & (F.col("at") == F.col("_place"))).drop("_kt", "_place")
    both = merge_join(begins, around.select("_kt", "_place", "after"), (F.col("kt") == F.col("_kt")) & (F.col("upto") == F.col("_place")))
    by_doc = cut(both.groupBy("t", "id").agg(F.collect_list(F.struct("start", "end", "keeper", "before", "after")).alias("runs")))
    held, _ = _texts_of(docs, by_doc, text_col=text_col)
    source = merge_join(held, by_doc, (F.col("_t") == F.col("t")) & F.col("row")[id_col].eqNullSafe(F.col("id"))).select("id", "t", F.col("row")[text_col].alias("_text"), "runs")
    names = ["id", "t", "start", "end", "passage", "first_id"]
    id_type = source.schema["id"].dataType
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, (id_type, T.LongType(), T.IntegerType(), T.IntegerType(), T.BooleanType(), id_type), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.free()
        for whole in batches:
            for low in range(0, whole.num_rows, 50):
                batch = whole.slice(low, 50)
                texts = [_short_hashes(t) for t in batch.column(2).to_pylist()]
                words = np.concatenate(texts)
                base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                runs = batch.column(3).flatten()
                of = np.repeat(np.arange(len(texts)), pc.list_value_length(batch.column(3)).to_numpy())
                start, end = (runs.field(k).to_numpy() for k in ("start", "end"))
                kept = [np.zeros((2, 0), np.int64)]
                # a bounded number of runs at a time
                for at in range(0, len(of), 2000):
                    part = slice(at, at + 2000)
                    a, z, first, last = start[part], end[part], base[of[part]], base[of[part] + 1]
                    before, b0, bn = _slices(runs.field("before").slice(at, len(a)))
                    after, a0, an = _slices(runs.field("after").slice(at, len(a)))
                    own_left = _rows(words, first + a - 1, np.minimum(a, 2 * REACH), 2 * REACH, -1, -1)
                    own_right = _rows(words, first + z, np.minimum(last - first - z, 2 * REACH), 2 * REACH, 1, -1)
                    left = _reached(own_left, _rows(before, b0 + bn - 1, bn, REACH, -1, -2))
                    right = _reached(own_right, _rows(after, a0, an, REACH, 1, -2))
                    kept.append(np.stack(_widest(left, right, (z - a).astype(np.int64), percent)))
                left, right = np.concatenate(kept, 1)
                enough = left + right + end - start >= PASSAGE
                begins, ends = np.where(enough, start - left, start), np.where(enough, end + right, end)
                keepers = runs.field("keeper").to_pylist()
                spans: dict = {}
                for row in zip(of.tolist(), keepers, enough.tolist(), begins.tolist(), ends.tolist(), strict=True):
                    spans.setdefault(row[:3], []).append(row[3:])
                found = [(i, a, z, e, k) for (i, k, e), of_keeper in spans.items() for a, z in _merged(of_keeper)]
                if found:
                    which, starts, stops, whole_ones, keeps = zip(*found, strict=True)
                    at = pa.array(which)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(whole_ones), pa.array(keeps, batch.column(0).type)], names=names)

    return cut(source.mapInArrow(run, schema))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch as one."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``; lines left without a word go with their line end."""
    words = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    out, at = [], 0
    for a, z in _merged(spans):
        out.append(text[at : words[a].start()])
        at = words[z].start() if z < len(words) else len(text)
        if z < len(words) and "\n" in text[words[z - 1].end() : at] and out[-1] and not out[-1].endswith("\n"):
            out.append("\n")
    out.append(text[at:])
    return "".join(out)


def _freed(docs: DataFrame, *, id_col: str, text_col: str, percent: int) -> DataFrame:
    """``row`` (all columns of ``docs``), ``clean``, ``spans`` and ``keepers`` of each row of ``docs``."""
    id_type = docs.schema[id_col].dataType
    found = repeats(docs, id_col=id_col, text_col=text_col, percent=percent)
    by_doc = cut(found.groupBy("t", "id").agg(F.collect_set(F.struct("start", "end")).alias("places"), F.array_sort(F.collect_set("first_id")).alias("keepers")))
    held, others = _texts_of(docs, by_doc, text_col=text_col, others=True)
    both = merge_join(held, by_doc, (F.col("_t") == F.col("t")) & F.col("row")[id_col].eqNullSafe(F.col("id")), "left")

    @F.pandas_udf("struct<clean:string,spans:int>")
    def clean(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        spans = [[] if p is None else _merged([(x["start"], x["end"]) for x in p]) for p in places]
        return pd.DataFrame({"clean": [_cut_out(t, s) if s else t for t, s in zip(texts, spans, strict=True)], "spans": [len(s) for s in spans]})

    text, none = F.col("row")[text_col], F.array().cast(T.ArrayType(id_type))
    done = both.select("row", clean(text, F.col("places")).alias("done"), F.coalesce("keepers", none).alias("keepers")).select("row", "done.clean", "done.spans", "keepers")
    return done if others is None else done.unionAll(others.select("row", text.alias("clean"), F.lit(0).alias("spans"), none.alias("keepers")))


def removed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, added: tuple[str, str, str] = ("_clean", "_spans", "_keepers")) -> DataFrame:
    """Rows of ``docs``, each with its text freed of repeats, their number and the ids that keep them.

    All columns are kept, whatever their names; those ``added`` after them hold
    the text left, the number of repeated passages and the sorted ids that keep
    them (null left out). Documents without repeats have their text as it is, 0
    and an empty list.
    """
    if taken := set(added) & set(docs.columns):
        raise ValueError(f"columns to add are there already: {sorted(taken)}")
    freed = _freed(docs, id_col=id_col, text_col=text_col, percent=percent)
    return freed.select(*[F.col("row")[c].alias(c) for c in docs.columns], *[F.col(c).alias(a) for c, a in zip(("clean", "spans", "keepers"), added, strict=True)])


def cleaned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Rows and columns of ``docs`` as they are, but for the text, which is freed of repeats."""
    freed = _freed(docs, id_col=id_col, text_col=text_col, percent=percent)
    return freed.select(*[(F.col("clean") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
