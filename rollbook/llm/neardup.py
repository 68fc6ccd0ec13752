"""MinHash near-duplicates: an inverted join over signature coordinates.

Each distinct shingle set is posted under its coordinate-value pairs. Two sets
that agree in ``least`` of ``coordinates`` places must share one of the rarest
``coordinates - least + 1`` of either (prefix); so the ``least - 1`` most
frequent pairs of a set are skipped: they only count towards agreement and
never bring sets together. This is done twice: a short signature of every set
drops those that agree with no other in enough places, and a long one of the
rest, with a sharper threshold, makes the lists. Two sets can only reach the
threshold if enough of their shingles are in other sets at all, which drops
edited copies that are too far from everything. Sets that agree often enough
are confirmed on their full shingle sets.

Long lists are not expanded into pairs (see ``linking``), and no link between
components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm import workers
from rollbook.llm.components import merge_join
from rollbook.llm.linking import link
from rollbook.llm.scratch import cut
from rollbook.llm.words import Words, blocks, distinct, least_of_each, mix, shingle_hashes

# (coordinates, least): at Jaccard 0.8 a pair agrees in fewer about once in 100,000 (short) and 40,000 (long).
SHORT, LONG = (32, 15), (192, 131)
SEND_NODES = 1_000_000  # up to so many ids are sent to every task instead of shuffling the texts


def row_key(id_col: str, text_col: str) -> list[Column]:
    """``h1`` and ``h2``: 128 bits of id and text, by which a row is found again."""
    return [F.xxhash64(id_col, text_col).alias("h1"), F.xxhash64(text_col, F.lit(7), id_col).alias("h2")]


def signatures(docs: DataFrame, *, id_col: str, text_col: str, width: int, coordinates: int) -> DataFrame:
    """``uid`` of each row, its id and row key, size and key of its shingle set, and the signature (empty for an empty set)."""
    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("_text"), *row_key(id_col, text_col))
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("sig", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.free()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n, keys, sigs = [], [], []
                for _, held in blocks(batch.column(2).to_pylist()):
                    hashes, begins = distinct(*shingle_hashes(Words(held), width))
                    sig = least_of_each(hashes, begins, coordinates).view(np.int64)
                    n.append(np.diff(begins))
                    for i in range(len(held)):
                        own = hashes[begins[i] : begins[i + 1]]
                        keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                        sigs.append(sig[i] if len(own) else sig[i, :0])
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
                values = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
                counts = np.concatenate(n) if n else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(counts), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=schema.names)

    return source.mapInArrow(run, schema)


def _texts_of(docs: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """``_text`` of the rows with a wanted id."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    ids = wanted.select(F.col("id").alias("_want")).distinct()
    if wanted.count() <= SEND_NODES:
        ids = F.broadcast(ids)
    return source.join(ids, F.col("_id").eqNullSafe(F.col("_want")), "left_semi").select("_text")


def _long_signatures(docs: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str, width: int, coordinates: int) -> DataFrame:
    """``node``, the signature as ``tokens``, 16 bits of each coordinate as ``code``, and the whole set as ``hashes``, for ``wanted`` (node, id, key)."""
    schema = T.StructType([T.StructField("_key", T.BinaryType()), T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("code", T.ArrayType(T.ShortType(), False)), T.StructField("hashes", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.free()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                keys, sigs, sets, sizes = [], [], [], [np.zeros(1, np.int64)]
                for _, held in blocks(whole.column(0).slice(at, 500).to_pylist()):
                    hashes, begins = distinct(*shingle_hashes(Words(held), width))
                    sigs.append(least_of_each(hashes, begins, coordinates, seed=1))
                    sets.append(hashes)
                    sizes.append(np.diff(begins))
                    keys += [hashlib.blake2b(hashes[begins[i] : begins[i + 1]].tobytes(), digest_size=16).digest() for i in range(len(held))]
                sig = np.concatenate(sigs)
                ends = pa.array(np.arange(0, sig.size + 1, coordinates, dtype=np.int32))
                # a value counts in its own coordinate alone
                own = mix(sig + np.arange(coordinates, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(own.ravel().view(np.int64))), pa.ListArray.from_arrays(ends, pa.array((sig.ravel() >> np.uint64(32)).astype(np.uint16).view(np.int16))), pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))], names=schema.names)

    found = _texts_of(docs, wanted, id_col=id_col, text_col=text_col).mapInArrow(run, schema)
    return merge_join(found, wanted.select("node", "key"), F.col("_key") == F.col("key")).select("node", "tokens", "code", "hashes").dropDuplicates(["node"])


def agree(least: int):
    """Whether two codes agree in at least ``least`` places."""
    return lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) >= least


def _ranked(posts: DataFrame, least: int) -> DataFrame:
    """``node`` and its (df, token) pairs that other nodes have too, rarest first; nodes with fewer than ``least`` are left out."""
    shared = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").withColumnRenamed("token", "_token")
    return merge_join(posts, shared, F.col("token") == F.col("_token")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked")).where(F.size("ranked") >= least)


def _confirmed(sets: DataFrame, percent: int):
    """Keeps pairs whose full sets (node, hashes) reach the threshold, and writes them once."""
    one, two = sets.select(F.col("node").alias("_a"), F.col("hashes").alias("ha")), sets.select(F.col("node").alias("_b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))

    def run(pairs: DataFrame) -> DataFrame:
        held = merge_join(pairs, one, F.col("a") == F.col("_a"))
        enough = both * 100 >= (F.size("ha") + F.size("hb") - both) * percent
        return cut(merge_join(held, two, (F.col("b") == F.col("_b")) & enough).select("a", "b").distinct())

    return run


def _shared_sizes(sets: DataFrame) -> DataFrame:
    """``_of`` and how many members of its set (node, hashes) no other set has, for sets with any such."""
    held = sets.select("node", F.explode("hashes").alias("h")).groupBy("h").agg(F.min("node").alias("_of"), F.max("node").alias("_last"))
    return held.where("_of = _last").groupBy("_of").agg(F.count("*").alias("_alone"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, short: tuple[int, int] = SHORT, long: tuple[int, int] = LONG) -> DataFrame:
    """Every row with the component of its near-duplicates.

    Two rows are linked where 100 * |both sets| >= ``percent`` * |either set|,
    over their distinct ``width``-word shingles (all words if fewer). Rows:
    ``uid`` (the row's own), ``id``, ``h1`` and ``h2`` (its key), ``n`` (set size), ``first_id`` (smallest
    id of the component, nulls last), ``first`` (whether the row itself is the
    component's first: smallest id, then smallest uid). Null, empty and
    wordless texts have no shingles and stand alone; equal sets are one node,
    whatever their number; equal ids are told apart by ``uid``.
    """
    base = cut(signatures(docs, id_col=id_col, text_col=text_col, width=width, coordinates=short[0]))
    classes = base.where("n > 0").groupBy("key").agg(F.min("uid").alias("node"))
    heads = base.join(classes.select("node"), F.col("uid") == F.col("node")).select("node", "id", "key", "n", "sig")
    likely = _ranked(heads.select("node", F.explode("sig").alias("token")), short[1]).select(F.col("node").alias("_node"))
    nodes = cut(merge_join(heads.drop("sig"), likely, F.col("node") == F.col("_node")).drop("_node"))
    signed = cut(_long_signatures(docs, nodes, id_col=id_col, text_col=text_col, width=width, coordinates=long[0]))
    listed = _ranked(signed.select("node", F.explode("tokens").alias("token")), long[1]).withColumnRenamed("node", "_node")
    weight = F.aggregate("ranked", F.lit(0).cast("long"), lambda sum_, x: sum_ + x["df"])
    prefix = F.slice("ranked", F.lit(1), F.size("ranked") - (long[1] - 1))
    shared = merge_join(nodes.select("node", "n"), _shared_sizes(signed), F.col("node") == F.col("_of"), "left").select("node", "n", (F.col("n") - F.coalesce("_alone", F.lit(0))).alias("s"))
    fit = shared.where(F.col("s") * 100 >= F.col("n") * percent)
    posts = merge_join(fit, listed, F.col("node") == F.col("_node")).select("node", "n", "s", weight.alias("weight"), F.inline(prefix))
    df = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").withColumnRenamed("token", "_token")
    posts = cut(merge_join(posts.drop("df"), df, F.col("token") == F.col("_token")).select("token", "node", "n", "s", "weight", "df"))
    _, found = link(posts, signed.select("node", "hashes"), _confirmed(signed.select("node", "hashes"), percent), percent=percent, codes=signed.select("node", "code"), alike=agree(long[1]))

    members = base.select("uid", "id", "h1", "h2", "n", "key").join(classes.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left")
    known = found.withColumnRenamed("node", "_node")
    placed = members.join(known, F.col("node") == F.col("_node"), "left").select("uid", "id", "h1", "h2", "n", F.coalesce("comp", "node", F.when(F.col("n") == 0, -F.col("uid") - 1)).alias("comp"))
    placed = cut(placed)
    order = F.struct(F.col("id").isNull(), "id", "uid")
    firsts = placed.groupBy("comp").agg(F.min(order).alias("least")).withColumnRenamed("comp", "_comp")
    return placed.join(firsts, F.col("comp") == F.col("_comp")).select("uid", "id", "h1", "h2", "n", F.col("least.id").alias("first_id"), (F.col("uid") == F.col("least.uid")).alias("first"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The first row of each component of near-duplicates, with all its columns; rows without words all stay.

    Of rows equal in id and text one stays.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, width=width, percent=percent)
    kept = found.where("first").select(F.col("h1").alias("_k1"), F.col("h2").alias("_k2"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[k.alias("_" + n) for k, n in zip(row_key(id_col, text_col), ("h1", "h2"), strict=True)])
    held = merge_join(keyed, kept, (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2")), "left_semi")
    once = held.withColumn("_nth", F.row_number().over(Window.partitionBy("_h1", "_h2").orderBy("_h1")))
    return once.where("_nth = 1").select(*[F.col("row")[c].alias(c) for c in docs.columns])
