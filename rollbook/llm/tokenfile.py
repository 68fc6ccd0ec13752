"""Token-id files: Parquet list columns with dictionary or delta pages.

One row a document, in ascending id order: the id, its place in the file, its
number of tokens and the list of ids. Token lists are dictionary-coded and,
where a dictionary grows too large, delta-coded (version 2 pages); row groups
and pages are kept small, and each file carries page indexes, so a reader of
lengths alone or of a range of ids touches little else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from rollbook.llm import workers
from rollbook.llm.wordcode import PieceCoder, Vocabulary, read_vocabulary

# Parquet settings of the format; sizes in bytes.
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.column.index.truncate.length": "64",
    "compression": "zstd",
}


def library_coder(text: str) -> PieceCoder:
    """A coder whose merges are the tokenizers library's own; kept in the worker."""

    def make() -> PieceCoder:
        model = Tokenizer.from_str(text).model
        return PieceCoder(Vocabulary(text), lambda word: [t.id for t in model.tokenize(word)], room=96 << 20)

    return workers.kept(("token file", hash(text)), make)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode each whole text, append ``end_id``, and write the files at ``path``.

    Files are in ascending id order, each sorted. Null and empty texts have
    the end id alone; null ids come first; rows with equal ids are all kept,
    ordered by a hash of the text. One shuffle, by ranges of the id.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    source = docs.select(id_col, text_col)
    schema = T.StructType([source.schema[0], T.StructField("place", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, place = library_coder(sent.value), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                coded = [coder.encode(t) + end for t in batch.column(1).to_pylist()]
                ends = np.cumsum([0, *[len(c) // 4 for c in coded]], dtype=np.int64)
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(place, place + n)), pa.array(np.diff(ends)), ids], names=schema.names)
                place += n

    # a hash parts the rows of one id, so that whole texts are no part of the ranges' sample
    ordered = source.repartitionByRange(F.col(id_col), F.xxhash64(text_col)).sortWithinPartitions(F.col(id_col), F.xxhash64(text_col))
    ordered.mapInArrow(run, schema).write.options(**LAYOUT).parquet(path)


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``before`` (ids of all files before it) of each file, from the length column alone: one row a file."""
    totals = spark.read.parquet(path).select("n_tokens", F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.sum("n_tokens").alias("total"))
    # Spark numbers a write's files by partition
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("int")
    return totals.select("file", (F.sum("total").over(Window.orderBy(number)) - F.col("total")).alias("before"))


def read_documents(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """Each document as read back: id, file, place in it, n_tokens and ids_crc32, the CRC-32 of its ids as little-endian 32-bit integers."""
    source = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file")).select(id_col, "file", "place", "ids")
    schema = T.StructType([source.schema[0], T.StructField("file", T.StringType()), T.StructField("place", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)


def token_file(docs: DataFrame, path: str, vocabulary: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``docs`` and read back id, start, n_tokens and ids_crc32 of each document.

    An empty table writes no rows and reads back none.
    """
    spark = docs.sparkSession
    write_tokens(docs, path, vocabulary, end_id=end_id, id_col=id_col, text_col=text_col)
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place")) - F.col("n_tokens")
    back = read_documents(spark, path, id_col=id_col).withColumn("inside", inside)
    # one row a file, and a file holds many documents: small enough to send
    both = back.join(F.broadcast(read_totals(spark, path)), "file")
    return both.select(id_col, (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
