"""Published tables: partitions replaced in place, JSON with sorted keys, shards for point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sorted_struct(kind: T.StructType, c: Column) -> Column:
    """A struct with its fields in name order, at all depths."""
    def ordered(kind: T.DataType, c: Column) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[ordered(f.dataType, c[f.name]).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: ordered(kind.elementType, x))
        return c

    return ordered(kind, c)


def stable_json(df: DataFrame, key: str) -> DataFrame:
    """Each row as JSON text with sorted keys and absent fields left out."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.col(key), F.to_json(sorted_struct(df.schema, row)).alias("json"))


ROWS_A_FILE = 5_000_000


def dealt(df: DataFrame, partition: str, rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """``df`` with the rows of each partition in one task, or in as many as its rows need, dealt by a hash of the row: a few files for a partition and no task that grows with one. The null partition is one like any other."""
    sizes = df.groupBy(F.col(partition).alias("_by")).agg(F.ceil(F.count("*") / rows_a_file).alias("_parts"))
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)])
    told = df.join(sizes, F.col(partition).eqNullSafe(F.col("_by"))).withColumn("_part", F.pmod(row, F.col("_parts")))
    return told.repartition(partition, "_part").drop("_by", "_parts", "_part")


def write_slice(df: DataFrame, path: str, partition: str) -> None:
    """Replace the partitions that ``df`` holds and no others."""
    dealt(df, partition).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(partition).parquet(path)


def write_shards(df: DataFrame, path: str, key: str, letters: int = 3) -> None:
    """Rows under the first letters of their key, so that a lookup reads one shard."""
    df.withColumn("shard", F.substring(key, 1, letters)).repartition("shard").sortWithinPartitions("shard", key).write.mode("overwrite").partitionBy("shard").json(path)


def urls(parts: dict[str, DataFrame], base: str) -> DataFrame:
    """All page addresses of a site: a prefix for each part and its ids, percent-encoded."""
    from functools import reduce

    each = [df.select(F.concat(F.lit(f"{base}{prefix}/"), F.url_encode(F.col(df.columns[0]).cast("string")), F.lit("/")).alias("url")) for prefix, df in parts.items()]
    return reduce(DataFrame.unionAll, each).distinct()
