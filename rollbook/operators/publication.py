"""Several tables published as one: staged, then made known by one manifest that readers hold to."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rollbook.operators.quality import require_none
from rollbook.sources.sinks import ROWS_A_FILE, dealt


@dataclass(frozen=True)
class Publication:
    """One version of all tables. A reader that holds it reads its files, whatever is published meanwhile."""

    spark: SparkSession
    version: int
    paths: dict[str, str]
    rows: dict[str, int]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.paths[name])


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions published at a path, oldest first."""
    at, fs = _file_system(spark, f"{path}/versions")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[: -len(".json")].isdigit())


def read(spark: SparkSession, path: str, version: int | None = None) -> Publication:
    """The latest publication, or a given version of it. None is an error: nothing published is not an empty table."""
    have = versions(spark, path)
    if not have or (version is not None and version not in have):
        raise FileNotFoundError(f"no version {'' if version is None else version} published at {path}")
    chosen = have[-1] if version is None else version
    text = "\n".join(r.value for r in spark.read.text(f"{path}/versions/{chosen}.json").collect())  # one line: the manifest
    held = json.loads(text)["tables"]
    return Publication(spark, chosen, {n: x["path"] for n, x in held.items()}, {n: x["rows"] for n, x in held.items()})


def publish(tables: dict[str, DataFrame], path: str, *, guards: dict[str, DataFrame] | None = None, partitions: dict[str, str] | None = None, rows_a_file: int = ROWS_A_FILE) -> Publication:
    """Write all ``tables`` to a folder of their own and make them the next version.

    All guards are empty before anything is written. The manifest, created
    once and never over another, is the only commit: a job that dies before
    leaves files that nobody reads, and of two that publish at once one is
    refused. ``partitions`` names the column by which a table is laid out; rows
    without a value lie in a partition of their own. A partition of more than
    ``rows_a_file`` rows is dealt over several tasks.
    """
    for what, found in (guards or {}).items():
        require_none(found, what)
    spark = next(iter(tables.values())).sparkSession
    stage, held = f"{path}/data/{uuid.uuid4().hex}", {}
    for name, df in tables.items():
        by = (partitions or {}).get(name)
        if by:
            dealt(df, by, rows_a_file).write.partitionBy(by).parquet(f"{stage}/{name}")
        else:
            df.write.parquet(f"{stage}/{name}")
        held[name] = {"path": f"{stage}/{name}", "rows": spark.read.parquet(f"{stage}/{name}").count()}
    version = (versions(spark, path) or [0])[-1] + 1
    at, fs = _file_system(spark, f"{path}/versions/{version}.json")
    out = fs.create(at, False)
    out.write(bytearray(json.dumps({"version": version, "tables": held}, sort_keys=True).encode()))
    out.close()
    return Publication(spark, version, {n: x["path"] for n, x in held.items()}, {n: x["rows"] for n, x in held.items()})
