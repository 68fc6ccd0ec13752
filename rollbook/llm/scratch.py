"""The shared folder for tables that cut lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Local mode, where driver and tasks are one process, gets one of its own; a cluster that names none is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


GC_SECONDS = 2.0  # least time between two collections of the driver's garbage
# shuffle files go when their query ends, and nothing is inferred from what earlier rounds ask of their rows
ROUND = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.constraintPropagation.enabled": "false"}
_last = 0.0


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """``settings`` hold within, and those before after it."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that later jobs read it and lost executors cost no rerun.

    Its shuffle files go with the job. A checkpoint would keep what is known of
    its rows (equal columns, columns that aren't null), which piles up over
    rounds of self-joins, so it is left out. What else earlier rounds
    hold (plans in the driver, tables in the shared folder) goes when the
    driver collects its garbage, so that is done here every few seconds.
    """
    global _last
    shared_dir(df.sparkSession)
    with _set(df.sparkSession, ROUND):
        out = df.select("*").checkpoint(eager=True)
    if time.monotonic() - _last > GC_SECONDS:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        _last = time.monotonic()
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
