"""Tables between the steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPLIT = "spark.sql.adaptive.forceOptimizeSkewedJoin"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BLOOM = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; without one, a fresh local folder in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="cartolith-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Within it, a query's shuffle files go as soon as it has ended, joins split hot keys even where that
    costs another shuffle, Arrow batches are bounded in bytes, and rows that a small filtered side cannot match are sifted
    by Spark's own Bloom filter before they are shuffled, however small the scan."""
    wanted = {CLEANUP: "true", SPLIT: "true", BATCH: str(32 << 20), BLOOM: "1"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, and a lost
    executor costs no recomputation. Shuffle files of the job that wrote it are freed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    for paths in _open:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cartolith_path = path
    return out


#: tasks a core that rows are spread over
SPREAD = 4


def spread(df: DataFrame) -> DataFrame:
    """df in several tasks a core, in no order: for few rows that cost or become much, which a scan reads in as many tasks as their bytes need."""
    return df.repartition(SPREAD * df.sparkSession.sparkContext.defaultParallelism)


#: rows that are sent to every task
SENT = 100_000


def sent(df: DataFrame, name: str = "step", most: int = SENT) -> DataFrame:
    """df, stored and counted, as a side of a join: sent to every task with at most ``most`` rows, else dealt out by key. The size of a file of repeated
    values says little of its rows."""
    df = materialise(df, name)
    return df.hint("broadcast" if df.limit(most + 1).count() <= most else "shuffle_merge")


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that materialise() writes within it, at its end: for results that are written inside."""
    _open.append(paths := [])
    try:
        yield
    finally:
        _open[:] = [other for other in _open if other is not paths]
        for path in paths:
            drop_folder(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote and that nothing reads any more."""
    for df in tables:
        drop_folder(df.sparkSession, df.cartolith_path)
