"""Session settings that the operators rely on."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # attributes repeat keys; the last one holds
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

#: What a task holds of bodies at a time, at most; smaller ones, given as plain numbers, stay. A Parquet reader fills a batch of rows whole, 4096 of them unless told,
#: and a body is some 100 KB, so that four tasks would fill gigabytes; Python gets 64 MB unless told, and makes several times as much of them.
AT_MOST = {"spark.sql.parquet.columnarReaderBatchSize": 64, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    for k, most in AT_MOST.items():
        had = spark.conf.get(k).rstrip("b")
        if not had.isdigit() or not 0 < int(had) <= most:
            spark.conf.set(k, str(most))
    return spark


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package where it lies beside the driver; elsewhere ship it with --py-files."""
    env = spark.sparkContext.environment
    if _ROOT not in (had := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (had, _ROOT) if x)


def scratch_dir(spark: SparkSession) -> str:
    """The path of a new folder that driver and executors share, below spark.checkpoint.dir; it goes when the driver ends.

    Where the setting is missing a folder of this machine serves, which only a local master shares; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "tideline-scratch")
    path = f"{base.rstrip('/')}/tideline-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: a lineage cut that outlives lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
