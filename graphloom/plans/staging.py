"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this driver and not yet removed.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local session, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged(df: DataFrame, name: str, by: Sequence[str] = (), codec: str = "zstd") -> DataFrame:
    """df written once and read again: cuts lineage, feeds many readers, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/graphloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).partitionBy(*by).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def mark() -> int:
    """A point in the list of staged tables, for `release`."""
    return len(_written)


def release(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Removes the tables staged since a mark, but for the last `keep`; callers no longer read them."""
    last = len(_written) - keep
    for path in _written[since:last]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del _written[since:last]


def worker_path(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver was started from another folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, known) if p)
