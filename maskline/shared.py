"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has made and not removed.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset (tests on one machine), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    _made.append(f"{base.rstrip('/')}/maskline-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def work(spark: SparkSession) -> Iterator[None]:
    """What is done inside may make work folders; all of them are removed at the end, when its results have been read or published."""
    first = len(_made)
    try:
        yield
    finally:
        for folder in _made[first:]:
            remove(spark, folder)
        del _made[first:]


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and survives the loss of executors."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
