"""Statements that keep arriving: each batch of new files extends the mapping and is masked under it, passes the gate, and is published.

There is no event time: the state is the mapping, not a state store. A batch is
staged with the runs that it adds to the mapping and the leaks that are left.
If none is, rows and runs are published by one manifest; else nothing of the
batch is, and it stays in quarantine with its leaks and the names of its files.
So rows and mapping never part, wherever a run ends: a batch that Spark gives
again after a failure is staged anew, or, if its manifest is there, passed by.
One writer only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskline.plans.jobs import statements_job
from maskline.sources import files
from maskline.sources.commits import REFUSED, Store


def batch_key(number: int) -> str:
    return f"batch={number}"


def stream_mapping(spark: SparkSession, mapping_path: str, out: str, seed: str) -> DataFrame:
    """(category, real, fake): the saved mapping of the seed, and the runs of all published batches."""
    saved, added = files.read_mapping(spark, mapping_path, seed), Store(spark, out).read("runs")
    return saved if added is None else saved.union(added.select("category", "real", "fake"))


def published_rows(spark: SparkSession, out: str) -> DataFrame | None:
    """(file, row_no, cells) of all published batches."""
    return Store(spark, out).read("rows")


def quarantine(spark: SparkSession, out: str, table: str = "leaks") -> DataFrame | None:
    """Leaks (or rows, runs, files) of the batches that were refused."""
    return Store(spark, out).read(table, state=REFUSED)


def mask_batch(spark: SparkSession, batch: DataFrame, number: int, mapping_path: str, out: str, seed: str, factor: str | None = None, forbidden: DataFrame | None = None, glob: str = "*.csv") -> None:
    """Mask and gate one batch of files (path), and publish or refuse it, once."""
    store, key = Store(spark, out), batch_key(number)
    paths = [r.path for r in batch.select("path").collect()]  # names of one batch's files
    if store.decided(key):
        store.sweep(key)  # what an attempt left that failed
        return
    if not paths:
        return
    rows = files.read_cells(spark, paths, glob).select("file", "row_no", "cells")
    done = statements_job(rows, stream_mapping(spark, mapping_path, out, seed), seed, factor, forbidden)
    attempt = store.attempt(key)
    for name in ("rows", "runs", "leaks"):
        attempt.stage(name, done[name])
    attempt.stage("files", batch.select("path"))
    if done["report"].where("check = 'overall'").first().passed:
        attempt.publish()
    else:
        attempt.refuse(f"{done['leaks'].count()} cells with leaks")
    store.sweep(key)


def mask_stream(spark: SparkSession, folder: str, mapping_path: str, out: str, seed: str, checkpoint: str, factor: str | None = None, forbidden: DataFrame | None = None, files_per_batch: int | None = None, glob: str = "*.csv") -> StreamingQuery:
    """Mask the CSV statements of a folder as they come, once each; stops when none is left. forbidden (category, term) must not come out either."""
    stream = spark.readStream.format("binaryFile").schema(spark.read.format("binaryFile").load(folder).schema).option("pathGlobFilter", glob)
    stream = (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).load(folder)
    step = lambda batch, number: mask_batch(spark, batch, number, mapping_path, out, seed, factor, forbidden, glob)
    return stream.select(F.col("path")).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
