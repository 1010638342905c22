"""Readers and writers of ledgers, statements, term lists, pools and mappings."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.functions import text as t
from maskline.operators.rows import has_columns
from maskline.sources.commits import Manifest, Store

#: Files that a run skips: its own settings, lock files, and results of earlier runs.
SKIP = r"^~\$|_anon\.|^run.*config|^config\."
CELLS = "file string, encoding string, row_no int, cells array<string>"


def has_open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a line of a text file has an odd number of quotes, so that a field may go on in the next line."""
    return not spark.read.text(path).where((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).isEmpty()


def read_tsv(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool | None = None) -> DataFrame:
    """Tab-delimited text with a header, every field a string. Files are read in splits unless a field holds line breaks (found by a pass over the lines if multi_line is not given)."""
    multi_line = has_open_quotes(spark, path) if multi_line is None else multi_line
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("encoding", encoding).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def decode(content: bytes) -> tuple[str, str]:
    """(encoding, text): UTF-8 with or without a mark, else Windows-1252 with unknown bytes replaced."""
    try:
        return "utf-8", content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return "windows-1252", content.decode("cp1252", "replace")


def read_cells(spark: SparkSession, path: str, glob: str = "*.csv", separator: str = ",") -> DataFrame:
    """(file, encoding, row_no, cells) of separated files whose header may stand below a preamble.

    Each file is parsed by one task, since row numbers need its order; rows of
    many files spread over tasks. Encodings are found per file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                encoding, text = decode(content.as_py())
                name, rows = path.as_py(), []
                for n, cells in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=separator)):
                    rows.append({"file": name, "encoding": encoding, "row_no": n, "cells": cells})
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("file", pa.string()), ("encoding", pa.string()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string()))])
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.withColumn("name", file_name(F.col("path"))).where(~not_input(F.col("name"))).select("name", "content").mapInArrow(run, CELLS)


def file_name(path: Column) -> Column:
    """The last part of a path; of files that ``write_cells`` wrote, the name of the statement."""
    parts = F.split(path, "/")
    folder = F.regexp_extract(F.element_at(parts, -2), "^file=(.*)$", 1)
    return F.when(folder != "", folder).otherwise(F.element_at(parts, -1))


def not_input(name: Column) -> Column:
    return F.lower(name).rlike(SKIP)


def discover(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(name, path, length) of the input files of a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return found.select(file_name(F.col("path")).alias("name"), "path", "length").where(~not_input(F.col("name")))


def write_cells(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows (file, row_no, cells) as CSV text, one folder per file, in order within it. Always UTF-8."""
    quoted = F.transform("cells", lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(F.coalesce(c, F.lit(""))))
    lines = rows.select("file", "row_no", F.array_join(quoted, ",").alias("value"))
    lines.repartition("file").sortWithinPartitions("file", "row_no").select("file", "value").write.mode(mode).partitionBy("file").text(path)


def read_terms(df: DataFrame) -> DataFrame:
    """(category, term, pos) of a ragged table with a column per list; blanks are dropped."""
    numbered = df.withColumn("pos", F.monotonically_increasing_id())
    long = numbered.unpivot(["pos"], df.columns, "category", "term")
    return long.select("category", t.clean(F.col("term")).alias("term"), "pos").where("term <> ''")


def first_seen(terms: DataFrame) -> DataFrame:
    """(category, term, pos): distinct terms at the place where each is first seen."""
    return terms.groupBy("category", "term").agg(F.min("pos").alias("pos"))


def read_pool(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(kind, value): one candidate per line; an empty pool is an error."""
    values = spark.read.text(path).select(F.lit(kind).alias("kind"), t.clean(F.col("value")).alias("value")).where("value <> ''").distinct()
    if values.isEmpty():
        raise ValueError(f"the pool at {path} is empty")
    return values


def write_mapping(mapping: DataFrame, path: str, seed: str) -> None:
    """(category, real, fake) of one seed, in a private folder; only the partitions of this seed are replaced."""
    mapping.select(F.lit(seed).alias("seed"), "category", "real", "fake").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("seed", "category").parquet(path)


def read_mapping(spark: SparkSession, path: str, seed: str) -> DataFrame:
    """The saved mapping of a seed; an error if there is none."""
    found = spark.read.parquet(path).where(F.col("seed").cast("string") == seed).select("category", "real", "fake")
    if found.isEmpty():
        raise ValueError(f"no mapping of seed {seed} at {path}")
    return found


def write_outputs(tables: dict[str, DataFrame], path: str, seed: str, passed: bool = True, note: str = "") -> Manifest:
    """All tables of a run under its seed, published at once in place of the seed's earlier run, which goes then and no sooner.

    A run that has not passed its checks is kept apart (state refused), and the earlier run stays.
    """
    store = Store(next(iter(tables.values())).sparkSession, path)
    attempt = store.attempt(f"seed={seed}")
    for name, df in tables.items():
        attempt.stage(name, df)
    made = attempt.publish(note) if passed else attempt.refuse(note)
    store.sweep(f"seed={seed}")
    return made


def read_outputs(spark: SparkSession, path: str, seed: str) -> dict[str, DataFrame]:
    """The tables of the seed's last published run; an error if there is none."""
    store = Store(spark, path)
    last = store.last(f"seed={seed}").get(f"seed={seed}")
    if last is None:
        raise ValueError(f"nothing is published for seed {seed} at {path}")
    return {name: spark.read.parquet(f"{store.path}/{last.folder}/{name}") for name in last.tables}


def role(tables: dict[str, DataFrame], wanted: Sequence[str]) -> str:
    """The name of the first table that has the wanted columns; an error if none has."""
    found = next((n for n, df in sorted(tables.items()) if has_columns(df, wanted)), None)
    if found is None:
        raise ValueError(f"no table has the columns {', '.join(wanted)}")
    return found
