"""Reading tables, carrying rows through operators, and intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskline.shared import shared_dir, written

__all__ = ["as_rows", "discard", "shared_dir", "table", "with_id", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete tables under folder that no result reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(conf).delete(path, True)


def with_id(df: DataFrame, id_col: str, rest: str) -> StructType:
    """Schema of df's id column (of any type, a struct of whole rows as well) and further columns in DDL."""
    return StructType([df.schema[id_col], *StructType.fromDDL(rest).fields])


def as_rows(df: DataFrame) -> DataFrame:
    """(_row struct of all columns, text): lets an operator carry whole rows in place of an id; ``_row.*`` undoes it."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col("text").cast("string").alias("text"))
