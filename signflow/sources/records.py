"""Records of text files with their numbers, from splits read in parallel.

A file is read in splits wherever its records have a separator. A record's place is its file, the split that it begins
in, and its order there; numbers are counted split by split (a row for each split is broadcast) and within each
split, which is bounded by ``spark.sql.files.maxPartitionBytes``, so no file is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = ("file_", "split_", "row_")


def read(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """value and PLACE of each record; without a separator, of each line."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return placed(reader.text(path))


def placed(df: DataFrame) -> DataFrame:
    """``df``, read from files that can be split, with PLACE."""
    return df.select("*", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("split_"), F.monotonically_increasing_id().alias("row_"))


def counted(df: DataFrame, name: str, by_file: bool = True, what=None) -> DataFrame:
    """``df`` (with PLACE) with ``name``: how many rows (or rows where ``what`` holds) come before a row, in its file or in all files in the order of their paths."""
    one = F.lit(1) if what is None else F.coalesce(what.cast("int"), F.lit(0))
    df = df.withColumn("one_", one)
    splits = df.groupBy("file_", "split_").agg(F.sum("one_").alias("here_"))
    order = Window.partitionBy("file_").orderBy("split_") if by_file else Window.partitionBy(F.lit(0)).orderBy("file_", "split_")  # a row for each split
    before = splits.withColumn("before_", F.coalesce(F.sum("here_").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("here_")
    own = Window.partitionBy("file_", "split_").orderBy("row_").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("within_", F.coalesce(F.sum("one_").over(own), F.lit(0))).join(F.broadcast(before), ["file_", "split_"]).withColumn(name, F.col("before_") + F.col("within_")).drop("before_", "within_", "one_")
