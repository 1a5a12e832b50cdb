"""Whole binary files through Spark's own writers and readers.

The text source writes each string's bytes as they are, then one line feed. With one row a file,
every file is that row's bytes and the line feed, committed by Spark's output protocol: it works on
any file system that Spark knows, and a lost task leaves nothing behind. File formats written here
therefore end in a line feed that is part of the format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_blobs(df: DataFrame, column: str, path: str, by: tuple[str, ...] = ()) -> None:
    """One file for each row of df; the bytes in column must end in a line feed. by: columns whose values name folders."""
    body = F.expr(f"substring(`{column}`, 1, octet_length(`{column}`) - 1)")
    df.select(body.cast("string").alias("value"), *by).write.partitionBy(*by).option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def read_blobs(spark: SparkSession, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """content and the columns by of the files of write_blobs; where only the latter are asked for no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    return files.select("content", *(F.col(c) if c in files.columns else F.lit(None).cast("string").alias(c) for c in by))
