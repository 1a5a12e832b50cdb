"""Corpora of text files, tables and Python strings, all as a column text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from . import wiki


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Each line that isn't blank, stripped, is a document."""
    return spark.read.text(path, lineSep="\n").select(strip("value").alias("text")).where("text <> ''")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Each .txt file below path that isn't blank is a document, unstripped."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return files.where(strip("value") != "").select(F.col("value").alias("text"))


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: a table of one small file would keep one core busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_table(spark: SparkSession, path: str, column: str = "text", format: str = "parquet") -> DataFrame:
    return spread(spark.read.format(format).load(path).select(F.col(column).cast("string").alias("text")))


def from_strings(spark: SparkSession, texts: Iterable[str | None]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "text string")


def exists(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether path is there, and whether it is a folder, in whatever file system it names."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(conf)
    there = system.exists(place)
    return there, there and system.getFileStatus(place).isDirectory()


def read_corpus(spark: SparkSession, path: str, max_articles: int | None = None) -> DataFrame:
    """By what path is: a .bz2 dump gives articles, another file its lines, a folder its .txt files. A path that isn't there raises."""
    there, folder = exists(spark, path)
    if not there:
        raise FileNotFoundError(path)
    if folder:
        return read_folder(spark, path)
    if path.endswith(".bz2"):
        return wiki.read_articles(spark, path, max_articles=max_articles).select("text")
    return read_lines(spark, path)


#: Short, technical, prose, code, many scripts, numbers: what a benchmark of a tokenizer should meet.
BENCHMARK_TEXTS = (
    "Good morning!",
    "It rained all day, didn't it?",
    "A sentence of ordinary length says one thing and then stops.",
    "Partition pruning lets a scan skip the folders whose values no predicate admits; column pruning lets it skip the columns.",
    "The lighthouse stood on a spit of gravel.\nIn winter the sea came over it twice a day, and the keeper wrote the hours down.\n\nNobody read them.",
    "def area(shape):\n    if shape.kind == 'circle':\n        return 3.14159 * shape.r ** 2\n    return shape.w * shape.h\n",
    "Grüße aus Köln, ça va bien, ¿qué tal?, привет, 你好，こんにちは, 안녕, 🎈🎉",
    "Invoice 2024-0117: 3 x 19.99 = 59.97; total 1,234,567.89; ref 00012345678900",
)


def benchmark_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(BENCHMARK_TEXTS)), "id int, text string")
