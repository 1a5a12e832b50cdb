"""Streams of texts: cleaning and encoding work row by row; words are counted with running totals, or batch by batch for learning.

Everything in functions and operators.codec (mode "map") takes streaming frames as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.pretokens import byte_words, pair_counts, pre_tokenize, word_counts
from ..functions.text import preprocess
from ..operators.codec import encode
from ..operators.vocab import Vocabulary
from ..sources.files import exists


def read_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def clean_and_encode(stream: DataFrame, vocab: Vocabulary, text_col: str = "text", **options) -> DataFrame:
    """stream with its text preprocessed and a column ids."""
    return encode(stream.withColumn(text_col, preprocess(text_col, **options)), vocab, text_col=text_col)


def running_word_counts(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """pre_token, freq so far; for output modes update and complete."""
    return word_counts(stream, text_col)


def windowed_word_counts(stream: DataFrame, time_col: str, length: str, late: str, text_col: str = "text") -> DataFrame:
    """pre_token, freq in windows of event time; rows later than late are dropped, so state stays bounded and mode append works."""
    words = stream.withWatermark(time_col, late).select(F.window(time_col, length).alias("window"), F.explode(pre_tokenize(text_col)).alias("pre_token"))
    return words.groupBy("window", "pre_token").agg(F.count("*").alias("freq"))


# Learning from a stream. Counts of words, and of the pairs in them, are sums over batches: each batch leaves its own
# in a folder of its number, and a batch that runs again after a failure puts the same ones in their place. Nothing is
# held between batches, and the work of a batch doesn't grow with what was read before.

WORD_COUNTS, PAIR_COUNTS = "words", "pairs"
BATCH = "pre_token string, freq long, batch long"
PAIRS = "l int, r int, n long, batch long"


def count_batches(stream: DataFrame, folder: str, checkpoint: str, text_col: str = "text", pairs: bool = True, **trigger) -> StreamingQuery:
    """Start a query that writes the counts of each batch's words and byte pairs below folder, on a file system that all share.

    checkpoint: where Spark keeps how far it has read; a query started anew with the same two goes on from there.
    trigger: as DataStreamWriter.trigger has it. Null and empty texts have no words. Without pairs only words are counted, which is what learning reads.
    """

    def count(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        words = f"{folder}/{WORD_COUNTS}/batch={number}"
        word_counts(batch, text_col).write.mode("overwrite").parquet(words)
        if pairs:
            pair_counts(byte_words(spark.read.parquet(words))).write.mode("overwrite").parquet(f"{folder}/{PAIR_COUNTS}/batch={number}")

    writer = stream.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def _totals(spark: SparkSession, folder: str, kind: str, schema: str, keys: list[str], count: str) -> DataFrame:
    place, name = f"{folder}/{kind}", schema.rsplit(",", 1)[0]
    if not exists(spark, place)[0]:
        return spark.createDataFrame([], name)
    return spark.read.schema(schema).parquet(place).groupBy(*keys).agg(F.sum(count).alias(count))


def word_totals(spark: SparkSession, folder: str) -> DataFrame:
    """pre_token, freq over all batches so far, as word_counts gives over the same rows; for train.train_counts. No batch: no rows."""
    return _totals(spark, folder, WORD_COUNTS, BATCH, ["pre_token"], "freq")


def pair_totals(spark: SparkSession, folder: str) -> DataFrame:
    """l, r, n of byte pairs over all batches so far, as pair_counts of word_totals gives."""
    return _totals(spark, folder, PAIR_COUNTS, PAIRS, ["l", "r"], "n")
