"""Pre-tokens and bytes of text columns, built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import column

#: Fixed value: what a pre-token is. (?U) gives Java's classes their Unicode meaning.
PATTERN = r"(?U)'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"


def pre_tokenize(c: Column | str) -> Column:
    """The pre-tokens of a text in order; joined they are the text. Null and empty texts have none."""
    return F.regexp_extract_all(F.coalesce(column(c), F.lit("")), F.lit(PATTERN), F.lit(0))


def text_bytes(c: Column | str) -> Column:
    """The UTF-8 bytes of a text as integers."""
    raw = F.hex(F.encode(column(c), "utf-8"))
    return F.transform(F.regexp_extract_all(raw, F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))


def pairs(c: Column | str) -> Column:
    """Neighbours in an array, as structs l, r; overlapping ones all count."""
    c = column(c)
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), lambda l, r: F.struct(l.alias("l"), r.alias("r")))


def exploded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, pre_token: one row a pre-token."""
    return docs.select(id_col, F.posexplode(pre_tokenize(text_col)).alias("pos", "pre_token"))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """pre_token, freq over all texts; a scan with partial aggregation, one shuffle of distinct pre-tokens."""
    return docs.select(F.explode(pre_tokenize(text_col)).alias("pre_token")).groupBy("pre_token").agg(F.count("*").alias("freq"))


def pair_counts(words: DataFrame) -> DataFrame:
    """l, r, n over words (toks, freq), each pair weighted by its word's frequency."""
    return words.select(F.explode(pairs("toks")).alias("p"), "freq").groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("freq").alias("n"))


def byte_words(counts: DataFrame) -> DataFrame:
    """word_id, pre_token, freq, toks (bytes) of word counts. The id is a hash of the word, the same on every run and partitioning; learning numbers words anew, as two of some 10^9 may share one."""
    return counts.select(F.xxhash64("pre_token").alias("word_id"), "pre_token", "freq", text_bytes("pre_token").alias("toks"))


def postings(words: DataFrame) -> DataFrame:
    """l, r, word_id: the distinct words of each pair."""
    return words.select("word_id", F.explode(pairs("toks")).alias("p")).select(F.col("p.l").alias("l"), F.col("p.r").alias("r"), "word_id").distinct()


def best_pair(counts: DataFrame, least: int = 2) -> DataFrame:
    """The most frequent pair, ties to the smallest; none if no pair has least."""
    return counts.where(F.col("n") >= least).orderBy(F.desc("n"), "l", "r").limit(1)
