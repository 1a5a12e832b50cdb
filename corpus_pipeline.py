"""From documents to packed training sequences: language, quality, near copies, benchmark passages, packing.

Each stage takes what its predecessor kept, read from Parquet, and returns the rows that stay, with all
their columns; the last returns the packed pieces. Empty tables go through every stage; null ids, null
texts, repeated rows and further columns are treated as each operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import decontaminate, langid, minhash, packing, quality
from lexmill.llm.queries import piece_digests, remainder
from lexmill.runtime import temporary, written

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (und) go."""
    return langid.accept(docs, langid.fit(docs, remainder(3) != 1))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learned from labels scores below LEAST_QUALITY go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(5) != 0)
    return quality.accept(docs, model, LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.unique(docs, percent=75)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), kind="word", end_id=1, capacity=2048, max_segments=2048))


STAGES = [("language", language), ("quality", quality_stage), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]

#: No stage of models can be told in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. What the stages wrote goes with them, but for the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary(spark) as scope:
        for name, stage in STAGES:
            with temporary(spark) as own:
                docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
                own.keep(docs)
        scope.keep(docs)
    return docs
