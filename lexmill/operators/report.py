"""How well and how fast a vocabulary encodes."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import prepare
from .codec import decode, encode
from .vocab import Vocabulary


def totals(docs: DataFrame, vocab: Vocabulary, by: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """total_tokens, total_chars, tokens_per_char, chars_per_token, roundtrip_errors over docs, or for each group of by."""
    rows = decode(encode(docs, vocab, text_col=text_col), vocab)
    tokens, chars = F.sum(F.size("ids")).cast("long"), F.sum(F.length(text_col)).cast("long")
    out = rows.groupBy(*(by or [])).agg(tokens.alias("total_tokens"), chars.alias("total_chars"), F.count_if(~F.col("decoded").eqNullSafe(F.coalesce(F.col(text_col), F.lit("")))).alias("roundtrip_errors"))
    ratio = lambda x, y: F.when(F.col(y) != 0, F.col(x) / F.col(y))
    return out.withColumns({"tokens_per_char": ratio("total_tokens", "total_chars"), "chars_per_token": ratio("total_chars", "total_tokens")})


def benchmark(docs: DataFrame, vocab: Vocabulary, name: str, iterations: int = 1, text_col: str = "text") -> dict:
    """The totals with the wall time of encoding docs iterations times; the round trip is checked outside that time."""
    rows = docs.select(F.col(text_col).alias("text")).persist()
    encode(rows.limit(3), vocab).select(F.sum(F.size("ids"))).first()
    start = time.perf_counter()
    for _ in range(iterations):
        encode(rows, vocab).select(F.sum(F.size("ids"))).first()
    elapsed = time.perf_counter() - start
    found = totals(rows, vocab).first().asDict()
    rows.unpersist()
    tokens, chars = (iterations * (found[c] or 0) for c in ("total_tokens", "total_chars"))
    return {
        "name": name, "total_time": elapsed, "iterations": iterations, "total_tokens": tokens, "total_chars": chars, "tokens_per_char": found["tokens_per_char"],
        "chars_per_token": found["chars_per_token"], "throughput_chars": chars / elapsed, "roundtrip_errors": found["roundtrip_errors"],
    }


def benchmark_other(docs: DataFrame, tokenizer, name: str, iterations: int = 1, text_col: str = "text") -> dict:
    """As benchmark, of any object with encode(text) and decode(ids) that can be sent to the workers; null texts count as empty."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [list(tokenizer.encode(t)) for t in texts]
            wrong = [tokenizer.decode(i) != t for i, t in zip(ids, texts)] if check else [False] * len(texts)
            yield pa.RecordBatch.from_arrays([pa.array([len(i) for i in ids], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(wrong, pa.bool_())], names=["tokens", "chars", "wrong"])

    def sums():
        shape = "tokens long, chars long, wrong boolean"
        return rows.mapInArrow(run, shape).agg(F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"), F.count_if("wrong").alias("wrong")).first()

    rows = docs.select(F.col(text_col).cast("string").alias("text")).persist()
    check = True
    found = sums()
    check = False
    start = time.perf_counter()
    for _ in range(iterations):
        sums()
    elapsed = time.perf_counter() - start
    rows.unpersist()
    tokens, chars = found.tokens or 0, found.chars or 0
    return {
        "name": name, "total_time": elapsed, "iterations": iterations, "total_tokens": iterations * tokens, "total_chars": iterations * chars, "tokens_per_char": tokens / chars if chars else None,
        "chars_per_token": chars / tokens if tokens else None, "throughput_chars": iterations * chars / elapsed, "roundtrip_errors": found.wrong,
    }


def compare(own: dict, other: dict) -> dict:
    """token_efficiency: other's tokens by own; speed_ratio: own characters a second by other's."""
    return {"token_efficiency": other["total_tokens"] / own["total_tokens"], "speed_ratio": own["throughput_chars"] / other["throughput_chars"]}


def compare_totals(docs: DataFrame, own: Vocabulary, other: Vocabulary, by: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """own_tokens, other_tokens, chars, token_efficiency (other's tokens by own) and both round trips' errors, over docs or for each group of by.

    One pass, both vocabularies side by side; a group without tokens has no efficiency. Null texts count as empty.
    """
    rows = docs.select(*(by or []), F.coalesce(text_col, F.lit("")).alias("__text"))
    for vocab, name in ((own, "own"), (other, "other")):
        rows = decode(encode(rows, vocab, text_col="__text", out=f"__{name}_ids"), vocab, ids_col=f"__{name}_ids", out=f"__{name}_text")
    sums = [F.coalesce(F.sum(F.size(f"__{name}_ids")), F.lit(0)).cast("long").alias(f"{name}_tokens") for name in ("own", "other")]
    wrong = [F.count_if(F.col(f"__{name}_text") != F.col("__text")).alias(f"{name}_errors") for name in ("own", "other")]
    out = rows.groupBy(*(by or [])).agg(*sums, F.coalesce(F.sum(F.length("__text")), F.lit(0)).cast("long").alias("chars"), *wrong)
    return out.withColumn("token_efficiency", F.when(F.col("own_tokens") != 0, F.col("other_tokens") / F.col("own_tokens")))
