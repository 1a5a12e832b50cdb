import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lexmill.functions import pretokens as P
from lexmill.functions import wikitext
from lexmill.operators import train
from lexmill.sources import wiki
from lexmill.streaming import text as streaming

PAGES = [
    ("Long", "0", "word " * 200), ("Short", "0", "a few words"), ("Talk", "1", "word " * 200), ("List of x", "0", "word " * 200), ("Empty", "0", ""), ("None", "0", None),
    ("Away", "0", "#REDIRECT [[Long]]"), (None, None, "word " * 200), ("Twice", "0", "word " * 200), ("Twice", "0", "word " * 200),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "title string, ns string, text string")


def test_counts_come_from_the_same_pass(spark):
    seen = Observation()
    found = wiki.articles(pages(spark), observation=seen)
    rows = sorted((str(r.title), r.text) for r in found.collect())
    assert rows == sorted((str(r.title), r.text) for r in wiki.articles(pages(spark)).collect())
    assert seen.get == {"pages": 10, "not_articles": 5, "unreadable": 0, "short": 1, "kept": 4}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1


def test_unreadable_pages_are_counted(spark, monkeypatch):
    monkeypatch.setattr(wikitext, "plain_column", lambda c: F.when(F.length(c) > 100, F.lit(None).cast("string")).otherwise(F.col("text")))
    seen = Observation()
    assert wiki.articles(pages(spark), observation=seen).count() == 0
    assert seen.get["unreadable"] == 4 and seen.get["short"] == 1 and seen.get["kept"] == 0


def test_counts_of_nothing_and_of_a_limit(spark):
    seen = Observation()
    assert wiki.articles(pages(spark).limit(0), observation=seen).count() == 0
    assert set(seen.get.values()) == {0}
    with pytest.raises(ValueError):
        wiki.articles(pages(spark), max_articles=1, observation=Observation())


def test_stream_counts_equal_the_batch(spark, tmp_path):
    texts, counts, checkpoint = (f"{tmp_path}/{name}" for name in ("texts", "counts", "checkpoint"))
    assert streaming.word_totals(spark, counts).count() == 0 and streaming.pair_totals(spark, counts).columns == ["l", "r", "n"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    docs = docs.unionByName(spark.createDataFrame([(None,), ("",), ("é" * 3,), ("same same",), ("same same",)], "text string"))

    def run():
        stream = streaming.read_stream(spark, texts, docs.schema, max_files=1)
        query = streaming.count_batches(stream, counts, checkpoint, availableNow=True)
        query.awaitTermination()

    first, second = docs.randomSplit([0.5, 0.5], seed=3)
    first.repartition(2).write.parquet(texts)
    run()
    # A batch whose end was never noted runs again after a restart, and counts once.
    commits = sorted((int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()))
    for name in (f"{commits[-1]}", f".{commits[-1]}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    second.repartition(2).write.mode("append").parquet(texts)
    run()
    words = {r.pre_token: r.freq for r in P.word_counts(docs).collect()}
    assert {r.pre_token: r.freq for r in streaming.word_totals(spark, counts).collect()} == words
    pairs = {(r.l, r.r): r.n for r in P.pair_counts(P.byte_words(P.word_counts(docs))).collect()}
    assert {(r.l, r.r): r.n for r in streaming.pair_totals(spark, counts).collect()} == pairs
    learned = train.train_counts(streaming.word_totals(spark, counts), vocab_size=300)
    assert learned == train.train(docs, vocab_size=300)


def test_counts_to_learn_from_are_worked_out_once(spark, tmp_path):
    """Sums of batches are not added up again by each pass of the learner over them."""
    worked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            worked.add(batch.num_rows)
            yield batch

    words = [("hello", 5), (" help", 4), ("held", 3), ("low", 2)]
    counts = spark.createDataFrame(words, "pre_token string, freq long").mapInArrow(seen, "pre_token string, freq long")
    for most in (0, 100):
        before = worked.value
        assert train.train_counts(counts, vocab_size=260, kernel_words=most).num_merges == 4
        assert worked.value - before == len(words)


def test_stream_counts_words_alone(spark, tmp_path):
    texts, counts, checkpoint = (f"{tmp_path}/{name}" for name in ("texts", "counts", "checkpoint"))
    docs = spark.createDataFrame([("a b a",), (None,)], "text string")
    docs.write.parquet(texts)
    streaming.count_batches(streaming.read_stream(spark, texts, docs.schema), counts, checkpoint, pairs=False, availableNow=True).awaitTermination()
    assert {r.pre_token: r.freq for r in streaming.word_totals(spark, counts).collect()} == {"a": 1, " b": 1, " a": 1}
    assert not os.path.exists(f"{counts}/{streaming.PAIR_COUNTS}")
