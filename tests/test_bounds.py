"""What goes to Python workers: once, in batches of bounded bytes; patterns that take linear time."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill import runtime
from lexmill.functions import text as X
from lexmill.functions import wikitext as K
from lexmill.sources import wiki


def workers(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_texts_are_made_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(runtime, "SLICE_BYTES", 100)
    texts = ["ab" * k if k % 7 else None for k in range(60)] + ["", "x" * 5_000]
    given = pa.array(texts, pa.string())
    assert runtime.mapped(given, str.upper).to_pylist() == [t and t.upper() for t in texts]
    assert runtime.mapped(given.slice(50), str.upper).to_pylist() == [t and t.upper() for t in texts[50:]]
    assert runtime.mapped(pa.array([], pa.string()), str.upper).to_pylist() == []
    assert runtime.mapped(pa.array([None, None], pa.string()), str.upper).to_pylist() == [None, None]


@pytest.mark.parametrize("make", [X.unescape, X.normalize_unicode, X.preprocess, K.clean])
def test_columns_alone_bound_batches(spark, make):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        make("text")
        assert spark.conf.get(key) == "1024"
    finally:
        spark.conf.set(key, before)


def test_preprocess_takes_one_worker(spark):
    rows = spark.createDataFrame([(1, "e&#769; &amp;amp;"), (2, "é"), (3, "plain"), (4, None), (5, "&eacute;")], "id int, text string")
    out = rows.select("id", X.preprocess("text").alias("text"))
    assert workers(out) == 1
    assert {r.id: r.text for r in out.collect()} == {1: "é &amp;", 2: "é", 3: "plain", 4: None, 5: "é"}


def test_articles_are_read_once(spark):
    chunk = "<title>A</title><ns>0</ns><revision><text>{{x}}café &amp;amp; '''tea'''</text></revision></"
    pages = wiki.parse_pages(spark.createDataFrame([(chunk,), ("<",)], "value string"))
    out = wiki.articles(pages, min_length=3)
    # The scanner and what decodes and composes; once each, though a filter on the length follows.
    assert workers(out) == 2
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1
    assert [(r.title, r.text) for r in out.collect()] == [("A", "café & tea")]
    assert wiki.articles(pages, min_length=30).count() == 0


def test_long_runs_take_linear_time(spark):
    n = 300_000
    rows = [(1, "x" * n), (2, "@" * n), (3, "a" + " " * n + "b "), (4, "x" * n + "@y.z k"), (5, "@@a.b @a.b a@.b a@b. a@b.c! me@x")]
    docs = spark.createDataFrame(rows, "id int, text string")
    start = time.perf_counter()
    out = {r.id: (r.e, r.s) for r in docs.select("id", X.strip_emails("text").alias("e"), X.strip("text").alias("s")).collect()}
    assert time.perf_counter() - start < 20
    assert out[1][0] == rows[0][1] and out[2][0] == rows[1][1] and out[4][0] == " k"
    assert out[3][1] == rows[2][1][:-1]
    assert out[5][0] == " @a.b a@.b a@b.  me@x"
