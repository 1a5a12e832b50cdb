import shutil

import corpus_pipeline
import duckdb
import pytest
from lexmill.llm import decontaminate, quality
from lexmill.llm.queries import remainder
from lexmill.runtime import written
from pyspark.sql import functions as F
from test_minhash import brute

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = written(stage(spark, docs, SF), f"test-{name}")
        if name == "packing":
            own = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
            assert {r.doc_id for r in own} == set(before) and all(r.n == r.t for r in own)
            assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
            break
        assert out.columns == docs.columns
        kept = set(ids(out))
        if name == "language":
            assert kept == {d for d, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "quality":
            model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), remainder(5) != 0)
            assert kept == {r.doc_id for r in quality.score(docs, model).collect() if r.score >= 0.3}
            label = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
            assert sum((d in kept) == bool(label[d]) for d in before if d in label) >= 0.95 * sum(d in label for d in before)
        elif name == "near_duplicates":
            assert kept == {d for d, (_, least) in brute(list(before.items())).items() if d == least}
        else:
            items = [" ".join(decontaminate.words(t)) for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
            assert kept == {d for d, t in before.items() if not any(f" {i} " in f" {' '.join(decontaminate.words(t))} " for i in items)}
        assert {r.doc_id: r.text for r in out.collect()} == {d: before[d] for d in kept}
        docs = out


def test_odd_and_empty_tables_go_through(spark, tmp_path):
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "some words of no document at all", None, None, None), (None, None, "en", "s", 0), (-1, "", "de", None, None), (-2, "twice the same row here", "en", "s", 1), (-2, "twice the same row here", "en", "s", 1), (-3, "word " * 30_000, None, None, None)], real.schema)
    real.unionByName(odd).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    shutil.rmtree(tmp_path / "documents.parquet")
    real.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_packs_what_stays(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns[:1] == ["doc_id"] and 0 < rows.select("doc_id").distinct().count() < 200


@pytest.mark.parametrize("rows", [[(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "x y"), (3, "x y"), (None, "x y")]])
def test_repeated_rows_leave_one(spark, rows):
    from lexmill.llm import minhash

    got = sorted(tuple(r) for r in minhash.unique(spark.createDataFrame(rows, "doc_id long, text string")).na.fill(0).collect())
    assert got == [(0, "x y"), (1, "a b c d e f"), (3, "x y")]
