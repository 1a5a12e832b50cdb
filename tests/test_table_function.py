import pytest
from pyspark.errors import AnalysisException

from lexmill.functions.sql import register_tokenizer
from lexmill.operators import report
from lexmill.operators.vocab import Vocabulary

ROWS = [(1, "ab", "x"), (2, None, "x"), (3, "", "y"), (3, "é🎈", None)]


def reversed_letters():
    # Local, so that it is sent to the workers by value.
    class Reversed:
        def encode(self, text):
            return [ord(c) for c in reversed(text)]

        def decode(self, ids):
            return "".join(map(chr, reversed(ids)))

    return Reversed()


@pytest.fixture
def docs(spark):
    register_tokenizer(spark, "rev", reversed_letters())
    return spark.createDataFrame(ROWS, "id int, text string, pos string")


def test_rows_of_tokens(spark, docs):
    found = spark.sql("select id, t.* from {d} d, lateral rev(d.text) t", d=docs).collect()
    assert sorted(map(tuple, found)) == [(1, 0, 98, "b"), (1, 1, 97, "a"), (3, 0, 127880, "🎈"), (3, 1, 233, "é")]


def test_tables_keep_their_rows(spark, docs):
    found = spark.sql("select * from rev(table({d}))", d=docs)
    assert found.columns == ["id", "text", "pos", "ids"]
    want = [(i, t, p, None if t is None else reversed_letters().encode(t)) for i, t, p in ROWS]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert spark.sql("select * from rev(table({d}))", d=docs.limit(0)).count() == 0
    named = spark.sql("select ids from rev(table({d}), column => 'pos')", d=docs)
    assert sorted(map(str, (r.ids for r in named.collect()))) == sorted(map(str, [[120], [120], [121], None]))
    back = spark.sql("select r.id, t.text from {r} r, lateral rev(r.ids) t", r=found)
    assert sorted(map(tuple, back.collect())) == [(1, "ab"), (3, ""), (3, "é🎈")]


@pytest.mark.parametrize("call", ["rev(table({d}), column => 'id')", "rev(table({d}), column => 'none')", "rev(1)", "rev('a', column => 'text')", "rev(array('a'))"])
def test_what_it_does_not_take(spark, docs, call):
    with pytest.raises(AnalysisException):
        spark.sql(f"select * from {call}", d=docs)
    with pytest.raises(AnalysisException):
        spark.sql("select * from rev(table({d}))", d=docs.withColumnRenamed("id", "IDS"))


def test_two_vocabularies_side_by_side(spark, docs):
    own = Vocabulary.of_merges([(97, 98)])
    found = {r.pos: r for r in report.compare_totals(docs, own, Vocabulary(), by=["pos"]).collect()}
    assert tuple(found["x"]) == ("x", 1, 2, 2, 0, 0, 2.0)
    assert tuple(found["y"]) == ("y", 0, 0, 0, 0, 0, None)
    assert tuple(found[None]) == (None, 6, 6, 2, 0, 0, 1.0)
    assert tuple(report.compare_totals(docs.limit(0), own, own).first()) == (0, 0, 0, 0, 0, None)
