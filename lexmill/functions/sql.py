"""The library's functions for SQL: temporary functions of a session."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeResult

from ..operators.codec import _encode_lists, token_texts
from ..operators.vocab import Vocabulary
from ..runtime import prepare
from . import text as X
from .pretokens import PATTERN


def literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession, vocab: Vocabulary | None = None) -> None:
    """pre_tokenize(text), strip_text(text), clean_control(text) as SQL expressions that Catalyst sees through; with a
    vocabulary also bpe_encode(text) and bpe_decode(ids), which run in Arrow batches. Null gives no ids, and null text.
    As tables, a row a token: pre_tokens(text) with pos and pre_token, bpe_tokens(text) with pos and token_id."""
    words = f"regexp_extract_all(coalesce(t, ''), {literal(PATTERN)}, 0)"
    bodies = {
        "pre_tokenize": ("array<string>", words),
        "strip_text": ("string", f"regexp_replace(t, {literal(rf'\A[{X.WS}]+|[{X.WS}]+\z')}, '')"),
        "clean_control": ("string", f"regexp_replace(t, {literal(X.CONTROL)}, '')"),
    }
    for name, (kind, body) in bodies.items():
        spark.sql(f"create or replace temporary function {name}(t string) returns {kind} return {body}")
    spark.sql(f"create or replace temporary function pre_tokens(t string) returns table(pos int, pre_token string) return select pos, col from posexplode({words})")
    if vocab is None:
        return
    prepare(spark)
    known = spark.sparkContext.broadcast((vocab.ranks, vocab.token_bytes))

    @F.arrow_udf("array<int>")
    def bpe_words(lists):
        return _encode_lists(lists, known.value[0])

    @F.arrow_udf("string")
    def bpe_decode(lists):
        return token_texts(lists, known.value[1])

    spark.udf.register("bpe_words", bpe_words)
    spark.udf.register("bpe_decode", bpe_decode)
    spark.sql("create or replace temporary function bpe_encode(t string) returns array<int> return bpe_words(pre_tokenize(t))")
    spark.sql(f"create or replace temporary function bpe_tokens(t string) returns table(pos int, token_id int) return select pos, col from (select bpe_words({words}) as ids), lateral posexplode(ids)")


def register_tokenizer(spark: SparkSession, name: str, tokenizer) -> None:
    """A table function of any object with encode(text) and decode(ids) that can be sent to the workers; what it returns depends on what it is given.

    A text: a row a token, pos, token_id and piece (what decode gives for that id alone). An array of ids: one row, text. A
    table (name(table(t), column => 'text')): its rows with a column ids more, which may not be there before. Null texts and ids: no
    rows, and null ids in tables. Rows travel in Arrow batches and stay where they are.
    """
    prepare(spark)
    # By value, so that classes of a notebook or a test can go along.
    known = spark.sparkContext.broadcast(cloudpickle.dumps(tokenizer))
    ids = T.ArrayType(T.IntegerType())

    class Tokens:
        def __init__(self):
            self.own = cloudpickle.loads(known.value)

        @staticmethod
        def analyze(given, column=None):
            if given.isTable:
                of = column.value if column is not None else "text"
                if column is not None and not column.isConstantExpression:
                    raise ValueError("column is a constant")
                fields = given.dataType.fields
                if not any(f.name == of and isinstance(f.dataType, T.StringType) for f in fields):
                    raise ValueError(f"the table has no text column {of}")
                if any(f.name.lower() == "ids" for f in fields):
                    raise ValueError("the table has a column ids")
                return AnalyzeResult(T.StructType([*fields, T.StructField("ids", ids)]))
            if column is not None:
                raise ValueError("column goes with a table")
            if isinstance(given.dataType, T.StringType):
                return AnalyzeResult(T.StructType().add("pos", T.IntegerType()).add("token_id", T.IntegerType()).add("piece", T.StringType()))
            if isinstance(given.dataType, T.ArrayType) and isinstance(given.dataType.elementType, (T.IntegerType, T.LongType)):
                return AnalyzeResult(T.StructType().add("text", T.StringType()))
            raise ValueError("a text, an array of ids or a table")

        def eval(self, given, column="text"):
            own = self.own
            if isinstance(given, str):
                for pos, i in enumerate(own.encode(given)):
                    yield pos, int(i), own.decode([i])
            elif isinstance(given, T.Row):
                text = given[column]
                yield *given, None if text is None else [int(i) for i in own.encode(text)]
            elif given is not None:
                yield (own.decode(list(given)),)

    spark.udtf.register(name, F.udtf(Tokens, useArrow=True))
