"""Encoding and decoding of whole batches against one word and one list at a time."""

import random

import pyarrow as pa
import pytest

from lexmill.operators import codec
from lexmill.operators.vocab import SPECIAL_TOKENS, Vocabulary

WORDS = ["", "a", "aaa", "aaaa", "aaaaa", "abab", "the", " the", "é", "ß𝕳", "\x00", "\U0010ffff", "bababa", "thethe"]
RULES = [(97, 97), (97, 98), (256, 256), (257, 257), (195, 169), (116, 104), (261, 101), (258, 97)]


def one_by_one(words, ranks):
    return [codec.encode_word(w.encode(), ranks) for w in words]


def test_rules_in_turn_are_the_lowest_first():
    rng = random.Random(5)
    for trial in range(40):
        rules = []
        while len(rules) < 12:
            pair = tuple(rng.choice([97, 98, 99, *range(256, 256 + len(rules))]) for _ in range(2))
            if pair not in rules:
                rules.append(pair)
        ranks = Vocabulary.of_merges(rules).ranks
        words = WORDS + ["".join(rng.choice("abc") for _ in range(rng.randrange(20))) for _ in range(60)]
        assert codec._in_turn(ranks)
        values, sizes = codec._encoded_at_once(words, ranks)
        ends = sizes.cumsum()
        assert [values[e - n : e].tolist() for e, n in zip(ends, sizes)] == one_by_one(words, ranks)


def test_other_rules_go_word_by_word(monkeypatch):
    assert not codec._in_turn(Vocabulary.of_merges([((97, 98), 300), ((300, 97), 301), ((97, 98), 300)]).ranks)
    assert codec._in_turn({}) and codec._in_turn(Vocabulary.of_merges(RULES).ranks)
    monkeypatch.setattr(codec, "FEW_RULES", 3)
    assert not codec._in_turn(Vocabulary.of_merges(RULES).ranks)


@pytest.mark.parametrize("few", [0, 256])
def test_lists_keep_their_words(monkeypatch, few):
    monkeypatch.setattr(codec, "FEW_RULES", few)
    ranks = Vocabulary.of_merges(RULES).ranks
    lists = [WORDS, [], None, ["aaa", "aaa"], WORDS[::-1], None]
    want = [[i for w in words or () for i in codec.encode_word(w.encode(), ranks)] for words in lists]
    assert codec._encode_lists(pa.array(lists, pa.list_(pa.string())), ranks).to_pylist() == want
    assert codec._encode_lists(pa.array(lists, pa.list_(pa.string())).slice(2), ranks).to_pylist() == want[2:]
    assert codec._encode_lists(pa.array([], pa.list_(pa.string())), ranks).to_pylist() == []
    assert codec._encode_lists(pa.array([None, []], pa.list_(pa.string())), ranks).to_pylist() == [[], []]


@pytest.mark.parametrize("far", [300_000, 1 << 30])
def test_lists_become_texts(far):
    table = {**Vocabulary.of_merges(RULES).token_bytes, far: b"far"}
    lists = [[97, 256, 257], [], None, [-1, 97, far, far + 1, None], [195, 97], [195, 169, 300_003, 260], [(1 << 31) - 1], None]
    want = [None if x is None else b"".join(table.get(i, b"") for i in x).decode("utf-8", "replace") for x in lists]
    for kind in (pa.int32(), pa.int64()):
        given = pa.array(lists, pa.list_(kind))
        assert codec.TokenTable(table).texts(given).to_pylist() == want
        assert codec.TokenTable(table).texts(given.slice(1, 3)).to_pylist() == want[1:4]
    assert codec.TokenTable({}).texts(pa.array([[1]], pa.list_(pa.int32()))).to_pylist() == [""]


def test_decoding_in_the_plan_and_in_workers(spark):
    vocab = Vocabulary.of_merges(RULES)
    ids = [[97, 256, 300_001], [], None, [999_999, -1, 195, 97], [300_003, 104], [195, 169, 263, 264]]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "k int, ids array<int>")
    for skip in (True, False):
        own, plan = (codec.decode(rows, vocab, skip_special=skip, jvm_tokens=n).orderBy("k") for n in (0, 2_000))
        assert own.collect() == plan.collect()
        assert own._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    # Only special tokens are searched for, the others lie in an array.
    assert "map(" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert SPECIAL_TOKENS["<|endoftext|>"] == 300_001
