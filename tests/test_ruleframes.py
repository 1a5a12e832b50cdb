import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import codec
from lexmill.operators import ruleframes as R
from lexmill.operators.vocab import SPECIAL_TOKENS, Vocabulary

RULES = "priority int, l int, r int, new_token int"


def vocabulary(n, letters, seed, step=1, longest=64):
    """n rules over tokens made before, ids step apart."""
    rng = random.Random(seed)
    size = {ord(c): 1 for c in letters}
    merges, seen = [], set()
    while len(merges) < n:
        pair = rng.choice(list(size)[-400:]), rng.choice(list(size)[-400:])
        if pair in seen or size[pair[0]] + size[pair[1]] > longest:
            pair = ord(rng.choice(letters)), rng.choice(list(size))
        if pair in seen or size[pair[0]] + size[pair[1]] > longest:
            continue
        seen.add(pair)
        new = 256 + step * len(merges)
        size[new] = size[pair[0]] + size[pair[1]]
        merges.append((pair, new))
    return Vocabulary.of_merges(merges)


def plans(df):
    return df._jdf.queryExecution().toString().lower()


def test_bytes_of_many_rules(spark):
    vocab = vocabulary(10_000, "abcdefgh", 5)
    assert {r.token_id: bytes(r.bytes) for r in R.token_bytes(vocab.merges_frame(spark)).collect()} == vocab.token_bytes


def test_bytes_of_a_deep_chain(spark):
    merges = [((97, 98), 256)] + [((255 + k, 99), 256 + k) for k in range(1, 300)]
    vocab = Vocabulary.of_merges(merges)
    assert {r.token_id: bytes(r.bytes) for r in R.token_bytes(vocab.merges_frame(spark)).collect()} == vocab.token_bytes


@pytest.mark.parametrize(
    "rows",
    [
        [(0, 97, 257, 256), (1, 97, 98, 257)],  # made later
        [(0, 97, 256, 256)],  # of itself
        [(0, 97, 98, 256), (1, 97, 99, 256)],  # an id twice
        [(0, 97, 98, 256), (0, 97, 99, 257)],  # a priority twice
        [(0, 97, 400, 256)],  # of nothing
        [(0, 97, None, 256)], [(None, 97, 98, 256)], [(0, 97, 98, 98)], [(0, -1, 98, 256)],
    ],
)
def test_rules_of_no_vocabulary_raise(spark, rows):
    with pytest.raises(ValueError):
        R.token_bytes(spark.createDataFrame(rows, RULES))
    with pytest.raises(ValueError):
        R.encode_by_rules(spark.createDataFrame([("ab",)], "text string"), spark.createDataFrame(rows, RULES))


@pytest.mark.parametrize("seed,step,most", [(1, 1, R.HELD_RULES), (1, 1, 0), (2, 1, R.HELD_RULES), (3, 1500, 0), (3, 1500, R.HELD_RULES)])
def test_encoding_equals_the_heap(spark, monkeypatch, seed, step, most):
    """Random rules over few letters, so that rules wait for each other; ids on both sides of what no text may hold; rules looked up in place and joined."""
    monkeypatch.setattr(R, "HELD_RULES", most)
    vocab = vocabulary(80, "abc", seed, step, longest=40)
    rng = random.Random(seed)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["a" * 500, "ab" * 700, "".join(rng.choice("abc") for _ in range(3000)), "", None, "é \0 ab", "ab", "ab", "🎈ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    found = R.encode_by_rules(docs, vocab.merges_frame(spark))
    assert "python" not in plans(found) and "arrow" not in plans(found)
    ranks = vocab.ranks
    want = {r.n: r.ids for r in codec.encode(docs, vocab).collect()}
    assert {r.n: r.ids for r in found.collect()} == want
    assert want[400] == codec.encode_word(b"a" * 500, ranks)


def test_encoding_edges(spark):
    empty = spark.createDataFrame([], RULES)
    docs = spark.createDataFrame([("aé", "x"), ("aé", "x"), (None, "y"), ("", "z")], "text string, part string")
    rows = [(r.text, r.part, r.ids) for r in R.encode_by_rules(docs, empty, specials=True).collect()]
    assert sorted(rows, key=str) == sorted([("aé", "x", [300003, 97, 195, 169, 300001])] * 2 + [(None, "y", []), ("", "z", [])], key=str)
    rules = spark.createDataFrame([(0, 97, 98, 256), (5, 98, 97, 257), (7, 97, 98, 258)], RULES)
    # Of a pair learned twice the last counts.
    assert R.encode_by_rules(spark.createDataFrame([("aba",)], "text string"), rules).first().ids == [97, 257]
    none = R.encode_by_rules(docs.limit(0), rules)
    assert none.count() == 0 and none.columns == ["text", "part", "ids"]


@pytest.mark.parametrize("sent", [R.SENT_BYTES, 0])
def test_decoding_by_join(spark, sent):
    vocab = vocabulary(50, "abc", 9)
    rng = random.Random(9)
    ids = [[rng.randrange(310) for _ in range(rng.randrange(40))] for _ in range(200)]
    ids += [None, [], [None, 97], [999_999, 97, -1], [300_001, 98, 300_003], [195], [195, 169], [97] * 5000]
    rows = spark.createDataFrame(list(enumerate(ids)), "pos int, ids array<int>")
    for skip in (True, False):
        found = R.decode_by_join(rows, vocab.vocab_frame(spark), skip_special=skip, sent_bytes=sent)
        assert "python" not in plans(found)
        kept = rows.withColumn("ids", F.filter("ids", lambda x: x.isNotNull()))
        want = {r.pos: r.decoded for r in codec.decode(kept, vocab, skip_special=skip, jvm_tokens=0).collect()}
        assert {r.pos: r.decoded for r in found.collect()} == want
    plain = R.decode_by_join(rows, R.token_bytes(vocab.merges_frame(spark)), sent_bytes=sent)
    assert plain.where("pos = 204").first().decoded == "b"


def test_special_ids_win(spark):
    tokens = spark.createDataFrame([(97, bytearray(b"a"), False), (300001, bytearray(b"zzz"), False), *((i, bytearray(t.encode()), True) for t, i in SPECIAL_TOKENS.items())], "token_id int, bytes binary, special boolean")
    rows = spark.createDataFrame([([97, 300001],)], "ids array<int>")
    assert R.decode_by_join(rows, tokens).first().decoded == "a"
    assert R.decode_by_join(rows, tokens, skip_special=False).first().decoded == "a<|endoftext|>"


@pytest.mark.parametrize("few", [0, 256])
def test_few_rules_need_no_shuffle(spark, monkeypatch, few):
    """Rule after rule over texts where they lie, and words joined back: the same ids, the first without an exchange."""
    monkeypatch.setattr(R, "FEW_RULES", few)
    vocab = vocabulary(80, "abc", 4, 1500, longest=40)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc é\U0010ffff\n'") for _ in range(rng.randrange(80))) for _ in range(200)] + ["", None, "aaa" * 50, "a", "\x00\xff", "🎈ab"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] * 2, "n int, text string")
    found = R.encode_by_rules(docs, vocab.merges_frame(spark), specials=True)
    assert ("exchange" in plans(found)) == (few == 0)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, codec.encode(docs, vocab, specials=True).collect()), key=str)


def test_rules_out_of_turn_are_joined(spark):
    """A pair learned twice whose first token another rule uses: rule after rule would find what no word has."""
    rules = spark.createDataFrame([(0, 97, 98, 256), (1, 256, 97, 257), (2, 97, 98, 258)], RULES)
    assert R.few_in_turn(rules) == [(256, 97, 257), (97, 98, 258)]
    assert R.encode_by_rules(spark.createDataFrame([("abaab",)], "text string"), rules).first().ids == [258, 97, 258]
    # The last counts, so that the pair is merged behind a rule that uses its token.
    late = spark.createDataFrame([(0, 97, 98, 256), (1, 98, 99, 257), (2, 257, 97, 258), (3, 98, 99, 259)], RULES)
    ids = R.encode_by_rules(spark.createDataFrame([("bcabc",)], "text string"), late).first().ids
    assert ids == codec.encode_word(b"bcabc", {(97, 98): (0, 256), (98, 99): (3, 259), (257, 97): (2, 258)})


@pytest.mark.parametrize("most", [0, R.HELD_TOKENS])
@pytest.mark.parametrize("far", [300_001, (1 << 31) - 1])
def test_few_tokens_are_found_where_ids_are(spark, monkeypatch, most, far):
    """Looked up in the plan, without an exchange, and joined: the same texts; rows repeat."""
    monkeypatch.setattr(R, "HELD_TOKENS", most)
    tokens = spark.createDataFrame([*((k, bytearray([k])) for k in range(256)), (256, bytearray("é".encode())), (far, bytearray(b"far")), (-7, bytearray(b"less")), (97, bytearray(b"A"))], "token_id int, bytes binary")
    ids = [[97, 256, far, -7], [], None, [None, 98, 257, -8, far - 1], [195], [195, 169], [98] * 3]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(ids)] * 2, "k int, ids array<int>")
    found = R.decode_by_join(rows, tokens)
    assert ("exchange" in plans(found)) == (most == 0)
    want = ["aéfarless", "", None, "b", "\ufffd", "é", "bbb"]
    assert sorted((r.k, r.decoded) for r in found.where("k <> 2").collect()) == sorted((k, w) for k, w in enumerate(want) if k != 2 for _ in range(2))
    assert [r.decoded for r in found.where("k = 2").collect()] == [None, None]


def test_tokens_without_cells_of_their_own_are_joined(spark):
    """Ids that no small array tells apart; no tokens at all."""
    far = [k * 720_720 for k in range(-900, 900)]
    tokens = spark.createDataFrame([(i, bytearray(b"x")) for i in far], "token_id int, bytes binary")
    rows = spark.createDataFrame([(far[:3] + [1],)], "ids array<int>")
    assert R.decode_by_join(rows, tokens).first().decoded == "xxx"
    assert R.decode_by_join(rows, tokens.limit(0)).first().decoded == ""
