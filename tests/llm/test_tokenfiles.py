import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexmill.llm import rans, tokenfiles
from lexmill.llm.queries import op7_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.integers(0, 40), max_size=3000))
@settings(max_examples=60, deadline=None)
def test_rans_round_trip(tokens):
    x = np.array(tokens, dtype=np.uint32)
    counts = np.bincount(x, minlength=1)
    table = rans.Table.from_bytes(rans.Table.of_counts({i: int(n) for i, n in enumerate(counts) if n}).to_bytes())
    states, words = rans.encode(x, table)
    assert (rans.decode(len(x), states, words, table) == x).all()


def test_rans_is_close_to_entropy():
    rng = np.random.default_rng(1)
    x = np.minimum(rng.zipf(1.3, 400_000), 50_000).astype(np.uint32)
    counts = np.bincount(x)
    table = rans.Table.of_counts({int(i): int(counts[i]) for i in np.flatnonzero(counts)})
    states, words = rans.encode(x, table)
    p = counts[counts > 0] / len(x)
    assert 32 * len(words) / len(x) < 1.01 * -(p * np.log2(p)).sum() + 0.1
    assert (rans.decode(len(x), states, words, table) == x).all()


def test_damage_is_found():
    x = np.arange(1000, dtype=np.uint32) % 7
    table = rans.Table.of_counts({i: 143 for i in range(7)})
    block = bytearray(tokenfiles.pack_block([1], [1000], x, table))
    assert tokenfiles.unpack_block(memoryview(bytes(block)), 0, table)[0][1] == x.astype("<u4").tobytes()
    block[-3] ^= 1
    with pytest.raises(ValueError):
        tokenfiles.unpack_block(memoryview(bytes(block)), 0, table)
    with pytest.raises(ValueError):
        rans.encode(np.array([9], dtype=np.uint32), table)


def test_checkpoints_start_anywhere():
    table = rans.Table.of_counts({i: 1 for i in range(9)})
    blocks = [(1, 5 * k, tokenfiles.pack_block([k], [5 * k], np.full(5 * k, k, np.uint32), table)) for k in range(1, 5)]
    data = tokenfiles.pack_file(3, blocks, 77)
    every = list(tokenfiles.unpack_file(data, table, 77))
    assert [(d, s) for d, s, _ in every] == [(1, 0), (2, 5), (3, 15), (4, 30)]
    for first in range(0, 52):
        for last in (first, first + 1, first + 7, 60):
            assert list(tokenfiles.unpack_file(data, table, 77, first, last)) == [(d, s, i) for d, s, i in every if s < last and s + len(i) // 4 > first]
    # Blocks outside aren't decoded: damage there goes unnoticed.
    damaged = bytearray(data)
    damaged[-9] ^= 1
    assert list(tokenfiles.unpack_file(bytes(damaged), table, 77, 0, 20)) == every[:3]
    with pytest.raises(ValueError):
        list(tokenfiles.unpack_file(bytes(damaged), table, 77))
    with pytest.raises(ValueError):
        list(tokenfiles.unpack_file(data, table, 78))


def test_files_hold_every_text(spark):
    texts = {5: "plain words", 3: None, -2: "", 9: "é 🎉 " * 4000, 7: "plain words", 11: "a\n\n  b"}
    df = spark.createDataFrame([*texts.items(), (None, "x"), (7, "again")], "doc_id long, text string").withColumnRenamed("doc_id", "start").repartition(3)
    path = tokenfiles.new_path(spark)
    tokenfiles.write_tokens(df, path, PATH, id_col="start", file_tokens=64)
    rows = tokenfiles.read_tokens(spark, path).collect()
    plain = Tokenizer.from_file(PATH)
    want = sorted((plain.encode(t or "", add_special_tokens=False).ids + [0] for t in [*texts.values(), "x", "again"]))
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in rows) == want
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, -2, 3, 5, 7, 7, 9, 11]
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    for first, last in ((0, 1), (0, at), (5, 9), (at - 1, at), (at, at + 9), (100, 3000), (7, 7)):
        got = sorted((r.start, bytes(r.ids)) for r in tokenfiles.read_tokens(spark, path, first, last).collect())
        assert got == [(r.start, bytes(r.ids)) for r in rows if r.start < last and r.start + r.n_tokens > first]


def test_empty_table(spark):
    path = tokenfiles.new_path(spark)
    tokenfiles.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert tokenfiles.read_tokens(spark, path).count() == 0


def test_query(spark):
    rows = sorted(op7_token_files(spark, "/root/testdata/sf0.001").collect())
    plain, at = Tokenizer.from_file(PATH), 0
    for r, d in zip(rows, sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect(), key=lambda d: d.doc_id), strict=True):
        ids = plain.encode(d.text, add_special_tokens=False).ids + [0]
        assert tuple(r) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_repeated_ids_keep_their_order(spark):
    """Documents that share an id, or have none, lie in the same places whatever the partitions and files."""
    rows = [(k % 3 if k % 5 else None, f"text number {k} " * (k % 7)) for k in range(200)]
    found = []
    for parts in (1, 7):
        path = tokenfiles.new_path(spark)
        df = spark.createDataFrame(rows if parts == 1 else rows[::-1], "doc_id long, text string").repartition(parts)
        tokenfiles.write_tokens(df, path, PATH, file_tokens=100)
        found.append([(r.doc_id, r.start, bytes(r.ids)) for r in tokenfiles.read_tokens(spark, path).orderBy("start").collect()])
    assert found[0] == found[1] and len(found[0]) == 200
