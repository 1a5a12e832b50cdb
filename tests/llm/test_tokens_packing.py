import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexmill.llm import packing
from lexmill.llm.queries import op1_packing
from lexmill.llm.tokens import Encoder

FILES = {"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}
ENCODERS = {k: Encoder(public_tokenizers.path(f), k) for k, f in FILES.items()}
PLAIN = {k: Tokenizer.from_file(public_tokenizers.path(f)) for k, f in FILES.items()}
for t in PLAIN.values():
    t.encode_special_tokens = True
ODD = "ab'sTé \n\t\r\x0b\x1c\x85\xa0  。1٣!<|endoftext|>İß’́ 🎉ſ"


@pytest.mark.parametrize("kind", ["word", "byte"])
@given(text=st.text(alphabet=ODD, max_size=60))
@settings(max_examples=1500, deadline=None)
def test_chunks_encode_as_whole_texts(kind, text):
    assert np.frombuffer(ENCODERS[kind].encode([text])[0], "<u4").tolist() == PLAIN[kind].encode(text, add_special_tokens=False).ids


def check_pieces(rows, docs, capacity, segments, loss):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, ids in docs.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[at : at + r.length]
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and len(own) <= segments and sum(r.loss_tokens for r in own) <= loss
    return by_seq


def test_limits_and_whole_documents(spark):
    rng = np.random.default_rng(3)
    texts = {i: " ".join(["the", "rivers", "of", "ünlü"][j] for j in rng.integers(0, 4, n)) for i, n in enumerate(rng.integers(0, 90, 300))} | {900: "word " * 5000, 901: None, 902: ""}
    df = spark.createDataFrame([(i, t, "user" if i % 3 == 0 else None if i % 7 == 0 else "assistant", 1) for i, t in texts.items()], "doc_id long, text string, role string, start int").repartition(3, "doc_id")
    rows = packing.pack(df, public_tokenizers.path(FILES["word"]), capacity=64, max_segments=4, max_loss=40, loss="role = 'assistant'").collect()
    docs = {i: (PLAIN["word"].encode(t, add_special_tokens=False).ids if t else []) + [1] for i, t in texts.items()}
    check_pieces(rows, docs, 64, 4, 40)
    assert {r.loss_tokens for r in rows if r.doc_id % 3 == 0} == {0}


def test_little_padding(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    rows = packing.pack(df, public_tokenizers.path(FILES["word"])).collect()
    docs = {r.doc_id: PLAIN["word"].encode(r.text, add_special_tokens=False).ids + [1] for r in df.collect()}
    seqs = check_pieces(rows, docs, 2048, 256, 2048)
    assert sum(sum(r.length for r in s) != 2048 for s in seqs.values()) <= 1


def test_empty_and_repeated(spark):
    path = public_tokenizers.path(FILES["word"])
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (2, None)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, path).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 2), (1, 2), (1, 2), (2, 1)]
    assert packing.pack(df, path, end_id=None).count() == 3
    with pytest.raises(ValueError):
        packing.pack(df, path, capacity=0)


def test_query(spark):
    got = {(r.doc_id, r.start): r for r in op1_packing(spark, "/root/testdata/sf0.001").collect()}
    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert {d for d, _ in got} == {d for d, _ in docs}
    for doc, text in docs:
        ids = PLAIN["word"].encode(text, add_special_tokens=False).ids + [1]
        own = [r for (d, _), r in got.items() if d == doc]
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
        assert sum(r.length for r in own) == len(ids)


def test_conversations_with_loss_on_answers(spark):
    """All turns of a conversation are one example, the assistant's bear loss: every limit binds, each id is in one piece, and the spans are the answers' ids."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    turns.createOrReplaceTempView("turns")
    examples = spark.sql("select conv_id, transform(array_sort(collect_list(struct(turn, role, text))), x -> struct(x.text as text, x.role = 'assistant' as loss)) as parts from turns group by conv_id").coalesce(1)
    want = {}
    for r in examples.collect():
        ids, bears = [], []
        for p in r.parts:
            own = PLAIN["word"].encode(p.text, add_special_tokens=False).ids if p.text else []
            ids, bears = ids + own, bears + [p.loss] * len(own)
        want[r.conv_id] = (ids + [1], bears + [r.parts[-1].loss])
    share = sum(sum(b) for _, b in want.values()) / sum(len(i) for i, _ in want.values())
    assert 0.1 < share < 0.9
    for segments, loss in ((64, int(512 * share * 0.8)), (64, 512), (2, 512)):
        rows = packing.pack(examples, public_tokenizers.path(FILES["word"]), id_col="conv_id", parts="parts", capacity=512, max_segments=segments, max_loss=loss).collect()
        seqs = check_pieces(rows, {d: i for d, (i, _) in want.items()}, 512, segments, loss)
        for r in rows:
            bears = want[r.doc_id][1][r.start : r.start + r.length]
            marked = [any(s.start <= k < s.start + s.length for s in r.loss_spans) for k in range(r.length)]
            assert marked == bears and r.loss_tokens == sum(bears)
        # Hardly more sequences than the scarcest of the three limits asks for, which is the loss in the first round.
        least = [sum(len(i) for i, _ in want.values()) / 512, sum(sum(b) for _, b in want.values()) / loss, len(want) / segments]
        assert len(seqs) <= 1.02 * max(least) + 2 and (max(least) == least[1]) == (loss < 512)


def test_odd_parts(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, (None, True), ("", None)]), (4, [("a b", None), ("c", True)]), (None, [("a", True)])], "doc_id long, p array<struct<text:string,loss:boolean>>").coalesce(1)
    rows = {r.doc_id: (r.length, r.loss_tokens, [tuple(s) for s in r.loss_spans]) for r in packing.pack(df, public_tokenizers.path(FILES["word"]), parts="p").collect()}
    assert rows == {1: (1, 0, []), 2: (1, 0, []), 3: (1, 0, []), 4: (4, 2, [(2, 2)]), None: (2, 2, [(0, 2)])}


@pytest.mark.parametrize("text", ["", "a", "a b"])
def test_tiny_texts_fill_sequences(spark, text):
    """Thousands of texts of one to three ids: all sequences but a partition's last are full."""
    docs = spark.createDataFrame([(k, text) for k in range(9_000)], "doc_id long, text string").repartition(2)
    rows = packing.pack(docs, public_tokenizers.path(FILES["word"]), kind="word", max_segments=2048).groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] < 2048 for r in rows) <= 2 and sum(r[1] for r in rows) == 9_000 * (1 + len(text.split()))
