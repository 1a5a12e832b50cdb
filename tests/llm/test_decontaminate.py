import random

import pytest

from lexmill.llm import decontaminate as D
from lexmill.llm.queries import op2_decontaminate


def brute_tiles(doc, item, least):
    """Greedy string tiling by trying every pair of places."""
    used_d, used_i, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and not used_d[p + n] and not used_i[q + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (p, q, n)
        if best is None:
            return sorted(tiles)
        p, q, n = best
        used_d[p : p + n] = used_i[q : q + n] = [True] * n
        tiles.append(best)


@pytest.mark.parametrize("seed", range(40))
def test_tiles_against_brute_force(seed):
    rng = random.Random(seed)
    item = [rng.choice("abcd") for _ in range(rng.randrange(3, 30))]
    doc = [rng.choice("abcde") for _ in range(20)] + item[: len(item) // 2] + ["x"] + item[len(item) // 3 :] + [rng.choice("ab") for _ in range(10)]
    found = D.Text(D.hashed([" ".join(doc)])[0], 3).leaks(D.hashed([" ".join(item)])[0], 0.0)
    assert found == brute_tiles(doc, item, 3)


def test_repetitive_texts_take_little_memory():
    """20,000 words against as many: of one word, of two in turn, of two at random."""
    import tracemalloc

    rng = random.Random(2)
    one, two, mixed = ["a"] * 20_000, ["a", "b"] * 10_000, [rng.choice("ab") for _ in range(20_000)]
    tracemalloc.start()
    for doc, item, tiles in ((one, one, [(0, 0, 20_000)]), (one, one[:2_000], [(0, 0, 2_000)]), (two, two[1:], [(1, 0, 19_999)]), (mixed, mixed[100:], [(100, 0, 19_900)])):
        assert D.Text(D.hashed([" ".join(doc)])[0], 5).leaks(D.hashed([" ".join(item)])[0], 0.4) == tiles
    other = [rng.choice("ab") for _ in range(3_000)]
    found = D.Text(D.hashed([" ".join(mixed)])[0], 5).leaks(D.hashed([" ".join(other)])[0], 0.4)
    assert sum(n for _, _, n in found) > 2_800 and all(mixed[p : p + n] == other[q : q + n] for p, q, n in found)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"Wort{k},  {'x' * (k % 90)}é" for k in range(500))
    whole = D.hashed([text, None, "a"])
    monkeypatch.setattr(D, "PIECE", 100)
    assert [h.tolist() for h in D.hashed([text, None, "a"])] == [h.tolist() for h in whole] and len(whole[0]) == len(D.words(text))


def test_frequent_seeds_and_many_items(spark):
    """Items that share a long opening, documents that hold only the opening, few words of an item, or all of one: as comparing all pairs."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(300)}"
    opening = [word() for _ in range(8)]
    items = [opening + [word() for _ in range(rng.choice((2, 20, 60)))] for _ in range(30)]
    docs = []
    for k in range(60):
        own = items[k % 30]
        take = rng.choice((own, own[:8], own[: len(own) // 2], own[len(own) // 2 :] + ["x"] + own[: len(own) // 2]))
        docs.append([word() for _ in range(rng.randrange(30))] + take + [word() for _ in range(rng.randrange(30))])
    want = set()
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            if sum(n for _, _, n in brute_tiles(doc, item, 5)) >= 0.4 * len(item):
                want.add((d, i))
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], f"{name} long, text string").repartition(4)
    assert {(r.doc_id, r.item_id) for r in D.find(frame(docs, "doc_id"), frame(items, "item_id")).collect()} == want
    assert {r.doc_id for r in D.clean(frame(docs, "doc_id"), frame(items, "item_id")).collect()} == set(range(60)) - {d for d, _ in want}


def test_bloom_filter(spark):
    import numpy as np

    from lexmill.llm import bloom

    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 3_000)
    made = bloom.build(spark.createDataFrame([(int(k),) for k in keys], "h long"), "h")
    assert made.has(keys.view(np.uint64)).all() and made.has(rng.integers(0, 2**63, 100_000).astype(np.uint64)).sum() < 20
    assert not bloom.build(spark.createDataFrame([], "h long"), "h").has(keys.view(np.uint64)).any()


def test_reordered_passages_are_caught(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    sentences = [[word() for _ in range(8)] for _ in range(4)]
    item = " ".join(". ".join(map(" ".join, sentences)).split()) + "."
    noise = lambda n: " ".join(word() for _ in range(n))
    moved = ". ".join(" ".join(sentences[k]) for k in (2, 0, 3, 1))
    docs = [(1, f"{noise(50)} {item.upper()} {noise(9)}"), (2, f"{noise(3)} {moved}! {noise(700)}"), (3, noise(90)), (4, None), (5, ""), (6, " ".join(sentences[0])), (1, item), (None, item)]
    bench = [(10, item), (11, item), (12, None), (13, "too short"), (14, noise(30)), (None, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as coverage")
    b = spark.createDataFrame(bench, "item_id long, text string")
    rows = D.find(df, b).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in rows) == [(0, 10), (0, 11), (1, 10), (1, 10), (1, 11), (1, 11), (2, 10), (2, 11)]
    assert all(r.matched == r.item_words == 32 and r.coverage == 1 and sum(t.length for t in r.tiles) == 32 for r in rows)
    kept = D.clean(df, b)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]


def test_empty_tables(spark):
    none_d, none_b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    assert D.find(none_d, none_b).count() == D.find(some, none_b).count() == D.find(none_d, some.toDF("item_id", "text")).count() == 0
    assert D.clean(some, none_b).count() == 1


def test_query_finds_every_passage(spark):
    sf = "/root/testdata/sf0.01"
    items = {r.item_id: " ".join(D.words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for i, t in items.items() if f" {t} " in f" {' '.join(D.words(r.text))} "}
    got = {(r.doc_id, r.item_id) for r in op2_decontaminate(spark, sf).collect()}
    assert want and want <= got
