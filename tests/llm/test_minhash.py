import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.llm import minhash
from lexmill.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    """docs: (id, text); id to (shingles, component)."""
    sets = [(i, shingles(t)) for i, t in docs]
    near = {k: [] for k in range(len(sets))}
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 75 * (len(sets[a][1]) + len(sets[b][1]) - both):
                near[a].append(b)
                near[b].append(a)
    out = {}
    for k in near:
        seen, todo = {k}, [k]
        while todo:
            for n in near[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        out[sets[k][0]] = (len(sets[k][1]), min(sets[s][0] for s in seen))
    return out


def corpus(seed, clusters=4, copies=30):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(clusters):
        base = [word() for _ in range(rng.choice((12, 80, 200)))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 20)):
                own[rng.randrange(len(own))] = word()
            out.append(own)
    for _ in range(40):
        out.append(passage + [word() for _ in range(rng.choice((5, 20, 60, 200)))])
    rng.shuffle(out)
    texts = [" ".join(w).upper() if k % 7 == 0 else "\t".join(w) for k, w in enumerate(out)]
    return [(1000 - 3 * k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("short", [2, 16])
def test_against_brute_force(spark, seed, short):
    docs = [*corpus(seed), (5001, ""), (5002, None), (5003, " \t\n"), (5004, "one two"), (5005, "One  TWO"), (5006, "é one"), (5007, "É one")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.link(df, short=short).collect()}
    assert got == brute(docs)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (2, "x y z x y z"), (3, "x y z x y z")], "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.link(df).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 2, True), (3, 2, 2, False)], key=repr)
    assert minhash.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_different_texts_under_one_id(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4"
    rows = [(1, near), (2, near + " 5"), (2, "quite another text about other things"), (2, "Quite another text about other things"), (3, "quite another text about other things now"), (4, ""), (4, ""), (4, None), (4, "lone words"), (4, near + " 5")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("clash"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.link(df).collect())
    want = [(1, 26, 1, True), (2, 27, 1, False), (2, 2, 2, True), (2, 2, 2, True), (3, 3, 3, True), (4, 0, 4, True), (4, 0, 4, True), (4, 0, 4, True), (4, 1, 4, True), (4, 27, 1, False)]
    assert got == sorted(want)
    kept = minhash.unique(df)
    texts = sorted((r.doc_id, (r.text or "-").lower()) for r in kept.collect())
    assert kept.columns == df.columns and texts == [(1, near), (2, "quite another text about other things"), (3, "quite another text about other things now"), (4, "-"), (4, "-"), (4, "lone words")]


@pytest.mark.parametrize("seed", [5, 6])
def test_repeated_ids_against_brute_force(spark, seed):
    """A third of the rows have one id, others take over ids of texts near to theirs."""
    rng = random.Random(seed)
    docs = [(rng.choice((7, k // 2, k)), t) for k, (_, t) in enumerate(corpus(seed, copies=20))]
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                label = [label[b] if x == label[a] else x for x in label]
    want = sorted((i, len(s), min(j for (j, _), m in zip(docs, label) if m == k)) for (i, _), s, k in zip(docs, sets, label))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.link(df, short=4).collect()) == want
    left = minhash.unique(df).collect()
    assert sorted(label[docs.index((r.doc_id, r.text))] for r in left) == sorted(set(label))


@pytest.mark.parametrize("useful", [0.01, 1.0])
def test_filters_that_know_everything(spark, monkeypatch, useful):
    """Rows that a filter takes wrongly are looked up; filters of no use give way to joins."""
    from lexmill.llm import bloom

    monkeypatch.setattr(bloom, "USEFUL", useful)
    monkeypatch.setattr(bloom, "build", lambda keys, column: bloom.Bloom(minhash.np.full(64, 2**64 - 1, minhash.U)))
    docs = [*corpus(3), (None, "one two"), (6000, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = {d: least for d, (_, least) in brute([d for d in docs if d[0] is not None]).items()}
    assert {r.doc_id: r.component_id for r in minhash.link(df).collect() if r.doc_id is not None} == want
    assert sorted((r.doc_id for r in minhash.unique(df).collect()), key=str) == sorted([d for d, least in want.items() if d == least] + [None], key=str)


def test_shared_counts():
    rng = random.Random(2)
    sets = [minhash.np.array(sorted({int(rng.expovariate(0.02)) for _ in range(rng.randrange(1, 60))})) for _ in range(70)]
    got = minhash.shared_counts(sets[:30], sets[30:], columns=7)
    assert got.tolist() == [[float(minhash.common(a, b)) for b in sets[30:]] for a in sets[:30]]


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(1)
    text = " \t\n".join(rng.choice(["é", "Wort", "x" * 300, "a"]) for _ in range(400))
    whole = minhash.shingle_sets([text, "one Two"])
    monkeypatch.setattr(minhash, "PIECE", 64)
    assert all((a == b).all() for a, b in zip(whole, minhash.shingle_sets([text, "one Two"])))


def test_recall_near_the_threshold(spark):
    """Pairs at similarities from 0.75 to 0.80, each of its own words: all are found."""
    rng = random.Random(11)
    docs, want = [], set()
    for k in range(1500):
        n = rng.choice((60, 120, 400))
        base = [f"{k}w{j}" for j in range(n + 4)]
        size = n
        # The other is the base and more words: similarity n over n and those.
        more = rng.randrange(int(n / 0.8) - n, int(n / 0.75) - n + 1)
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + [f"{k}x{j}" for j in range(more)]))]
        if 100 * size >= 75 * (size + more):
            want.add(2 * k + 1)
    got = {r.doc_id for r in minhash.link(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect() if not r.kept}
    assert len(want) > 1400 and got == want


def test_long_text_is_read_whole(spark):
    rng = random.Random(4)
    long = [str(rng.randrange(10**6)) for _ in range(60_000)]
    docs = [(1, " ".join(long)), (2, " ".join(long[:50_000])), (3, " ".join(long[:30_000]))]
    got = {r.doc_id: r.component_id for r in minhash.link(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    rng = random.Random(9)
    links = [(k, k + 1) for k in range(1, 40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        want[n] = min(seen)
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(rows) == len(want) and {r.node: r.component for r in rows} == want


def test_borderline_pairs_with_few_shared_values(spark):
    """A document at 0.75 of a longer one whose own shingles have small hashes, so that the sketches share less than half."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    words = [word() for _ in range(124)]
    short = " ".join(words)
    for _ in range(40):
        tries = [word() for _ in range(8)]
        own = minhash.shingle_sets([" ".join([*words[-4:], t]) for t in tries])
        words.append(min(zip(own, tries), key=lambda x: x[0][0])[1])
    a, b = minhash.shingle_sets([short, " ".join(words)])
    assert 100 * minhash.common(a, b) >= 75 * len(b) and 16 < minhash.common(a[: minhash.K], b[: minhash.K]) < 31
    rows = minhash.link(spark.createDataFrame([(1, short), (2, " ".join(words))], "doc_id long, text string")).collect()
    assert {r.component_id for r in rows} == {1}
