import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import hardneg, quantized, veccodes

SCHEMA = "vec_id long, embedding array<double>, label int, dim string, block int, row int"
LONG = quantized.LONG


def whole(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [max(-LONG, min(LONG, math.floor(256 * x) if math.isfinite(256 * x) else int(math.copysign(LONG, x)))) for x in v]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, None) for i, v, lab in rows], SCHEMA)


def mined(rows, every=10, positives=5, negatives=10, low=30, high=90):
    ok = [(i, lab, w) for i, v, lab in rows if i is not None and lab is not None and (w := whole(v)) is not None]
    out = []
    for k, (i, lab, w) in enumerate(ok):
        if i % every:
            continue
        scored = sorted((-max(-LONG, min(LONG, sum(p * q for p, q in zip(w, u)))), j, m, n) for m, (j, own, u) in enumerate(ok) for n in [own] if m != k and len(u) == len(w))
        for s, j, _, _ in [x for x in scored if x[3] == lab][:positives]:
            found = [(-t, n) for t, n, _, own in scored if own != lab and 100 * -t >= low * -s and 100 * -t <= high * -s][:negatives]
            out += [(i, j, r + 1, n, -s, t) for r, (t, n) in enumerate(found)]
    return sorted(out)


def rows_of(seed, n=220, dim=8):
    rng = np.random.default_rng(seed)
    rows = [(k, (rng.integers(-3, 4, dim) / 4).tolist(), int(k % 3)) for k in range(n)]  # many ties
    rows += [(7, [0.5] * dim, 1), (10, [0.25] * dim, 2), (10, [0.25] * dim, 2), (20, [1e7] * dim, 0), (30, [1e300, -1e300] * (dim // 2), 0), (31, [1e300] * dim, 1)]
    rows += [(40, None, 1), (50, [0.1, None] * (dim // 2), 1), (60, [float("nan")] * dim, 1), (70, [float("inf")] * dim, 1), (80, [0.5] * dim, None), (None, [0.5] * dim, 1)]
    return [*rows, (90, [0.5] * (dim - 1), 1), (91, [0.5] * (dim - 1), 1), (92, [0.25] * (dim - 1), 2), (100, [], 0), (101, [], 0), (102, [], 1), (110, [0.0] * dim, 1)]


@pytest.mark.parametrize("block", [16_384, 13])
def test_hard_negatives_against_brute_force(spark, block):
    rows = rows_of(3)
    got = hardneg.mine(frame(spark, rows).repartition(3), F.col("vec_id") % 10 == 0, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_hard_negatives_of_nothing(spark):
    assert hardneg.mine(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert hardneg.mine(frame(spark, [(1, [1.0], 1), (2, [1.0], 1)]), F.col("vec_id") % 10 == 0).count() == 0
    # An anchor of one label alone, and one that is alone.
    assert hardneg.mine(frame(spark, [(0, [1.0], 1), (2, [1.0], 1), (10, [1.0, 1.0], 1)]), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize(("positive", "want"), [(100, (30, 90)), (7, (3, 6)), (0, (0, 0)), (-10, (-3, -9))])
def test_limits_are_exact(positive, want):
    assert hardneg.limits(positive, 30, 90) == want
    least, most = want
    assert [n for n in range(-20, 101) if 30 * positive <= 100 * n <= 90 * positive] == list(range(least, most + 1))


def coded(rows, dim, parts=4, entries=8, rounds=2):
    ok = [(i, lab, w) for i, v, lab in rows if (w := whole(v)) is not None and len(w) == dim]
    size = dim // parts
    cut = lambda w, p: w[p * size : (p + 1) * size]
    starts = sorted((i, w) for i, _, w in ok if i is not None)[:entries]
    books = [[cut(w, p) for _, w in starts] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda w, p: min((apart(cut(w, p), c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        new = [[*book] for book in books]
        for p in range(parts):
            own = [near(w, p)[1] for _, _, w in ok]
            for k in set(own):
                them = [cut(w, p) for o, (_, _, w) in zip(own, ok) if o == k]
                new[p][k] = [sum(c) // len(them) for c in zip(*them)]
        books = new
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    found = [(i, lab, [near(w, p) for p in range(parts)]) for i, lab, w in ok]
    errors = {}
    for _, lab, own in found:
        errors[lab] = errors.get(lab, 0) + min(LONG, sum(d for d, _ in own))
    return [(i, "".join(f"{k:02x}" for _, k in own), min(LONG, sum(d for d, _ in own)), min(LONG, errors[lab]), sha) for i, lab, own in found]


def test_vector_codes_against_brute_force(spark):
    rows = rows_of(5)
    got = veccodes.compress(frame(spark, rows).repartition(3), parts=4, entries=8)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    order = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(coded(rows, 8), key=order)


def test_vector_codes_of_little(spark):
    assert veccodes.compress(frame(spark, [])).count() == 0
    few = [(1, [0.5] * 16, 1), (2, [0.25] * 16, None), (3, [1.0] * 3, 1)]
    got = sorted(map(tuple, veccodes.compress(frame(spark, few)).collect()))
    assert [r[:4] for r in got] == [(1, "00" * 16, 0, 0), (2, "01" * 16, 0, 0)]


@pytest.mark.parametrize("size", [3, 1 << 12, 1 << 25, 1 << 30, 1 << 61])
def test_nearest_is_exact(size):
    rng = np.random.default_rng(size % 97)
    x = rng.integers(-size, size + 1, (300, 4))
    book = np.concatenate([x[:10], x[:5] + 1, x[:10], rng.integers(-size, size + 1, (20, 4))])
    at, apart = veccodes.nearest(x, book)
    brute = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)), k) for k, e in enumerate(book)) for r in x]
    assert [(int(d), int(k)) for d, k in zip(apart, at)] == brute


def test_screening_covers_rounding():
    """Entries that float32 can't tell apart, far from the origin: the exact distances do."""
    base = np.array([[4_000_003, -3_999_999, 4_000_001, 3_999_997]])
    book = np.concatenate([base + d for d in ([3, 0, 0, 0], [2, 1, 0, 0], [1, 1, 1, 1], [0, 0, 0, 2], [0, 2, 0, 0], [5, 5, 5, 5])])
    at, apart = veccodes.nearest(base, book)
    assert (at.tolist(), apart.tolist()) == ([2], [4])


def test_products_and_floors():
    big = np.array([[1 << 40, -(1 << 40)], [3, 4]])
    assert quantized.products(big, big).tolist() == [[LONG, -(1 << 40)], [-(1 << 40), 25]]
    column = pa.array([[0.1, -0.1], None, [], [1.0, None], [1e6, -1e-9], [float("nan")], [1e308, -1e308]], pa.list_(pa.float64()))
    codes = quantized.floors(column, 256)
    assert [None if c is None else quantized.matrix([c], n)[0].tolist() for c, n in zip(codes, (2, 0, 0, 2, 2, 1, 2))] == [[25, -26], None, [], None, [256_000_000, -1], None, [LONG, -LONG]]
    assert len(codes[0]) == 4 and len(codes[4]) == 16
