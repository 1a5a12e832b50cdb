import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import embeddings


def brute(rows, least):
    """rows: (id, vector or None, label or None); id to (links, component)."""
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and embeddings.usable(v)]
    links = {k: set() for k in range(len(ok))}
    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a][1], ok[b][1]
            if ok[a][2] == ok[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        out.setdefault(ok[k][0], []).append((len(links[k]), min(ok[s][0] for s in seen)))
    return out


@pytest.mark.parametrize(("cell", "block"), [(2000, 2048), (12, 5), (30, 1000)])
def test_against_brute_force(spark, cell, block):
    rng = np.random.default_rng(5)
    rows = []
    for lab in (0, 1):
        bases = rng.normal(size=(12, 6))
        for k in range(120):
            v = bases[k % 12] + rng.normal(size=6) * rng.choice([0.02, 0.12, 0.3])
            rows.append((len(rows), v.tolist(), lab))
    rows += [(900 + k, rows[3][1], 0) for k in range(5)] + [(950, [2 * x for x in rows[3][1]], 0), (951, rows[3][1], 1), (952, rows[3][1][:5], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumnRenamed("label", "dim").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.link(df, 0.98, label_col="dim", cell=cell, block=block).collect()}
    assert got == {k: v[0] for k, v in brute(rows, 0.98).items()}


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], None), (3, None, 0), (4, [0.0, 0.0], 0), (5, [1.0, None], 0), (6, [1.0, float("nan")], 0), (7, [], 0), (8, [float("inf"), 1.0], 0), (None, [1.0, 0.0], 0), (9, [3.0, 0.0], 0), (9, [3.0, 0.0], 0)]
    got = sorted((tuple(r) for r in embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=repr)
    want = [(1, 2, 1, True), *((k, 0, k, True) for k in range(2, 9)), (9, 2, 1, False), (9, 2, 1, False), (None, 0, None, True)]
    assert got == sorted(want, key=repr)
    assert embeddings.link(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_different_vectors_under_one_id(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (2, [0.0, 1.0], 0), (2, [5.0, 1.0], 1), (3, [0.0, 2.0], 0), (2, [0.0, 1.0], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1, True), (2, 0, 2, True), (2, 1, 1, False), (2, 2, 2, True), (2, 2, 2, True), (3, 2, 2, False)]


@pytest.mark.parametrize("seed", [1, 2])
def test_cells_within_cells(spark, monkeypatch, seed):
    """Several levels of cells, a dense cell that cutting doesn't help, ids that repeat: as brute force."""
    monkeypatch.setattr(embeddings, "FAN", 3)
    monkeypatch.setattr(embeddings, "DEAL", 100)
    rng = np.random.default_rng(seed)
    bases = rng.normal(size=(60, 4))
    rows = [(int(rng.integers(0, 700)), (bases[k % 60] + rng.normal(size=4) * rng.choice([0.02, 0.2])).tolist(), 0) for k in range(700)]
    rows += [(2000 + k, (bases[0] + rng.normal(size=4) * 0.001).tolist(), 0) for k in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got: dict = {}
    for r in embeddings.link(df, 0.98, cell=20, block=64).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in brute(rows, 0.98).items()}
    unit = embeddings.units([np.array(v).tobytes() for _, v, _ in rows[700:]], 4)
    assert embeddings.cut(unit, 150, 20, 0.98) is None


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_goes_through_k_means(spark, monkeypatch, sf):
    """Every label of the table is cut by centroids, and vectors meet in cells alone."""
    from lexmill.llm.queries import op6_embeddings

    cells, whole = {}, embeddings.in_cells

    def seen(nodes, least, cell):
        placed = whole(nodes, least, cell)
        cells.update((r.label, (r.cells, r.copies / r.nodes)) for r in placed.groupBy("label").agg(F.count_distinct("cell").alias("cells"), F.count("*").alias("copies"), F.count_distinct("node").alias("nodes")).collect())
        return placed

    monkeypatch.setattr(embeddings, "in_cells", seen)
    assert op6_embeddings(spark, f"/root/testdata/{sf}").count() > 0
    assert len(cells) == 10 and all(n >= 2 and copies <= embeddings.COPIES for n, copies in cells.values())


def test_clustered_labels_have_as_many_cells_as_their_root(spark):
    rng = np.random.default_rng(1)
    bases = embeddings.units([v.tobytes() for v in rng.normal(size=(30, 16))], 16)
    x = embeddings.units([v.tobytes() for k in range(900) for v in (bases[k % 30] + rng.normal(size=16) * 0.01,)], 16)
    centers = embeddings.first_cut(x, 900, 0.98)
    assert len(centers) >= 25 and embeddings.copies(x, centers, 0.98).sum() < 1.5


@pytest.mark.parametrize("dim", [3, 32, 64, 384])
def test_short_vectors_refuse_no_link(dim):
    """Products of short vectors are never below the cosine, whatever the directions; they tell most random vectors apart."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(300, dim)) + (rng.random(300) < 0.3)[:, None] * 2
    x = np.concatenate([x, x[:100] + rng.normal(size=(100, dim)) * 0.05])
    x = embeddings.units([v.tobytes() for v in x], dim)
    for directions in (embeddings.basis(x), embeddings.basis(x[:5])):
        short = embeddings.shortened(x, directions)
        assert short.shape[1] <= embeddings.SHORT + 1 and ((short @ short.T).astype(float) + embeddings.SLACK >= x @ x.T).all()
    node, zero = np.arange(200), np.zeros(200, int)
    x = embeddings.units([v.tobytes() for v in rng.normal(size=(200, dim))], dim)
    near = embeddings.block_candidates(node, zero, zero, embeddings.shortened(x, embeddings.basis(x)), 0.98, True)
    assert dim < 64 or near.sum() < 20
