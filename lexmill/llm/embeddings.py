"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells.

Vectors are compared within a label. Equal vectors are one node with a weight. Every label is cut into about as
many cells as the square root of its nodes, by spherical k-means, and cells that are large again while that
helps: cells keep their size as the table grows. Centroids are fitted on a bounded sample of
each cell, by the workers. A node goes to its own cell and to every earlier cell that a vector similar enough
to it may call its own, which the distance to the plane between the two centroids tells exactly, so cells lose
no link. Where vectors lie in no clusters nearly all go to nearly all cells: there are fewer cells then.

A cell is compared block by block, and blocks hold short vectors: a node's components along the directions in which its label
varies most, and the length of what is left. Their products are never below the cosine, so only nodes that one of them lets through
are read whole and compared again. A block returns sums and a spanning forest, never all pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import prepare, temporary, written
from .components import components, joined, made_name, named
from .tokens import slices

#: Nodes of a cell that is cut no further, cells that one is cut into at most, and nodes to fit each of these on.
CELL = 2_000
FAN = 64
SAMPLE_A_CELL = 20
#: Nodes of a block, and bytes of their vectors at most.
BLOCK = 16_384
BLOCK_BYTES = 24 << 20
#: Nodes of one cell that a task assigns.
DEAL = 50_000
#: A cell isn't cut again if that leaves more than this share of the pairs to compare; a label is cut into fewer cells if a node would go to more than so many.
WORTH = 0.7
COPIES = 4
#: Directions of a short vector, and more than its rounding.
SHORT = 32
SLACK = 1e-5


def usable(values: list | None) -> bytes | None:
    """A vector as bytes, of float32 if that holds all its components, else of float64; null if it is null, empty, zero, or holds a null or a number that isn't finite."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, dtype=np.float64) + 0.0
    if not (np.isfinite(x).all() and x.any()):
        return None
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return small.tobytes() if (small == x).all() else x.tobytes()


def units(keys: list[bytes], dim: int) -> np.ndarray:
    """The unit vectors of usable() vectors of dim components."""
    x = np.empty((len(keys), dim))
    small = np.array([len(k) == 4 * dim for k in keys], bool)
    for kind, rows in ((np.float32, np.flatnonzero(small)), (np.float64, np.flatnonzero(~small))):
        if len(rows):
            x[rows] = np.frombuffer(b"".join([keys[k] for k in rows]), kind).reshape(len(rows), dim)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k or fewer unit centroids of the unit rows of x."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        centers = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centers)
    return np.unique(centers, axis=0)


def planes(centers: np.ndarray) -> np.ndarray:
    """The distances between centroids."""
    return np.sqrt(np.maximum(0, 2 - 2 * centers @ centers.T))


def cells(x: np.ndarray, centers: np.ndarray, between: np.ndarray, least: float) -> list[list[int]]:
    """For each row its own cell, then the earlier cells in which a row of cosine least or more to it may lie.

    between: planes(centers). A row that is apart from x by no more than the cosine says can't cross a plane that x is further from.
    """
    dots = x @ centers.T
    own = dots.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * least)) + 1e-9
    visits = (dots[np.arange(len(x)), own][:, None] - dots <= apart * between[own]) & (np.arange(len(centers)) < own[:, None])
    return [[o, *np.flatnonzero(v).tolist()] for o, v in zip(own.tolist(), visits)]


def basis(sample: np.ndarray) -> np.ndarray:
    """The directions in which unit vectors reach furthest, orthonormal rows; their mean's comes first where it counts."""
    return np.linalg.svd(sample, full_matrices=False)[2][:SHORT]


def shortened(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Vectors whose products, and SLACK, aren't below those of the unit rows of x."""
    along = x @ directions.T
    rest = np.sqrt(np.maximum(0, 1 - (along * along).sum(axis=1, keepdims=True)))
    return np.concatenate([along, rest], axis=1).astype(np.float32)


def strips(node, visits, half, x, least: float, one: bool):
    """Of one block, or of two (half 0 and 1; either may be empty): rows, columns, and which of them reach least.

    Two nodes are compared if at every level one of them at least is in its own cell.
    """
    rows = np.flatnonzero(half == 0)
    cols = rows if one else np.flatnonzero(half == 1)
    for at in range(0, len(rows), 512):
        part = rows[at : at + 512]
        near = x[part] @ x[cols].T >= least
        if near.any():
            near &= (visits[part][:, None] & visits[cols][None, :] == 0) & (node[part][:, None] != node[cols][None, :])
            yield part, cols, near


def block_candidates(node, visits, half, short, least: float, one: bool) -> np.ndarray:
    """Which nodes of the blocks may be linked, by short vectors."""
    out = np.zeros(len(node), bool)
    for part, cols, near in strips(node, visits, half, short, least - SLACK, one):
        out[part] |= near.any(axis=1)
        out[cols] |= near.any(axis=0)
    return out


def block_links(node, visits, weight, half, x, least: float, one: bool):
    """Each linked node of the blocks, the weight of those it is linked with, and a smaller node to hang on."""
    found = [(part[i], cols[j]) for part, cols, near in strips(node, visits, half, x, least, one) for i, j in (np.nonzero(near),)]
    a, b = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
    links = np.zeros(len(node))
    np.add.at(links, a, weight[b])
    if not one:
        np.add.at(links, b, weight[a])
    order = np.argsort(node, kind="stable")
    rank = np.empty(len(node), int)
    rank[order] = np.arange(len(node))
    root = node[order][joined(rank[a], rank[b], len(node))][rank]
    linked = np.flatnonzero(links)
    return node[linked], links[linked].astype(np.int64), root[linked]


def copies(sample: np.ndarray, centers: np.ndarray, least: float) -> np.ndarray:
    """The share of nodes that go to each cell."""
    return np.bincount([c for own in cells(sample, centers, planes(centers), least) for c in own], minlength=len(centers)) / len(sample)


def first_cut(sample: np.ndarray, n: int, least: float) -> np.ndarray:
    """Centroids for a label of n nodes: about as many as their square root, fewer while a node would go to more than COPIES cells."""
    k = min(FAN, int(np.ceil(np.sqrt(n))))
    while True:
        centers = spherical_k_means(sample, k)
        if k <= 2 or copies(sample, centers, least).sum() <= COPIES:
            return centers
        k = (k + 1) // 2


def cut(sample: np.ndarray, n: int, cell: int, least: float) -> np.ndarray | None:
    """Centroids for a cell of n nodes, or None if cells by them would save too little."""
    centers = spherical_k_means(sample, min(FAN, -(-n // cell)))
    to = copies(sample, centers, least)
    return centers if len(centers) > 1 and (to * to).sum() < WORTH else None


PLACED = "label string, dim int, node long, weight long, cell string, visits long, short binary"


def in_cells(nodes: DataFrame, least: float, cell: int) -> DataFrame:
    """Where nodes (label, dim, key, node, weight) of labels of two and more go (PLACED), once for each cell. visits: a bit for each level at which this isn't the node's own cell."""
    at = ["label", "dim", "cell"]
    placed = nodes.select("label", "dim", "node", "weight", "key", F.lit("").alias("cell"), F.lit(0).cast("long").alias("visits"), F.lit(None).cast("binary").alias("short"))
    kept: list[DataFrame] = []
    for level in range(62):
        # Written before they are joined: Spark can split a large cell's rows only in a join of plain shuffles.
        large = written(placed.groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") > (cell if level else 1)), "large-cells")
        if large.isEmpty():
            break
        whole = placed.join(nodes.select("node", "key"), "node") if level else placed
        place = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30))
        taken = whole.join(large, at).where(place < F.least(F.lit(1.0), F.lit(2.0 * SAMPLE_A_CELL * FAN) / F.col("n")) * (1 << 30)).select(*at, "n", place.alias("place"), "node", "key")

        def fit(pdf):
            import pandas as pd

            n, dim = int(pdf["n"].iloc[0]), int(pdf["dim"].iloc[0])
            own = units(pdf.sort_values(["place", "node"])["key"].tolist()[: SAMPLE_A_CELL * FAN], dim)
            centers = cut(own, n, cell, least) if level else first_cut(own, n, least)
            rows = pdf[[*at, "n"]].head(0 if centers is None else 1)
            held = lambda x: pd.Series([b"" if x is None else x.tobytes()] * len(rows), index=rows.index, dtype=object)
            return rows.assign(centers=held(centers), directions=held(None if level else basis(own)), deals=-(-n // DEAL))

        centers = written(taken.groupBy(*at).applyInPandas(fit, "label string, dim int, cell string, n long, centers binary, directions binary, deals int"), "centers")
        if centers.isEmpty():
            break
        dealt = written(centers.select(*at, "deals"), "deals")
        if level:
            kept.append(written(placed.join(dealt, at, "left_anti"), "cells"))
        none = lambda kind: F.lit(None).cast(kind)
        rows = whole.join(dealt, at).select(*at, F.pmod(F.xxhash64("node"), F.col("deals")).cast("int").alias("deal"), none("binary").alias("centers"), none("binary").alias("directions"), "key", "node", "weight", "visits", "short")
        heads = centers.select(*at, F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), "centers", "directions", none("binary").alias("key"), none("long").alias("node"), none("long").alias("weight"), none("long").alias("visits"), none("binary").alias("short"))
        # Each share of a cell's nodes comes behind its centroids.
        lined = rows.unionByName(heads).repartition(*at, "deal").sortWithinPartitions(*at, "deal", F.col("centers").isNull())
        placed = written(lined.mapInArrow(_assign(least, level), PLACED), "assigned")
    for part in kept:
        placed = placed.unionByName(part)
    return placed.drop("key").where("short is not null")


def _assign(least: float, level: int):
    def run(batches):
        import pyarrow as pa

        centers = between = directions = None
        for batch in batches:
            for part in slices(batch, rows=2048):
                heads = part.column("centers").to_pylist()
                edges = [k for k, c in enumerate(heads) if c is not None]
                for a, b in zip([0, *edges], [*edges, part.num_rows]):
                    if a < b and heads[a] is not None:
                        dim = part.column("dim")[a].as_py()
                        centers = np.frombuffer(heads[a], np.float64).reshape(-1, dim)
                        directions = np.frombuffer(part.column("directions")[a].as_py(), np.float64).reshape(-1, dim)
                        between = planes(centers)
                        a += 1
                    own = part.slice(a, b - a)
                    for few in slices(own, rows=512) if b > a else ():
                        x = units(few.column("key").to_pylist(), centers.shape[1])
                        to = cells(x, centers, between, least)
                        short = few.column("short") if level else pa.array([v.tobytes() for v in shortened(x, directions)], pa.binary())
                        which = pa.array([i for i, c in enumerate(to) for _ in c], pa.int64())
                        flat = few.take(which)
                        names = [f"{cell}.{c}" for cell, own in zip(few.column("cell").to_pylist(), to) for c in own]
                        visits = [v | (1 << level if k else 0) for v, own in zip(few.column("visits").to_pylist(), to) for k in range(len(own))]
                        yield pa.RecordBatch.from_arrays([flat.column(c) for c in ("label", "dim", "node", "weight")] + [pa.array(names, pa.string()), pa.array(visits, pa.int64()), short.take(which)], names=["label", "dim", "node", "weight", "cell", "visits", "short"])

    return run


def link(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors.

    Two vectors are linked when their labels are equal and not null, they have as many components and
    their cosine, in double precision, is least or more. Vectors that are null, empty, zero or hold a
    null or a number that isn't finite are linked with nothing. A row of null id is linked with nothing:
    component_id null, kept true. Rows that repeat an id are vectors of their own, linked by their own
    components and label. An empty table gives no rows; other columns are ignored.

    Cutting a cell takes FAN * SAMPLE_A_CELL of its nodes to fit on; all nodes are assigned and compared: short
    vectors in blocks of block nodes (fewer if their vectors would take more than BLOCK_BYTES), whole ones where these say so.
    """
    prepare(vectors.sparkSession)

    def keyed(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, rows=2048):
                v = part.column("v")
                keys = [usable(x) for x in v.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(v.value_lengths().to_pylist(), pa.int32()), pa.array(keys, pa.binary())], names=["vec_id", "label", "dim", "key"])

    with temporary(vectors.sparkSession) as scope:
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
        rows = rows.mapInArrow(keyed, "vec_id long, label string, dim int, key binary")
        # Vectors are told apart by a digest, so they move with their nodes alone.
        rows = written(rows.withColumn("digest", F.unhex(F.sha2(F.col("key"), 256))), "vectors")
        good = rows.where("vec_id is not null and label is not null and key is not null")
        same = ["label", "dim", "digest"]
        h = F.xxhash64(*same)
        mixed = written(good.groupBy("vec_id").agg(F.min(h).alias("low"), F.max(h).alias("high")).where("low <> high").select("vec_id"), "mixed")
        sums = [F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("key").alias("key")]
        if shared := not mixed.isEmpty():
            nodes = named(good, mixed, "vec_id").groupBy(*same).agg(F.min(F.when(F.col("own"), F.col("vec_id"))).alias("own"), *sums)
            nodes = nodes.withColumn("node", F.coalesce("own", made_name(*same))).drop("own")
        else:
            nodes = good.groupBy(*same).agg(*sums).withColumn("node", F.col("least"))
        nodes = written(nodes, "nodes")
        placed = in_cells(nodes, least, cell)
        most = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim")))))
        counts = written(placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("n")).select("label", "dim", "cell", F.ceil(F.col("n") / most).cast("int").alias("blocks")), "cell-counts")
        dealt = placed.join(counts, ["label", "dim", "cell"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = ["label", "dim", "cell", "i", "j"]
        dealt = dealt.select("label", "dim", "cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("half"), "node", "weight", "visits", "short")
        one = lambda pdf: bool(pdf["i"].iloc[0] == pdf["j"].iloc[0])

        def screen(pdf):
            short = np.frombuffer(b"".join(pdf["short"]), np.float32).reshape(len(pdf), -1)
            near = block_candidates(pdf["node"].to_numpy(), pdf["visits"].to_numpy(), pdf["half"].to_numpy(), short, least, one(pdf))
            return pdf.drop(columns="short")[near]

        def compare(pdf):
            import pandas as pd

            x = units(pdf["key"].tolist(), int(pdf["dim"].iloc[0]))
            node, links, root = block_links(pdf["node"].to_numpy(), pdf["visits"].to_numpy(), pdf["weight"].to_numpy(np.float64), pdf["half"].to_numpy(), x, least, one(pdf))
            return pd.DataFrame({"node": node, "links": links, "root": root})

        near = written(dealt.groupBy(*pair).applyInPandas(screen, "label string, dim int, cell string, i int, j int, half int, node long, weight long, visits long"), "candidates")
        found = written(near.join(nodes.select("node", "key"), "node").groupBy(*pair).applyInPandas(compare, "node long, links long, root long"), "links")
        reach = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        ends = nodes.join(found.groupBy("node").agg(F.sum("links").alias("links")).join(reach, "node", "left"), "node", "left")
        ends = ends.select(F.col("label").alias("own_label"), F.col("dim").alias("own_dim"), F.col("digest").alias("own_digest"), "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("class"))
        if shared:
            # Names made from vectors are no ids.
            ends = written(ends, "ends")
            ends = ends.join(written(ends.groupBy("class").agg(F.min("least").alias("component")), "class-ids"), "class")
        else:
            ends = ends.withColumn("component", F.col("class"))
        ends = written(ends, "vector-classes")
        scope.keep(rows, ends)
    out = rows.join(ends, (F.col("label") == F.col("own_label")) & (F.col("dim") == F.col("own_dim")) & (F.col("digest") == F.col("own_digest")) & F.col("vec_id").isNotNull(), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
