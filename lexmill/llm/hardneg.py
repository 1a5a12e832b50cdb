"""Hard negatives: for every anchor all its scores, sorted, and what lies between two limits of each positive's.

Rows are dealt into blocks of bounded size, each of which every anchor visits: the anchors are a stated query
set, and a block returns a few rows an anchor, never a score for each pair. In a block an anchor's scores are
whole numbers; they are sorted by score and id, a positive's upper limit is found by binary search, and rows of
another label are read from there down to the lower limit. Blocks' lists merge by the same order, so the result
is that of one sort over all rows. A first visit finds the positives, a second one the negatives.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import prepare, temporary, written
from .quantized import floors, matrix, products
from .tokens import slices

#: Rows of a block, and bytes of its components at most; anchors that are scored at once.
BLOCK = 16_384
BLOCK_BYTES = 16 << 20
AT_ONCE = 32

FOUND = "anchor_row long, slot int, other_id long, other_score long, other_row long"


class Block:
    """Rows of one length in ascending order of (id, row)."""

    def __init__(self, rows: dict[str, list], dim: int):
        self.ids = np.array(rows["id"], np.int64)
        self.rows = np.array(rows["row"], np.int64)
        self.names = {name: k for k, name in enumerate(sorted(set(rows["label"])))}
        self.labels = np.array([self.names[x] for x in rows["label"]], np.int64)
        self.x = matrix(rows["code"], dim)
        # A few rows of large components don't slow the others.
        wide = np.abs(self.x).max(axis=1, initial=0) >= 1 << 15
        self.groups = [g for g in (np.flatnonzero(~wide), np.flatnonzero(wide)) if len(g)]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        out = np.empty((len(anchors), len(self.ids)), np.int64)
        for own in self.groups:
            out[:, own] = products(anchors, self.x[own])
        return out

    def sort(self, scores: np.ndarray) -> np.ndarray:
        """Places from the highest score to the lowest, ties by (id, row)."""
        return np.lexsort((np.arange(len(scores)), -scores))


def limits(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest whole score between low and high hundredths of a positive's."""
    return -(-low * positive // 100), high * positive // 100


def best_positives(block: Block, order: np.ndarray, scores: np.ndarray, label: int, row: int, wanted: list[int], most: int):
    own = order[block.labels[order] == label]
    own = own[block.rows[own] != row][:most]
    return [(0, k) for k in own]


def negatives_between(block: Block, order: np.ndarray, scores: np.ndarray, label: int, row: int, wanted: list[int], most: int, low: int, high: int):
    other = order[block.labels[order] != label]
    falling = -scores[other]
    out = []
    for slot, positive in enumerate(wanted):
        least, greatest = limits(positive, low, high)
        start = np.searchsorted(falling, -greatest, side="left")
        for k in other[start : start + most]:
            if scores[k] < least:
                break
            out.append((slot + 1, k))
    return out


def visit(batches, choose):
    """Rows of a block, then its anchors, block after block; what choose takes of each anchor's sorted scores."""
    import pyarrow as pa

    held: dict[str, list] = {}
    block, current = None, None
    for batch in batches:
        found: list[list] = [[], [], [], [], []]
        marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "block", "kind")], axis=1).astype(np.int64)
        edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)] if len(marks) else []
        for a, b in zip(edges, edges[1:]):
            dim, number, kind = marks[a].tolist()
            if (dim, number) != current:
                current, block, held = (dim, number), None, {"id": [], "row": [], "label": [], "code": []}
            run = batch.slice(a, b - a)
            if kind == 0:
                for name, values in held.items():
                    values += run.column(name).to_pylist()
                continue
            if block is None:
                block, held = Block(held, dim), {}
            for part in slices(run, rows=AT_ONCE):
                anchors = matrix(part.column("code").to_pylist(), dim)
                wide = np.abs(anchors).max(axis=1, initial=0) >= 1 << 15
                scores = np.empty((len(anchors), len(block.ids)), np.int64)
                for own in (np.flatnonzero(~wide), np.flatnonzero(wide)):
                    if len(own):
                        scores[own] = block.scores(anchors[own])
                for own, row, label, wanted in zip(scores, *(part.column(c).to_pylist() for c in ("row", "label", "wanted"))):
                    for slot, k in choose(block, block.sort(own), own, block.names.get(label, -1), row, wanted or []):
                        for values, value in zip(found, (row, slot, block.ids[k], own[k], block.rows[k])):
                            values.append(value)
        if found[0]:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(found, kinds)], names=["anchor_row", "slot", "other_id", "other_score", "other_row"])


def first(found: DataFrame, most: int) -> DataFrame:
    """The first of each anchor's and slot's rows, with their rank."""
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("other_score"), "other_id", "other_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the exact inner product of two rows, the nearest long where a
    long can't hold it. Higher scores come first, ties by smaller id. An anchor is a row for which the condition
    anchors holds; its positives are its first other rows of the same label, and for each of these come the
    first rows of other labels that score from low to high hundredths of what the positive scores, both included.

    Rows with a null id, label or vector, or with a null or non-finite component take no part. Only vectors
    of one length have scores; those without components score 0. Rows that repeat an id are rows of their own, each an
    anchor if its id is one's. An anchor without positives or without rows between the limits gives no rows,
    and so does an empty table; other columns are ignored.
    """
    prepare(vectors.sparkSession)

    def coded(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, rows=2048):
                v = part.column("v")
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("id", "label", "anchor")] + [pa.array(v.value_lengths().to_pylist(), pa.int32()), pa.array(floors(v, scale), pa.binary())], names=["id", "label", "anchor", "dim", "code"])

    with temporary(vectors.sparkSession) as scope:
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"))
        rows = rows.where("id is not null and label is not null and v is not null").mapInArrow(coded, "id long, label string, anchor boolean, dim int, code binary")
        rows = written(rows.where("code is not null").withColumn("row", F.monotonically_increasing_id()), "coded")
        most = F.greatest(F.lit(1), F.least(F.lit(block), F.lit(BLOCK_BYTES) / (8 * F.greatest(F.col("dim"), F.lit(1)))))
        sizes = written(rows.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / most).cast("int").alias("blocks")), "sizes")
        dealt = rows.join(sizes, "dim")
        held = dealt.select("dim", F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), "id", "row", "label", "code", F.lit(None).cast("array<long>").alias("wanted"))
        asked = dealt.where("anchor").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("dim", "block", F.lit(1).alias("kind"), "id", "row", "label", "code")

        def visits(wanted: DataFrame, choose) -> DataFrame:
            lined = held.unionByName(wanted).repartition("dim", "block").sortWithinPartitions("dim", "block", "kind", "id", "row")
            return lined.mapInArrow(partial(visit, choose=choose), FOUND)

        found = visits(asked.withColumn("wanted", F.lit(None).cast("array<long>")), partial(best_positives, most=positives))
        pairs = written(first(found, positives).select("anchor_row", F.col("rank").alias("slot"), F.col("other_id").alias("positive_id"), F.col("other_score").alias("positive_score")), "positives")
        lists = pairs.groupBy(F.col("anchor_row").alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("wanted"))
        found = visits(asked.join(lists, "row"), partial(negatives_between, most=negatives, low=low, high=high))
        taken = first(found, negatives).join(pairs, ["anchor_row", "slot"])
        ids = rows.where("anchor").select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
        out = taken.join(ids, "anchor_row").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("other_score").alias("negative_score"))
        out = written(out, "hard-negatives")
        scope.keep(out)
    return out
