"""Packing token sequences under several limits at once.

Vector bin packing by the dot-product heuristic: each piece is a vector (tokens, segments,
loss-bearing tokens); into the open sequence goes, among the pieces that fit, the one whose vector
has the largest dot product with what the sequence has left, so that pieces use up the scarce
dimension last. When nothing fits whole, the longest piece is cut to fill the gap.

Each partition packs its own rows in one pass: no shuffle, a bounded window of pieces in memory,
and sequence ids that hold the partition's number, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import prepare
from .tokens import encoder, slices

CACHED = 250_000
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary, loss_spans array<struct<start:long,length:long>>"


def fitting(loss, start: int, most: int, limit: int) -> int:
    """How many ids from start on, most at most, have limit loss-bearing ones among them at most.

    loss: whether all ids bear loss, or how many of those before each place do.
    """
    if loss is False:
        return most
    if loss is True:
        return min(most, limit)
    return min(most, int(np.searchsorted(loss, loss[start] + limit, side="right")) - 1 - start)


def bearing(loss, start: int, n: int) -> int:
    return (n if loss else 0) if isinstance(loss, bool) else int(loss[start + n] - loss[start])


class Packer:
    """Feed items with add(); packed() yields (doc, start, length, doc_tokens, sequence, offset, loss tokens, ids, loss)."""

    def __init__(self, capacity: int, max_segments: int, max_loss: int, window: int, min_cut: int, first_sequence: int = 0):
        self.cap = np.array([capacity, max_segments, max_loss], dtype=np.float64)
        self.window, self.min_cut, self.next = window, min_cut, first_sequence
        self.items: list[tuple] = []  # doc, start, doc_tokens, ids, loss of the document's ids

    def add(self, doc, ids: bytes, loss):
        total, capacity, limit = len(ids) // 4, int(self.cap[0]), int(self.cap[2])
        at = 0
        while at < total:
            n = fitting(loss, at, min(capacity, total - at), limit)
            item = (doc, at, total, ids[4 * at : 4 * (at + n)], loss)
            if n == capacity:
                yield self._row(item, n, 0)
                self.next += 1
            else:
                self.items.append(item)
            at += n

    def _row(self, item, n: int, offset: int):
        doc, start, total, ids, loss = item
        return doc, start, n, total, self.next, offset, bearing(loss, start, n), ids[: 4 * n], loss

    def pack(self, keep: int):
        """Fill sequences until at most keep items wait, or, unless keep is 0, they are too few to fill one more."""
        items = self.items
        if len(items) <= keep:
            return
        rest = sum(len(i[3]) // 4 for i in items)
        if keep and rest < self.cap[0]:
            return
        size = np.array([[len(i[3]) // 4, 1, bearing(i[4], i[1], len(i[3]) // 4)] for i in items], dtype=np.float64)
        # Demands count as shares of the limits, each dimension by how much of it all items ask for.
        share = size / self.cap
        weight = share.mean(axis=0)
        alive = np.ones(len(items), dtype=bool)
        waiting = len(items)
        while waiting > keep and (not keep or rest >= self.cap[0]):
            left, offset = self.cap.copy(), 0
            while waiting and left[0] > 0 and left[1] > 0:
                fits = alive & (size <= left).all(axis=1)
                gain = np.where(fits, share @ (weight * left / self.cap), -1.0)
                k = int(gain.argmax())
                if gain[k] >= 0:
                    yield self._row(items[k], int(size[k, 0]), offset)
                    alive[k] = False
                    waiting -= 1
                    left -= size[k]
                    offset += int(size[k, 0])
                    continue
                k, n = self._cut(items, size, alive, left)
                if k < 0:
                    break
                yield self._row(items[k], n, offset)
                doc, start, total, ids, loss = items[k]
                left -= (n, 1, bearing(loss, start, n))
                offset += n
                size[k] -= (n, 0, bearing(loss, start, n))
                items[k] = (doc, start + n, total, ids[4 * n :], loss)
                share[k] = size[k] / self.cap
            self.next += 1
            rest -= offset
        self.items = [i for i, a in zip(items, alive) if a]

    def _cut(self, items, size, alive, left) -> tuple[int, int]:
        """The longest item of which min_cut ids at least fit in what is left, and how many do; -1 if there is none. No item fits whole."""
        if left[0] < self.min_cut:
            return -1, 0
        for k in np.argsort(-np.where(alive, size[:, 0], -1), kind="stable").tolist():
            if not alive[k]:
                break
            n = fitting(items[k][4], items[k][1], int(min(left[0], size[k, 0])), int(left[2]))
            if n >= self.min_cut:
                return k, n
            if left[2] <= 0 and isinstance(items[k][4], bool) and items[k][4] and all(i[4] is True for i, a in zip(items, alive) if a):
                break
        return -1, 0


def spans_of(loss, start: int, n: int) -> list[dict[str, int]]:
    """The loss-bearing ids among n from start on, as runs within these."""
    bears = np.diff(loss[start : start + n + 1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], bears, [False])).astype(np.int8)))
    return [{"start": a, "length": b - a} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def pack(
    docs: DataFrame,
    tokenizer: str,
    kind: str = "word",
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = 1,
    capacity: int = 2048,
    max_segments: int = 256,
    max_loss: int | None = None,
    loss: str | None = None,
    parts: str | None = None,
    window: int = 1024,
    min_cut: int = 1,
) -> DataFrame:
    """Token sequences of at most capacity tokens, max_segments pieces and max_loss loss-bearing tokens, one row a piece.

    tokenizer, kind: a tokenizers file and how its texts may be cut (see tokens.CHUNKS).
    loss: SQL predicate over docs saying which rows' tokens bear loss (null counts as no); none: all do.
    parts: a column of arrays of structs (text, loss) to pack in place of texts, such as the turns of a
    conversation: the ids of each part bear loss or don't (null: don't), end_id does as the last part.
    window: how many pieces wait for a place, or as many as have capacity ids, at most; min_cut: a gap of fewer tokens is left as padding.
    Columns: doc_id, start (ids of the document before the piece), length, doc_tokens, sequence_id,
    offset (in the sequence, without gaps), loss_tokens, ids (little-endian unsigned 32-bit), and of parts
    loss_spans (runs of loss-bearing ids within the piece; null where loss_tokens says all).

    Null or empty text or parts: only end_id, or no row without one; that of no parts bears no loss. Null or repeated ids are packed as any
    row. Each row's ids lie in exactly one piece each. An empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    max_loss = capacity if max_loss is None else max_loss
    if min(capacity, max_segments, max_loss, min_cut) < 1:
        raise ValueError("limits must be positive")
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset", "loss_tokens")), ("ids", pa.binary()), ("loss_spans", spans)])
        encode = encoder(tokenizer, kind, most=CACHED).encode
        packer = Packer(capacity, max_segments, max_loss, window, min_cut, TaskContext.get().partitionId() << 33)
        rows: list[tuple] = []

        def out():
            *columns, losses = zip(*rows)
            found = pa.nulls(len(rows), spans) if parts is None else pa.array([None if isinstance(loss, bool) else spans_of(loss, r[1], r[2]) for r, loss in zip(rows, losses)], spans)
            made = pa.RecordBatch.from_arrays([*(pa.array(c, type=f.type) for c, f in zip(columns, schema)), found], schema=schema)
            rows.clear()
            return made

        def examples(part):
            """doc, ids with the end, loss."""
            if parts is None:
                yield from zip(part.column("doc_id").to_pylist(), (x + end for x in encode(part.column("text").to_pylist())), part.column("bears").to_pylist())
                return
            for doc, own in zip(part.column("doc_id").to_pylist(), part.column("parts").to_pylist()):
                own = own or []
                ids = encode([x and x["text"] for x in own])
                marks = [bool(x and x["loss"]) for x in own]
                sizes = [len(x) // 4 for x in ids]
                bears = np.repeat([*marks, bool(marks and marks[-1])], [*sizes, len(end) // 4])
                yield doc, b"".join(ids) + end, np.concatenate((np.zeros(1, np.int64), np.cumsum(bears)))

        for batch in batches:
            for part in slices(batch, rows=512 if parts is None else 64, text="text" if parts is None else None):
                for example in examples(part):
                    rows.extend(packer.add(*example))
                    if len(packer.items) >= window:
                        rows.extend(packer.pack(window // 2))
                if rows:
                    yield out()
        rows.extend(packer.pack(0))
        if rows:
            yield out()

    doc = F.col(id_col).cast("long").alias("doc_id")
    if parts is not None:
        shape = "array<struct<text:string,loss:boolean>>"
        return docs.select(doc, F.transform(parts, lambda x: F.struct(x["text"].alias("text"), x["loss"].alias("loss"))).cast(shape).alias("parts")).mapInArrow(run, SCHEMA)
    bears = F.coalesce(F.expr(loss), F.lit(False)) if loss else F.lit(True)
    return docs.select(doc, F.col(text_col).cast("string").alias("text"), bears.alias("bears")).mapInArrow(run, SCHEMA)
