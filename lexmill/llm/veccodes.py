"""Codes for vectors: each of a vector's parts is named by the nearest entry of that part's codebook.

The nearest entry is exact at the price of one float32 matrix product: the product screens all entries, an
interval that covers every rounding error lies around each value, and only entries whose interval overlaps the best
one's are measured again in int64, where ties go to the lowest index. Codebooks are refined in rounds; workers
return sums by entry, and only codebooks pass through the driver.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import prepare, temporary, written
from .quantized import LONG, floors, greatest, matrix
from .tokens import slices

#: Half a unit in the last place of float32.
UNIT = 2.0**-24


def measured(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest() by Python's own numbers, for components of any size."""
    at, apart = [], []
    entries = book.tolist()
    for row in x.tolist():
        d = [sum((p - q) ** 2 for p, q in zip(row, entry)) for entry in entries]
        apart.append(min(d))
        at.append(d.index(apart[-1]))
    return np.array(at, np.int64), np.array(apart, object)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry, ties to the lowest, and their squared distance."""
    width = x.shape[1]
    if greatest(x) > (limit := isqrt((1 << 56) // max(1, 4 * width))) or greatest(book) > limit:
        return measured(x, book)
    norms = (book * book).sum(axis=1)
    screen = norms.astype(np.float32) - np.float32(2) * (x.astype(np.float32) @ book.astype(np.float32).T)
    # Each of the sum's products and partial sums, both conversions, the norm's and the difference round once.
    steps = width + 6
    gamma = steps * UNIT / (1 - steps * UNIT)
    lengths = np.sqrt((x * x).sum(axis=1).astype(np.float64))
    error = gamma * (norms.max(initial=0) + 2 * lengths * np.sqrt(float(norms.max(initial=0)))) * (1 + 1e-9)
    over = screen.min(axis=1).astype(np.float64) + 2 * error
    i, j = np.nonzero(screen <= np.nextafter(over.astype(np.float32), np.float32(np.inf))[:, None])
    d = x[i] - book[j]
    d = (d * d).sum(axis=1)
    best = np.minimum.reduceat(d, np.flatnonzero(np.diff(i, prepend=-1))) if len(i) else d
    ties = np.flatnonzero(d == best[i])
    return j[ties[np.diff(i[ties], prepend=-1) > 0]], best


def assign(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes by row and part, and each row's squared distances in all; x and the books may be of any size."""
    at = np.zeros((len(x), len(books)), np.int64)
    apart = np.zeros(len(x), object)
    wide = np.abs(x).max(axis=1, initial=0) >= 1 << 15
    size = x.shape[1] // len(books)
    for rows in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        for p, book in enumerate(books if len(rows) else ()):
            at[rows, p], own = nearest(x[rows, p * size : (p + 1) * size], book)
            apart[rows] += own.astype(object)
    return at, apart


def summed(x: np.ndarray, at: np.ndarray, books: list[np.ndarray], counts: np.ndarray, totals: np.ndarray) -> None:
    """Add rows to counts (part, entry) and totals (part, entry, place), which hold Python's own numbers."""
    size = x.shape[1] // len(books)
    exact = greatest(x) < 1 << 40
    for p, book in enumerate(books):
        own, entries = x[:, p * size : (p + 1) * size], at[:, p]
        counts[p] += np.bincount(entries, minlength=len(book))
        sums = np.zeros((len(book), size), np.int64 if exact else object)
        np.add.at(sums, entries, own if exact else own.astype(object))
        totals[p] += sums.astype(object)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for entry in book.tolist() for c in entry).encode()).hexdigest()


def fit(rows: DataFrame, dim: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebooks of rows (vec_id, code) of dim components."""
    starts = rows.where("vec_id is not null").orderBy("vec_id", "code").limit(entries).select("code").collect()
    books = np.split(matrix([bytes(r.code) for r in starts], dim), parts, axis=1)

    def run(batches):
        from decimal import Decimal

        import pyarrow as pa

        counts = np.zeros((parts, len(books[0])), np.int64)
        totals = np.zeros((parts, len(books[0]), dim // parts), object)
        for batch in batches:
            for part in slices(batch, rows=4096):
                x = matrix(part.column("code").to_pylist(), dim)
                summed(x, assign(x, books)[0], books, counts, totals)
        used = [(p, e) for p, e in zip(*(c.tolist() for c in np.nonzero(counts)))]
        if used:
            values = [[Decimal(v) for v in totals[p, e]] for p, e in used]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)))
            cells = (*zip(*used), [int(counts[u]) for u in used], values)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cells, kinds)], names=["part", "entry", "n", "totals"])

    for _ in range(rounds):
        found = rows.mapInArrow(run, "part int, entry int, n long, totals array<decimal(38,0)>")
        sums = [F.sum(F.get("totals", F.lit(k))).alias(f"s{k}") for k in range(dim // parts)]
        new = [book.copy() for book in books]
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
            new[r.part][r.entry] = [int(s) // r.n for s in r[3:]]
        books = new
    return books


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", dim: int | None = None) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every row of vectors that has a usable one.

    Components become floor(scale * x), the nearest long where a long can't hold it; a vector is cut into parts
    equal consecutive parts. A part's codebook starts as that part of the entries rows of the smallest ids (rows that repeat
    an id each count, by their components); each round assigns every part to its nearest entry, ties to the lowest
    index, and moves each entry to its parts' floored mean; unused ones stay. code: the final indexes, two hex digits
    or more each; error: the squared distances in all; label_error: their sum over rows of an equal label, nulls
    together. Both count as the greatest long where a long can't hold them.

    Rows whose vector is null or holds a null or non-finite component are dropped, and so are vectors that
    aren't of dim components: by default the commonest length that parts divide, ties to the greater. A row of null id starts no
    entry. Repeated rows are coded alike; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    digits = max(2, len(f"{max(0, entries - 1):x}"))

    def coded(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, rows=2048):
                v = part.column("v")
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(v.value_lengths().to_pylist(), pa.int32()), pa.array(floors(v, scale), pa.binary())], names=["vec_id", "label", "dim", "code"])

    with temporary(spark) as scope:
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
        rows = written(rows.mapInArrow(coded, "vec_id long, label string, dim int, code binary").where("code is not null"), "coded")
        if dim is None:
            common = rows.where(F.col("dim") % parts == 0).groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
            dim = common.dim if common else parts
        rows = rows.where(F.col("dim") == dim)
        books = fit(rows, dim, parts, entries, rounds)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for part in slices(batch, rows=4096):
                    at, apart = assign(matrix(part.column("code").to_pylist(), dim), books)
                    codes = ["".join(f"{k:0{digits}x}" for k in own) for own in at.tolist()]
                    errors = [min(int(d), LONG) for d in apart]
                    yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

        out = written(rows.mapInArrow(run, "vec_id long, label string, code string, error long"), "codes")
        whole = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
        # Written before it is joined: Spark can split a frequent label's rows only in a join of plain shuffles.
        labels = written(out.groupBy(F.col("label").alias("own_label")).agg(whole.alias("label_error")), "label-errors")
        scope.keep(out, labels)
    out = out.join(labels, F.col("label").eqNullSafe(F.col("own_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
