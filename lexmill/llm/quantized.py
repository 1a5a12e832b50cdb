"""Vectors of whole numbers: floor(scale * component), kept as bytes between Spark and its workers."""

from __future__ import annotations

import numpy as np

LONG = (1 << 63) - 1
NARROW, WIDE = "<i2", "<i8"


def floors(column, scale: int) -> list[bytes | None]:
    """For each list of an Arrow column floor(scale * x) of its components, 16 bits each if all fit, else 64.

    None for a null list and for one with a null or a component that isn't finite. What a long can't hold
    counts as the nearest long.
    """
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(flat * scale)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    out: list[bytes | None] = []
    at = 0
    for valid, size in zip(column.is_valid().to_pylist(), column.value_lengths().to_pylist()):
        if not valid:
            out.append(None)
            continue
        own, at = slice(at, at + size), at + size
        if bad[own.stop] > bad[own.start]:
            out.append(None)
            continue
        x = whole[own]
        if (np.abs(x) < 1 << 15).all():
            out.append(x.astype(NARROW).tobytes())
        else:
            inside = np.abs(x) < float(LONG)
            out.append(np.where(inside, np.where(inside, x, 0).astype(np.int64), np.where(x > 0, LONG, -LONG)).astype(WIDE).tobytes())
    return out


def matrix(codes: list[bytes], dim: int) -> np.ndarray:
    """The rows of floors(), all of dim components, as int64."""
    out = np.zeros((len(codes), dim), np.int64)
    wide = np.array([len(c) == 8 * dim for c in codes], bool)
    for kind, rows in ((NARROW, np.flatnonzero(~wide)), (WIDE, np.flatnonzero(wide))):
        if dim and len(rows):
            out[rows] = np.frombuffer(b"".join([codes[k] for k in rows]), kind).reshape(len(rows), dim)
    return out


def greatest(x: np.ndarray) -> int:
    """The largest component, without its sign."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of a and b, exact; beyond a long's range they count as its ends."""
    bound = greatest(a) * greatest(b) * max(1, a.shape[1])
    if bound < 1 << 53:
        # Every partial sum is a whole number that float64 holds.
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -LONG, LONG).astype(np.int64)
