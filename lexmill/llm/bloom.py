"""Bloom filters over 64-bit hashes, and joins by them that don't shuffle the larger side.

Spark sets the bits, every worker asks the whole filter.

A filter has BITS bits a key, PROBES of them set, and MOST bits at most: beyond that more keys pass that weren't
put in, so what passes is always checked by a join. No key that was put in is refused.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written

BITS, PROBES, LEAST, MOST = 32, 8, 1 << 12, 1 << 28
#: A filter that passes more of what wasn't put in is of no use to a join.
USEFUL = 0.01
U = np.uint64


class Bloom:
    def __init__(self, words: np.ndarray):
        self.words = words

    @property
    def rate(self) -> float:
        """The share of other keys that it passes."""
        return float(np.bitwise_count(self.words).sum() / (64 * len(self.words))) ** PROBES

    def mask(self, keys):
        """has() over an Arrow array of longs; null is in no filter."""
        import pyarrow as pa
        import pyarrow.compute as pc

        found = self.has(pc.fill_null(keys, 0).to_numpy(zero_copy_only=False).view("uint64"))
        return pc.and_(pa.array(found, pa.bool_()), pc.is_valid(keys))

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which keys (unsigned) may have been put in."""
        mask = U(len(self.words) * 64 - 1)
        out = np.arange(len(keys))
        at, step = keys & mask, (keys >> U(32) | U(1)) & mask
        for k in range(PROBES):
            bit = (at + step * U(k)) & mask
            ok = (self.words[(bit >> U(6)).astype(np.int64)] >> (bit & U(63)) & U(1)).astype(bool)
            out, at, step = out[ok], at[ok], step[ok]
            if not len(out):
                break
        found = np.zeros(len(keys), bool)
        found[out] = True
        return found


def build(keys: DataFrame, column: str) -> Bloom:
    """A filter of the longs in a column; the driver gathers its words that aren't zero, MOST / 64 of them at most."""
    n = keys.count()
    bits = LEAST
    while bits < min(MOST, n * BITS):
        bits *= 2
    h, mask = F.col(column), F.lit(bits - 1)
    at, step = h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1)).bitwiseAND(mask)
    probes = F.explode(F.array(*[(at + step * k).bitwiseAND(mask) for k in range(PROBES)])).alias("bit")
    # A shift by the low six bits, sign bit included.
    words = keys.select(probes).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63L as int)))").alias("set")).toArrow()
    out = np.zeros(bits // 64, U)
    out[words["word"].to_numpy()] = words["set"].to_numpy().view(U)
    return Bloom(out)


def _passed(rows: DataFrame, known: Bloom, on: list[str], wanted: bool) -> DataFrame:
    """The rows that the filter knows by the columns on, or those that it doesn't."""
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        import pyarrow.compute as pc

        for batch in batches:
            found = sent.value.mask(batch.column("__key"))
            yield batch.filter(found if wanted else pc.invert(found)).drop_columns(["__key"])

    return rows.withColumn("__key", F.xxhash64(*on)).mapInArrow(run, rows.schema)


def _same(rows: DataFrame, other: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join by the columns on, null equal to null."""
    named = other.select(*(F.col(c).alias(f"__{c}_other") for c in on))
    return rows.join(named, reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}_other")) for c in on)), how)


def without(rows: DataFrame, light: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose columns on aren't in gone. light: these columns of all rows, cheap to read.

    Rows that the filter of gone doesn't know stay at once, where they are read. Those that it takes wrongly are found in light,
    without the rows' other columns, and looked up. Rows are shuffled only if gone is too much for a filter.
    """
    known = build(gone.select(F.xxhash64(*on).alias("key")), "key")
    if known.rate > USEFUL:
        return _same(rows, gone, on, "left_anti")
    wrong = written(_same(_passed(light.select(*on), known, on, True), gone, on, "left_anti").distinct(), "wrong")
    out = _passed(rows, known, on, False)
    return out if wrong.isEmpty() else out.unionByName(_same(rows, wrong, on, "left_semi"))
