"""Documents that hold passages of a benchmark, found by greedy string tiling.

Texts are compared as words, case folded and without marks. Every run of SEED words is a seed. Seeds of
documents are joined with those of the benchmark's items; documents are read once, and of their seeds only
those that a Bloom filter of the benchmark's lets through are shuffled, so the pass over the documents is one
however large the benchmark is. A document and an item that share enough seeds are compared: the
longest run of words that both have and that overlaps nothing marked before is marked, again and again,
until none of SEED words is left. Its length is searched with Karp-Rabin hashes of runs of one length after
the other, which takes memory in proportion to the two texts however often they repeat themselves. The share
of an item's words that are marked is its coverage: passages that were moved about still cover their item.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import prepare, temporary, written
from . import bloom
from .minhash import PIECE, word_hashes
from .tokens import slices

SEED = 5
COVERAGE = 0.4
TILE = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_start", "item_start", "length")])
TILED = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("matched", T.LongType()), T.StructField("tiles", T.ArrayType(TILE))])
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
#: The inverse of BASE modulo 2^64.
BACK = U(pow(int(BASE), -1, 1 << 64))
WORD = re.compile(r"\w+")
SPACE = re.compile(r"\s")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hashed(texts: list[str | None]) -> list[np.ndarray]:
    """A hash for each word of each text; long texts are read in pieces."""
    if sum(len(t) for t in texts if t) <= 2 * PIECE:
        lists = [words(t) for t in texts]
        flat, _ = word_hashes(" ".join(chain.from_iterable(lists)).encode("utf-8", "replace"))
        return np.split(flat, np.cumsum([len(w) for w in lists])[:-1])
    out = []
    for t in texts:
        low, at, parts = (t or "").lower(), 0, [np.zeros(0, U)]
        while at < len(low):
            found = SPACE.search(low, at + PIECE)
            to = found.start() if found else len(low)
            parts.append(word_hashes(" ".join(WORD.findall(low, at, to)).encode("utf-8", "replace"))[0])
            at = to
        out.append(np.concatenate(parts))
    return out


def rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of each run of n ids (each mixed first)."""
    x = (ids.astype(U) + U(1)) * BASE
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    out = np.zeros(max(0, len(x) - n + 1), dtype=U)
    for k in range(n):
        out = out * BASE + x[k : k + len(out)]
    return out


class Runs:
    """The words of a text that lie in seeds at the places given, as they lie there, and which of them are marked."""

    def __init__(self, ids: np.ndarray, places: np.ndarray, seed: int):
        covered = np.zeros(len(ids) + 1, np.int32)
        np.add.at(covered, places, 1)
        np.add.at(covered, places + seed, -1)
        self.at = np.flatnonzero(np.cumsum(covered[:-1]))
        self.ids = ids[self.at]
        self.taken = np.zeros(len(self.at), bool)
        # Prefix sums of ids times powers of BASE; a run's sum is moved back to the power 0 to compare it.
        n = len(self.at)
        x = (self.ids + U(1)) * U(0xBF58476D1CE4E5B9)
        x ^= x >> U(29)
        self.sums = np.concatenate((np.zeros(1, U), np.cumsum(x * np.cumprod(np.concatenate((np.ones(min(1, n), U), np.full(max(0, n - 1), BASE)))), dtype=U)))
        self.back = np.cumprod(np.concatenate((np.ones(1, U), np.full(n, BACK))))
        self.settle()

    def settle(self) -> None:
        """After marking: how many words each word's run of unmarked neighbours has from there on."""
        n = len(self.at)
        ends = np.flatnonzero(self.taken | np.append(np.diff(self.at) != 1, True)[:n])
        nearest = ends[np.searchsorted(ends, np.arange(n))] if n else ends
        self.free = np.where(self.taken, 0, nearest - np.arange(n) + ~self.taken[nearest]) if n else np.zeros(0, np.int64)

    def longest(self) -> int:
        return int(self.free.max()) if len(self.free) else 0

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the runs of n unmarked words, and their hashes."""
        at = np.flatnonzero(self.free >= n)
        return at, (self.sums[at + n] - self.sums[at]) * self.back[at]


def tiles(doc: Runs, item: Runs, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in document, start in item, length), longest first, ties by place, until no run of least words is left."""
    out: list[tuple[int, int, int]] = []
    most = 1 << 62

    def common(n: int):
        return np.intersect1d(doc.hashes(n)[1], item.hashes(n)[1])

    while True:
        # The greatest length that both have: doubled while it is met, then halved between.
        most = min(most, doc.longest(), item.longest())
        if most < least or not len(common(least)):
            return sorted(out)
        low, step = least, least
        while low + step <= most and len(common(low + step)):
            low, step = low + step, 2 * step
        high = min(most, low + step - 1)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(common(mid)) else (low, mid - 1)
        n = low
        both = common(n)
        starts, own = doc.hashes(n)
        places, theirs = item.hashes(n)
        starts, own = starts[(k := np.isin(own, both))], own[k]
        places, theirs = places[(k := np.isin(theirs, both))], theirs[k]
        order = np.argsort(theirs, kind="stable")
        places, theirs = places[order], theirs[order]
        first = dict(zip(both.tolist(), np.searchsorted(theirs, both, "left").tolist()))
        last = dict(zip(both.tolist(), np.searchsorted(theirs, both, "right").tolist()))
        ends = 0
        for p, h in zip(starts.tolist(), own.tolist()):
            if p < ends:
                continue
            # Places that are marked stay so: they are passed over once.
            while first[h] < last[h] and item.taken[places[first[h]] : places[first[h]] + n].any():
                first[h] += 1
            for k in range(first[h], last[h]):
                q = int(places[k])
                if not item.taken[q : q + n].any() and np.array_equal(doc.ids[p : p + n], item.ids[q : q + n]):
                    doc.taken[p : p + n] = item.taken[q : q + n] = True
                    out.append((int(doc.at[p]), int(item.at[q]), n))
                    ends = p + n
                    break
        doc.settle()
        item.settle()
        most = n - 1


class Text:
    """A document's words and, sorted, the seeds it has."""

    def __init__(self, ids: np.ndarray, seed: int):
        self.ids, self.seed = ids, seed
        seeds = rolled(ids, seed)
        self.order = np.argsort(seeds, kind="stable")
        self.seeds = seeds[self.order]

    def leaks(self, item: np.ndarray, coverage: float) -> list[tuple[int, int, int]]:
        """The tiles of an item if they cover enough of it, else none."""
        own = rolled(item, self.seed)
        uniq = np.unique(own)
        lo, hi = np.searchsorted(self.seeds, uniq, "left"), np.searchsorted(self.seeds, uniq, "right")
        found = uniq[hi > lo]
        theirs = Runs(item, np.flatnonzero(np.isin(own, found)), self.seed)
        # Marked words lie in seeds that both have: too few of these can't reach the threshold.
        if not len(found) or len(theirs.at) < coverage * len(item):
            return []
        lo, hi = lo[hi > lo], hi[hi > lo]
        places = self.order[np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        out = tiles(Runs(self.ids, np.sort(places), self.seed), theirs, self.seed)
        return out if sum(n for _, _, n in out) >= coverage * len(item) else []


def _items(benchmark: DataFrame, seed: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Items (fp, item_id, item_words, words), and their different word sequences (fp, words)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, text="t", most=1_000_000):
                lists = [words(t) for t in part.column("t").to_pylist()]
                joined = [" ".join(w) if len(w) >= seed else None for w in lists]
                fps = [None if j is None else hashlib.blake2b(j.encode("utf-8", "replace"), digest_size=16).digest() for j in joined]
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(fps, pa.binary()), pa.array([len(w) for w in lists], pa.int64()), pa.array(joined, pa.string())], names=["item_id", "fp", "item_words", "words"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    rows = written(rows.mapInArrow(run, "item_id long, fp binary, item_words long, words string").where("fp is not null"), "items")
    return rows, written(rows.groupBy("fp").agg(F.first("words").alias("words")), "item-words")


def _listed(texts: DataFrame, seed: int, coverage: float) -> DataFrame:
    """fp, seed, n (places of the seed in the item), lacks: how many more places than this frame's a document that covers the item may lack.

    Words of tiles that cover enough lie at so many seeds' places at least; an item's most frequent seeds that are fewer than these list it nowhere.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, text="words", most=1_000_000):
                for fp, own in zip(part.column("fp").to_pylist(), hashed(part.column("words").to_pylist())):
                    seeds, n = np.unique(rolled(own, seed), return_counts=True)
                    need = math.ceil(math.ceil(coverage * len(own) - 1e-9) / seed)
                    yield pa.RecordBatch.from_arrays([pa.array([fp] * len(seeds), pa.binary()), pa.array(seeds.view(np.int64)), pa.array(n.astype(np.int64)), pa.array([max(1, need)] * len(seeds), pa.int64())], names=["fp", "seed", "n", "need"])

    rows = written(texts.mapInArrow(run, "fp binary, seed long, n long, need long"), "seeds")
    spread = written(rows.groupBy("seed").agg(F.count("*").alias("items")), "seed-counts")
    # One item's seeds are one window.
    own = Window.partitionBy("fp")
    ranked = rows.join(spread, "seed").withColumn("passed", F.sum("n").over(own.orderBy(F.desc("items"), "seed"))).withColumn("skipped", F.col("passed") < F.col("need"))
    ranked = ranked.withColumn("want", F.col("need") - F.sum(F.when(F.col("skipped"), F.col("n")).otherwise(0)).over(own))
    return written(ranked.where("not skipped").select("fp", "seed", "n", "want"), "listed")


def _sifted(docs: DataFrame, text_col: str, listed: DataFrame, seed: int, whole: bool) -> DataFrame:
    """docs with __hits, the seeds of each text that the benchmark may have (null if none), and __row; rows without any only if whole."""
    known = docs.sparkSession.sparkContext.broadcast(bloom.build(listed.select("seed").distinct(), "seed"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, text=text_col, most=1_000_000):
                hits = []
                for own in hashed(part.column(text_col).to_pylist()):
                    seeds = rolled(own, seed)
                    seeds = np.unique(seeds[known.value.has(seeds)])
                    hits.append(seeds.view(np.int64) if len(seeds) else None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hits, pa.list_(pa.int64()))], names=[*part.schema.names, "__hits"])

    out = docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("__hits", T.ArrayType(T.LongType()))]))
    return written((out if whole else out.where("__hits is not null")).withColumn("__row", F.monotonically_increasing_id()), "sifted")


def _tiled(rows: DataFrame, texts: DataFrame, listed: DataFrame, seed: int, coverage: float) -> DataFrame:
    """row, doc_id, fp, matched, tiles of rows (row, doc_id, text, hits) and the items that they cover far enough."""
    shared = rows.select("row", F.explode("hits").alias("seed")).join(listed, "seed")
    pairs = written(shared.groupBy("row", "fp").agg(F.sum("n").alias("n"), F.first("want").alias("want")).where("n >= want").select("row", "fp"), "candidates")
    # A document's text, then the items to compare it with, one after the other.
    heads = rows.join(pairs.select("row").distinct(), "row", "left_semi").select("row", "doc_id", F.lit(None).cast("binary").alias("fp"), "text")
    lined = heads.unionByName(pairs.join(texts, "fp").select("row", F.lit(None).cast("long").alias("doc_id"), "fp", F.col("words").alias("text")))
    lined = lined.repartition("row").sortWithinPartitions("row", F.col("fp").asc_nulls_first())

    def run(batches):
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(TILED)
        doc = text = None
        for batch in batches:
            for part in slices(batch, text="text", most=1_000_000):
                out = []
                for row, doc_id, fp, own in zip(*(part.column(c).to_pylist() for c in ("row", "doc_id", "fp", "text"))):
                    if fp is None:
                        doc, text = doc_id, Text(hashed([own])[0], seed)
                    elif found := text.leaks(hashed([own])[0], coverage):
                        out.append((row, doc, fp, sum(t[2] for t in found), [dict(zip(("doc_start", "item_start", "length"), t)) for t in found]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return written(lined.mapInArrow(run, TILED), "leaks")


def find(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, matched, item_words, coverage, tiles: one row for each document and item that it covers far enough.

    benchmark: item_id, text. Null and empty texts and items of fewer than seed words match nothing;
    repeated rows on either side give a row each. Empty tables give no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    with temporary(docs.sparkSession) as scope:
        owners, texts = _items(benchmark, seed, "item_id", "text")
        listed = _listed(texts, seed, coverage)
        rows = _sifted(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text", listed, seed, False)
        found = _tiled(rows.select(F.col("__row").alias("row"), "doc_id", "text", F.col("__hits").alias("hits")), texts, listed, seed, coverage)
        scope.keep(found, owners)
    return found.join(owners.drop("words"), "fp").select("doc_id", "item_id", "matched", "item_words", (F.col("matched") / F.col("item_words")).alias("coverage"), "tiles")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that cover no item far enough (see find)."""
    prepare(docs.sparkSession)
    with temporary(docs.sparkSession) as scope:
        _, texts = _items(benchmark, seed, "item_id", "text")
        listed = _listed(texts, seed, coverage)
        rows = _sifted(docs, text_col, listed, seed, True)
        hit = rows.where("__hits is not null")
        found = _tiled(hit.select(F.col("__row").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col("__hits").alias("hits")), texts, listed, seed, coverage)
        gone = written(found.select(F.col("row").alias("__gone")).distinct(), "gone")
        scope.keep(rows, gone)
    return rows.where("__hits is null").unionByName(hit.join(gone, F.col("__row") == F.col("__gone"), "left_anti")).drop("__hits", "__row")
