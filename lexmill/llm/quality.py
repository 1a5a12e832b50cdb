"""Quality scores from a generalised additive model with pairwise interactions.

Each feature of a text falls into a bin; the score's log-odds are the sum of one table entry a
feature and one a pair of features. The tables are learned by boosting in cycles: in turn, each
feature gets a tree of two cuts on its own bins, then, on what is left, each of the pairs that gain
most gets a tree of one cut on either side. Scoring is a lookup and an addition a table.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import prepare, written
from .tokens import slices

FEATURES = (
    "log_words", "word_length", "letters", "capitals", "digits", "stops", "marks", "bars", "exclaims", "other_signs", "repeats",
    "distinct_500", "top_word", "same_lines", "line_words", "long_words", "signs_at_ends",
)
CLASSES = {name: np.array([chr(b) in chars for b in range(256)]) for name, chars in (("digits", "0123456789"), ("stops", ".,"), ("marks", "\"'();:?-"), ("bars", "|"), ("exclaims", "!"), ("other_signs", "#$%&*+/<=>@[\\]^_`{}~"))}
CLASSES["capitals"] = np.array([65 <= b <= 90 for b in range(256)])
CLASSES["letters"] = np.array([chr(b).isascii() and chr(b).isalpha() or b >= 128 for b in range(256)])
SIGNS = re.compile(r"[#$%&*!|]\s")


def features(text: str | None) -> list[float]:
    """One number a feature, of the whole text; zeros for null and for texts without words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    solid = max(1, len(raw) - raw.count(b" ") - raw.count(b"\n"))
    share = {k: float(counts[c].sum()) / solid for k, c in CLASSES.items()}
    n = len(words)
    # How many words are new, in the mean of pieces of 500: it doesn't fall with the length.
    pieces = [words[i : i + 500] for i in range(0, n, 500)]
    counted = [Counter(p) for p in pieces]
    distinct = sum(map(len, counted)) / n
    top = max(max(c.values()) for c in counted) / min(n, 500)
    lines = text.split("\n")
    return [
        float(np.log1p(n)), solid / n, share["letters"], share["capitals"], share["digits"], share["stops"], share["marks"], share["bars"], share["exclaims"], share["other_signs"],
        sum(map(eq, words, words[1:])) / n, distinct, top, 1 - len(set(lines)) / len(lines), n / len(lines), sum(len(w) > 20 for w in words) / n, len(SIGNS.findall(text)) / n,
    ]


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        for (i, j), grid in zip(self.pairs, self.grids):
            out += grid[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _value(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def two_cuts(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What a tree of two cuts on ordered bins adds to each bin; g, h: sums of gradients and curvatures by bin."""
    n = len(g)
    if n < 2:
        return np.zeros(n)

    def best(lo: int, hi: int) -> tuple[float, int]:
        cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
        k = int(gain.argmax()) if len(gain) else 0
        return (float(gain[k]), lo + k + 1) if len(gain) else (-1.0, hi)

    _, first = best(0, n)
    left, right = best(0, first), best(first, n)
    edges = sorted({0, first, (left if left[0] >= right[0] else right)[1], n})
    out = np.zeros(n)
    for a, b in zip(edges, edges[1:]):
        out[a:b] = _value(g[a:b].sum(), h[a:b].sum())
    return out


def cross_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on either axis of a grid of bins."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def corners(c):
        a = c[:-1, :-1]
        left, up, total = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return a, left - a, up - a, total - left - up + a

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    parts = list(zip(corners(cg), corners(ch)))
    gain = sum(_gain(x, y) for x, y in parts)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty(g.shape)
    values = [_value(x[i, j], y[i, j]) for x, y in parts]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), out


def fit_tables(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, bins: int = 64, grid_bins: int = 12, pairs: int = 10, pair_rounds: int = 60) -> Model:
    """x: rows of features; y: 0 or 1."""
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    width = x.shape[1]
    if not len(y):
        return Model(0.0, [np.zeros(0)] * width, [np.zeros(1)] * width)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(float(np.log(mean / (1 - mean))), [quantiles(x[:, j], bins) for j in range(width)], [])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    odds = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-odds))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            step = rate * two_cuts(np.bincount(at[j], g, len(model.tables[j])), np.bincount(at[j], h, len(model.tables[j])))
            model.tables[j] += step
            odds += step[at[j]]
    model.coarse = [quantiles(x[:, j], grid_bins) for j in range(width)]
    rough = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.coarse)]
    sizes = [len(c) + 1 for c in model.coarse]
    cell = lambda i, j: rough[i] * sizes[j] + rough[j]
    grid = lambda i, j, w: np.bincount(cell(i, j), w, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
    g, h = slopes()
    gains = sorted(((-cross_cut(grid(i, j, g), grid(i, j, h))[0], i, j) for i, j in combinations(range(width), 2)))
    model.pairs = [(i, j) for gain, i, j in gains[:pairs] if gain < 0]
    model.grids = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * cross_cut(grid(i, j, g), grid(i, j, h))[1]
            model.grids[k] += step
            odds += step[rough[i], rough[j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000) -> Model:
    """A model from labelled documents that train (a predicate on the id column of docs) admits.

    Bound: max_rows labelled rows, those of the smallest hashes of their ids. Rows of null id or label count for nothing;
    a document labelled more than once has the label that most say, 1 if they are even. Without labels every score is 0.5.
    """

    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, text="text"):
                rows = [features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) == 1).cast("int").alias("y")).where("doc_id is not null and y is not null")
    # Labels of one document become one, so that no id's rows multiply.
    marked = written(marked.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")), "labels")
    n = marked.count()
    share = int(min(1.0, 2.0 * max_rows / max(1, n)) * (1 << 30))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), train.alias("ok")).where(F.col("ok") & (place < share)).select("doc_id", "text")
    rows = own.mapInArrow(run, "doc_id long, x array<double>").join(marked.where(place < share), "doc_id").select(place.alias("place"), "doc_id", "x", "y")
    rows = sorted(rows.orderBy("place", "doc_id", "x").limit(max_rows).collect(), key=lambda r: (r.place, r.doc_id, r.x))
    return fit_tables(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) for every row of docs.

    Null, empty and very long texts are scored like any other, from the whole text. Repeated and null
    ids are rows of their own; an empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, text="text"):
                x = np.array([features(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def accept(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score least or more (see score)."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, text=text_col):
                x = np.array([features(t) for t in part.column(text_col).to_pylist()])
                yield part.filter(pa.array(model.score(x) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
