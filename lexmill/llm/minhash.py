"""Near-duplicate documents by bottom-k sketches of their word shingles.

One hash function; a document's sketch is the k smallest hashes of its distinct shingles. Documents
with equal sets of shingles are one node. Inverted lists of the retained values give candidates, the
sketch of a pair's union estimates its similarity, and full sets confirm it.

What keeps it whole and linear:
* A node is listed only under the rarer three quarters of its sketch. Two sketches that share more than a quarter
  of their values meet in one of these at least, and sketches of sets with a similarity of 0.75 fail to do so
  less than once in 10^16 pairs at k = 64. So a passage that is a small part of many documents makes no list.
* Lists of up to SHORT nodes give all their pairs. Longer ones come from large groups of near copies: each
  compares its nodes with one leader. Nodes linked with a leader hang together through it. The others are
  compared with all nodes of that leader's lists, block by block: first by their sketches, then, where these
  say that links may be, by full sets. A block returns a spanning forest, never all pairs.
* A node is named by the smallest id of its rows. Ids that rows of different sets share name none: their
  nodes are named by their sets.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import prepare, temporary, written
from . import bloom
from .components import components, joined, made_name, named
from .tokens import slices

K = 64
SHORT = 16
#: Nodes, and bytes of their sets or sketches, in a block of a long list.
BLOCK = 512
BLOCK_BYTES = 16 << 20
#: Nodes of a block that are compared with the others at once.
STRIP = 256
#: Bytes of a text that are hashed at once: each takes some 30 while they are.
PIECE = 1 << 20
#: Bytes of short texts that are hashed together.
AT_ONCE = 400_000
BLANK = re.compile(rb"[ \t-\r]")
WORDS = 5
#: How far the estimate of a pair that is similar enough may lie below the threshold, in standard deviations.
SIGMAS = 9.0
U = np.uint64
BASE, MIX = U(0x9E3779B97F4A7C15), (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_POWERS = np.ones(1, dtype=U)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate((np.ones(1, U), np.cumprod(np.full(max(n, 4096), BASE, dtype=U))))
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX[0]
    x = (x ^ (x >> U(27))) * MIX[1]
    return x ^ (x >> U(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in data, and where each starts."""
    data = np.frombuffer(data + b" ", dtype=np.uint8)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    if not len(starts):
        return np.zeros(0, U), starts
    head = int(starts[0])
    place = np.arange(len(data) - head) - np.repeat(starts - head, np.diff(np.append(starts, len(data))))
    letters = np.where(white[head:], U(0), data[head:].astype(U) + U(1))
    return mix(np.add.reduceat(letters * powers(int(place.max()) + 1)[place], starts - head)), starts


def pieces(data: bytes):
    """data in parts of about PIECE bytes, cut at white space."""
    at = 0
    while at < len(data):
        found = BLANK.search(data, at + PIECE)
        to = found.start() if found else len(data)
        yield data[at:to]
        at = to


def set_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """The distinct shingles of a text whose words have these hashes."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    factors = powers(words + 1)[1:]
    if n < words:
        return (mix(np.array([(hashes * factors[:n]).sum(dtype=U) + U(n)])) >> U(1)).astype(np.int64)
    rolled = np.zeros(n - words + 1, dtype=U)
    for k in range(words):
        rolled += hashes[k : k + len(rolled)] * factors[k]
    return np.unique((mix(rolled) >> U(1)).view(np.int64))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 63-bit hashes.

    A-Z count as a-z; words are what lies between spaces and the characters U+0009 to U+000D. A text of
    fewer words is one shingle, one without words has none.
    """
    raw = [t.encode("utf-8", "replace").translate(LOWER) if t else b"" for t in texts]
    if sum(map(len, raw)) > 2 * PIECE:
        return [set_of(np.concatenate([np.zeros(0, U), *(word_hashes(x)[0] for x in pieces(r))]), words) for r in raw]
    hashes, starts = word_hashes(b" ".join(raw))
    bounds = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw])).tolist()
    return [set_of(hashes[lo:hi], words) for lo, hi in zip([0, *bounds], bounds)]


def _lists(pa, arrays: list[np.ndarray]):
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, mark, n (shingles), fp (128 bits of the set; null without shingles), sketch, from docs (doc_id, mark, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, text="text", most=AT_ONCE):
                sets = shingle_sets(part.column("text").to_pylist(), words)
                fps = [digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), _lists(pa, [s[:k] for s in sets])], names=["doc_id", "mark", "n", "fp", "sketch"])

    return docs.mapInArrow(run, "doc_id long, mark long, n long, fp binary, sketch array<long>")


def full_sets(docs: DataFrame, words: int = WORDS, wanted: bloom.Bloom | None = None) -> DataFrame:
    """doc_id, fp, shingles (sorted hashes as bytes), from docs (doc_id, text); with wanted only of the ids that it knows, and maybe a few others."""
    known = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if known.value:
                batch = batch.filter(known.value.mask(batch.column("key")))
            for part in slices(batch, text="text", most=AT_ONCE):
                sets = shingle_sets(part.column("text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "fp", "shingles"])

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key")).mapInArrow(run, "doc_id long, fp binary, shingles binary")


def common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, both (shingles in common), either (in the union) of pairs (a, b)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, text="sa", most=8_000_000):
                both, either = [], []
                for x, y in zip(part.column("sa").to_pylist(), part.column("sb").to_pylist()):
                    both.append(common(np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")))
                    either.append(len(x) // 8 + len(y) // 8 - both[-1])
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "both", "either"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, both long, either long")


def estimated(pairs: DataFrame, nodes: DataFrame, least: float, k: int = K) -> DataFrame:
    """The pairs (a, b) whose estimated similarity is not clearly below least: the k smallest values of both sketches sample their union."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, rows=2048):
                keep = []
                for x, y in zip(part.column("ka"), part.column("kb")):
                    x, y = x.values.to_numpy(), y.values.to_numpy()
                    union = np.union1d(x, y)[:k]
                    share = common(np.intersect1d(x, y, assume_unique=True), union) / len(union)
                    spread = (least * (1 - least) / len(union)) ** 0.5 if len(union) >= k else 0
                    keep.append(share >= least - SIGMAS * spread - 1e-9)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("ka"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("kb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ka", "kb").mapInArrow(run, "a long, b long")


def similar(percent: int) -> Column:
    return F.col("both") * 100 >= F.col("either") * percent


def _classes(docs: DataFrame, id_col: str, text_col: str, percent: int, k: int, words: int, short: int) -> tuple[DataFrame, bool]:
    """doc_id, mark (64 bits of the text), n, component_id and class (a number of the group; null where there is none) of every row, and whether ids repeat."""
    prepare(docs.sparkSession)
    with temporary(docs.sparkSession) as scope:
        signed, ids, repeated = _linked(docs, id_col, text_col, percent, k, words, short)
        scope.keep(signed, ids)
    out = signed.select("doc_id", "mark", "n", "fp").join(ids, (F.col("fp") == F.col("own")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", "mark", "n", F.coalesce("component", "doc_id").alias("component_id"), "class"), repeated


def _linked(docs: DataFrame, id_col: str, text_col: str, percent: int, k: int, words: int, short: int) -> tuple[DataFrame, DataFrame, bool]:
    """Signatures of all rows, own (fp), class and component of each set, and whether ids repeat."""
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    signed = written(signatures(texts, k, words), "sketches")
    usable = signed.where("n > 0 and doc_id is not null")
    h = F.xxhash64("fp")
    repeats = written(signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(h).alias("low"), F.max(h).alias("high")).where("rows > 1").select("doc_id", (F.col("low") != F.col("high")).alias("mixed")), "repeats")
    repeated = not repeats.isEmpty()
    first = [F.min("doc_id").alias("least"), F.first("sketch").alias("sketch")]
    if repeated:
        mixed = repeats.where("mixed")
        nodes = named(usable, mixed, "doc_id").groupBy("fp").agg(F.min(F.when(F.col("own"), F.col("doc_id"))).alias("own"), *first)
        nodes = nodes.select("fp", F.coalesce("own", made_name("fp")).alias("node"), "least", "sketch")
    else:
        nodes = usable.groupBy("fp").agg(*first).select("fp", F.col("least").alias("node"), "least", "sketch")
    nodes = written(nodes, "nodes")

    listed = written(_listed(nodes, short), "lists")
    near = listed.where("hot = 0").groupBy("v").agg(F.collect_set("node").alias("all"))
    near = near.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a < b").distinct()
    near = written(estimated(near, nodes, percent / 100, k), "pairs")
    hot = listed.where("hot = 1").select("v", "node")
    wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).unionByName(hot.select("node")).distinct()
    if repeated:
        # A node's set is that of any of its rows; rows that repeat both id and text are one.
        own = nodes.join(wanted, "node", "left_semi").select("fp").join(usable.select("fp", "doc_id", "mark"), "fp").select("doc_id", "mark").distinct()
        rows = full_sets(texts.join(own, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"]), words)
        rows = named(rows, mixed, "doc_id").groupBy("fp").agg(F.min(F.when(F.col("own"), F.col("doc_id"))).alias("own"), F.first("shingles").alias("shingles"))
        sets = rows.select(F.coalesce("own", made_name("fp")).alias("node"), "shingles")
    else:
        known = bloom.build(written(wanted, "wanted").select(F.xxhash64("node").alias("key")), "key")
        if known.rate > bloom.USEFUL:
            texts, known = texts.join(wanted.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"), None
        sets = full_sets(texts, words, known).select(F.col("doc_id").alias("node"), "shingles")
    sets = written(sets, "sets")
    links = confirmed(near, sets).where(similar(percent)).select("a", "b")
    parts = [written(links, "links"), *_hot_links(hot, nodes, sets, percent, k)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    reach = components(found)
    ids = nodes.select("fp", "node", "least").join(reach, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("class"))
    if repeated:
        # Names made from sets are no ids.
        ids = written(ids, "node-classes")
        smallest = written(ids.groupBy("class").agg(F.min("least").alias("component")), "class-ids")
        ids = ids.join(smallest, "class")
    else:
        ids = ids.withColumn("component", F.col("class"))
    return signed, written(ids.select(F.col("fp").alias("own"), "class", "component"), "set-classes"), repeated


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, k: int = K, words: int = WORDS, short: int = SHORT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Documents are linked when 100 * shared shingles >= percent * shingles of both; component_id is the
    smallest doc_id reachable by links. Null and empty texts and texts without words have no shingle and
    are linked with nothing. A row of null id is linked with nothing, component_id null, kept true.
    Rows that repeat an id are documents of their own, linked by their own texts alone. An empty table gives no rows; other columns are ignored.
    """
    out, _ = _classes(docs, id_col, text_col, percent, k, words, short)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of docs, all columns, without near copies: of each linked group one row stays, one of the smallest id (see link).

    Rows that repeat an id are judged by their own texts; of those that also repeat the text, with or without words, one stays. Rows of null id stay.
    """
    rows, repeated = _classes(docs, id_col, text_col, percent, K, WORDS, SHORT)
    every = written(rows, "linked")
    rows = every.where("doc_id is not null")
    light = every.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"))
    docs = docs.withColumns({"__id": F.col(id_col).cast("long"), "__mark": F.xxhash64(F.col(text_col).cast("string"))})
    if not repeated:
        gone = written(rows.where("doc_id <> component_id").select(F.col("doc_id").alias("__id")), "gone")
        return bloom.without(docs.drop("__mark"), light, gone, ["__id"]).drop("__id")
    # Texts, told by their marks: the smallest of the rows that could stay for a group stays.
    texts = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id"), F.min("class").alias("class"))
    texts = written(texts, "texts")
    stays = texts.where("doc_id = component_id").groupBy("doc_id", F.coalesce("class", "mark").alias("key"), F.col("class").isNull().alias("wordless")).agg(F.min("mark").alias("mark"))
    marked = texts.join(stays.select("doc_id", "mark", F.lit(True).alias("stays")), ["doc_id", "mark"], "left").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.coalesce("stays", F.lit(False)).alias("stays"), "n")
    marked = written(marked.where("not stays or n > 1"), "marked")
    out = bloom.without(docs, light, marked, ["__id", "__mark"]).drop("__id", "__mark")
    again = docs.join(marked.where("stays").select("__id", "__mark"), ["__id", "__mark"], "left_semi").drop("__id", "__mark")
    return out.unionByName(again.dropDuplicates([id_col, text_col]))


def _listed(nodes: DataFrame, short: int) -> DataFrame:
    """v, node, hot (0 or 1): the nodes under each value of the rarer three quarters of their sketches, for values with two nodes at least."""
    rows = nodes.select("node", F.size("sketch").alias("size"), F.explode("sketch").alias("v"))
    # Counts are written before they are joined: Spark can split a frequent value's rows only in a join of plain shuffles.
    spread = written(rows.groupBy("v").agg(F.count("*").alias("n")).where("n > 1"), "spread")
    shared = rows.join(spread, "v")
    by_node = Window.partitionBy("node")
    # Values that no other node has come first and list nothing.
    ranked = shared.select("v", "node", "size", F.row_number().over(by_node.orderBy("n", "v")).alias("rank"), F.count("*").over(by_node).alias("shared"))
    rare = written(ranked.where("rank + size - shared <= ceil(3 * size / 4)").select("v", "node"), "rare")
    held = written(rare.groupBy("v").agg(F.count("*").alias("n")).where("n > 1"), "held")
    return rare.join(held, "v").select("v", "node", (F.col("n") > short).cast("int").alias("hot"))


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """How many values each set in a shares with each in b."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    if not len(both):
        return out

    def places(sets, flat):
        """Owners of the shared values, by value, and the values' places."""
        at = np.searchsorted(both, flat)
        at[at == len(both)] = 0
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        ok = both[at] == flat
        order = np.argsort(at[ok], kind="stable")
        return rows[ok][order], at[ok][order]

    (row_a, col_a), (row_b, col_b) = places(a, flat_a), places(b, flat_b)
    n_a, n_b = np.bincount(col_a, minlength=len(both)), np.bincount(col_b, minlength=len(both))
    # Values of many sets are counted by products of matrices, those of few pair by pair.
    many = n_a * n_b > out.size // 64
    for lo in range(0, int(many.sum()), columns):
        own = np.flatnonzero(many)[lo : lo + columns]
        parts = []
        for n, row, col in ((len(a), row_a, col_a), (len(b), row_b, col_b)):
            m = np.zeros((n, len(own)), dtype=np.float32)
            at = np.searchsorted(own, col)
            at[at == len(own)] = 0
            ok = own[at] == col
            m[row[ok], at[ok]] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    few = np.flatnonzero(~many)
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    pairs = np.cumsum(n_a[few] * n_b[few])
    at = 0
    while at < len(few):
        to = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + 500_000, side="right")))
        own = few[at:to]
        each = n_a[own] * n_b[own]
        k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        wide = np.repeat(n_b[own], each)
        i = row_a[np.repeat(first_a[own], each) + k // wide]
        j = row_b[np.repeat(first_b[own], each) + k % wide]
        out += np.bincount(i * len(b) + j, minlength=out.size).reshape(out.shape).astype(np.float32)
        at = to
    return out


def _forest(alike):
    """Spanning forests of the pairs in a block that alike(shared, sizes of the one, sizes of the other) admits."""

    def compare(pdf):
        import pandas as pd

        asks = pdf["asks"].to_numpy(bool)
        node = pdf["node"].to_numpy()
        sets = [np.frombuffer(x, "<i8") if isinstance(x, bytes) else np.asarray(x) for x in pdf["values"]]
        rows, cols = np.flatnonzero(asks), np.flatnonzero(~asks)
        order = np.unique(node)
        rank = np.searchsorted(order, node)
        size = np.array([len(s) for s in sets])
        root = np.arange(len(order))
        # Strip by strip, of whose links only a forest is kept.
        for at in range(0, len(rows) if len(cols) else 0, STRIP):
            own = rows[at : at + STRIP]
            both = shared_counts([sets[k] for k in own], [sets[k] for k in cols])
            i, j = np.nonzero(alike(both, size[own][:, None], size[cols][None, :]))
            known = np.flatnonzero(root != np.arange(len(order)))
            root = joined(np.concatenate((known, rank[own[i]])), np.concatenate((root[known], rank[cols[j]])), len(order))
        linked = np.flatnonzero(root != np.arange(len(order)))
        return pd.DataFrame({"a": order[linked], "b": order[root[linked]]})

    return compare


def _blocked(members: DataFrame, alike, name: str) -> DataFrame:
    """Forests (a, b) of members (group, node, values, waits): those that wait are compared with all of their group, block by block."""
    members = written(members, f"{name}-members")
    length = F.octet_length("values") if members.schema["values"].dataType.typeName() == "binary" else 8 * F.size("values")
    size = lambda which: F.greatest(F.ceil(F.count_if(which) / BLOCK), F.ceil(F.sum(F.when(which, length).otherwise(0)) / BLOCK_BYTES)).cast("int")
    blocks = members.groupBy("group").agg(size(F.col("waits")).alias("ask_blocks"), size(F.lit(True)).alias("all_blocks")).where("ask_blocks > 0")
    blocks = written(blocks, f"{name}-blocks")
    dealt = members.join(blocks, "group").withColumn("place", F.xxhash64("node"))
    own = lambda n: F.pmod("place", F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = dealt.where("waits").select("group", own("ask_blocks").alias("i"), every("all_blocks").alias("j"), "node", "values", F.lit(True).alias("asks"))
    answers = dealt.select("group", every("ask_blocks").alias("i"), own("all_blocks").alias("j"), "node", "values", F.lit(False).alias("asks"))
    return written(asks.unionByName(answers).groupBy("group", "i", "j").applyInPandas(_forest(alike), "a long, b long"), name)


def _hot_links(hot: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, k: int) -> list[DataFrame]:
    """Links of nodes in long lists that, with all of their kind, connect the same nodes as all links do."""
    if hot.isEmpty():
        return []
    # The nodes under most long lists are the likeliest centres.
    central = hot.groupBy("node").agg(F.count("*").alias("lists"))
    ranked = hot.join(central, "node")
    leads = written(ranked.groupBy("v").agg(F.min(F.struct((-F.col("lists")).alias("l"), "node")).alias("top")).select("v", F.col("top.node").alias("leader")), "leads")
    led = written(hot.join(leads, "v").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "led")
    seen = written(confirmed(led.where("a <> b"), sets).select("a", "b", similar(percent).alias("linked")), "leaders")
    out = [seen.where("linked").select("a", "b")]
    if seen.where("not linked").isEmpty():
        return out
    # Two nodes that share a list share its leader: they hang together if both are linked with it, else one of them waits.
    members = seen.select(F.col("b").alias("group"), F.col("a").alias("node"), (~F.col("linked")).alias("waits")).unionByName(leads.select(F.col("leader").alias("group"), F.col("leader").alias("node"), F.lit(False).alias("waits")).distinct())
    least = percent / 100
    floor = least - SIGMAS * (least * (1 - least) / k) ** 0.5

    def near(both, n, m):
        # What two sketches share is no less than what the sketch of their union shows.
        return both >= np.maximum(1, floor * np.minimum(k, n + m - both))

    rough = _blocked(members.join(nodes.select("node", F.col("sketch").alias("values")), "node"), near, "rough")
    groups = components(rough, "groups").select("node", F.col("component").alias("group"))
    waiting = written(seen.where("not linked").select(F.col("a").alias("node"), F.lit(True).alias("waits")).distinct(), "waiting")
    members = sets.withColumnRenamed("shingles", "values").join(groups, "node").join(waiting, "node", "left").withColumn("waits", F.coalesce("waits", F.lit(False)))
    return [*out, _blocked(members, lambda both, n, m: 100 * both >= percent * (n + m - both), "forest")]
