"""Learning merges over words that no one process holds.

Words are dealt into shards, each a learner with its own counts and postings, which lies in the shared folder
between rounds. Counts add up over shards, and after a pair has come up its count only falls. So the driver, which knows the
exact counts of the pairs before a bound, knows all that may be chosen until the best of them reaches that bound; then the next are
summed up over all shards.

A round tries many merges: the driver guesses what they are, from the exact counts and the words of the highest frequencies;
every shard takes the merges that are certain, writes itself, then tries the guess and reports how it changes the counts of the pairs
that are known and of those that it makes. The sums tell after each step which pair is best. Guesses that
are right are taken, and at the first wrong one the pair that is right: a guess costs time, never a result.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import prepare, remove, written
from .train import COUNTINGS, FIRST_MERGE, Learner, Pair

#: Distinct words of a shard, and bytes of them.
SHARD_WORDS, SHARD_BYTES = 50_000, 1 << 20
#: Words that guesses are made from, and bytes of them: the driver's share.
GUESS_WORDS, GUESS_BYTES = 200_000, 4 << 20
#: Pairs that the driver knows the counts of after summing up, and merges that a round tries at most.
KNOWN_PAIRS, MOST_TRIED = 4_096, 512

ROUND = "shard int, state binary, l int, r int, step int, n long"


class Shard(Learner):
    """A learner that neither chooses nor forgets: its counts are parts of sums, so they may be negative."""

    def __init__(self, words: Iterable[tuple[bytes, int]], counting: str):
        super().__init__(words, counting)
        self.queue = None

    def apply(self, pair: str, new: int) -> tuple[dict[str, int], dict[str, int]]:
        self.count.pop(pair, None)
        grown, less = self.visit(pair, new)
        less.pop(pair, None)
        for p, n in less.items():
            self.count[p] -= n
        self.count.update(grown)
        return grown, less


class Guess(Learner):
    """What comes next, by the words of the highest frequencies and the exact counts of some pairs.

    These words are a part of all: what they say of a merge is blown up to the count of its pair.
    """

    def fork(self) -> Guess:
        """A copy to try merges on. Places of a pair never change once it has come up, so copies share them."""
        other = Guess.__new__(Guess)
        other.exact, other.freq, other.tokens, other.count, other.words = self.exact, self.freq, list(self.tokens), dict(self.count), self.words.copy()
        return other

    def take(self, pair: str, new: int, exact: dict[str, int], n: int = 0) -> list[str]:
        """Merge here and estimate the exact counts after it; n: that of the pair. The pairs that come up."""
        own = self.count.pop(pair, 0)
        scale = max(1.0, n / own) if own > 0 else 1.0
        grown, less = self.visit(pair, new)
        for p, m in less.items():
            if p in self.count:
                self.count[p] -= m
            if p in exact:
                exact[p] -= round(m * scale)
        for p, m in grown.items():
            self.count[p] = m
            exact[p] = round(m * scale)
        return list(grown)

    def ahead(self, exact: dict[str, int], first: int, most: int, least: int) -> list[tuple[str, int]]:
        """Up to most merges from here; this object and exact are spent then."""
        queue = [(-n, p) for p, n in exact.items() if n >= least]
        heapq.heapify(queue)
        out: list[tuple[str, int]] = []
        while queue and len(out) < most:
            n, pair = heapq.heappop(queue)
            now = exact.get(pair, 0)
            if -n != now:
                if now >= least:
                    heapq.heappush(queue, (-now, pair))
                continue
            del exact[pair]
            out.append((pair, first + len(out)))
            for p in self.take(*out[-1], exact, now):
                if exact[p] >= least:
                    heapq.heappush(queue, (-exact[p], p))
        return out


def text(pair: Pair) -> str:
    return chr(pair[0]) + chr(pair[1])


def ids(pair: str) -> Pair:
    return ord(pair[0]), ord(pair[1])


def _build(frames, counting: str):
    """Rows (shard, pre_token, freq), shard after shard, as rows (shard, state)."""
    import pandas as pd

    words: list[tuple[bytes, int]] = []
    current = None

    def out():
        return pd.DataFrame({"shard": [current], "state": [pickle.dumps(Shard(words, counting), pickle.HIGHEST_PROTOCOL)]})

    for frame in frames:
        for shard, own in frame.groupby("shard", sort=False):
            if shard != current:
                if current is not None:
                    yield out()
                current, words = int(shard), []
            words += zip((w.encode() for w in own["pre_token"]), own["freq"].tolist())
    if current is not None:
        yield out()


def _round(batches, taken: list[tuple[str, int]], tried: list[tuple[str, int]], known: set[str], every: bool):
    """Each shard as it is after the merges taken, and its counts: of known pairs and those that the last merges made (every: of all), then how the merges tried change them."""
    import pyarrow as pa

    fields = [pa.field(n, t) for n, t in zip(("shard", "state", "l", "r", "step", "n"), (pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("state").to_pylist()):
            own = pickle.loads(blob)
            watched = set(known)
            for pair, new in taken:
                watched.update(own.apply(pair, new)[0])
            if taken:
                blob = pickle.dumps(own, pickle.HIGHEST_PROTOCOL)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((shard, blob, None, None, None, None), fields)], schema=pa.schema(fields))
            rows = [(p, 0, n) for p, n in own.count.items()] if every else [(p, 0, own.count[p]) for p in watched if p in own.count]
            for k, (pair, new) in enumerate(tried):
                grown, less = own.apply(pair, new)
                watched.update(grown)
                rows += [(p, k + 1, n) for p, n in grown.items()]
                rows += [(p, k + 1, -n) for p, n in less.items() if p in watched]
            for at in range(0, len(rows), 10_000):
                part = rows[at : at + 10_000]
                columns = [[None] * len(part), [None] * len(part), [ord(p[0]) for p, _, _ in part], [ord(p[1]) for p, _, _ in part], [k for _, k, _ in part], [n for _, _, n in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))


Key = tuple[int, str]


class Counts:
    """Exact counts of all pairs whose key (count negated, pair) comes before bound; None: of all pairs that may be merged."""

    def __init__(self, counts: dict[str, int], bound: Key | None):
        self.bound = bound
        self.counts = {p: n for p, n in counts.items() if self.before(n, p)}
        self.queue = [(-n, p) for p, n in self.counts.items()]
        heapq.heapify(self.queue)

    def before(self, n: int, pair: str) -> bool:
        return n > 0 and (self.bound is None or (-n, pair) < self.bound)

    def add(self, pair: str, n: int) -> None:
        now = self.counts.get(pair, 0) + n
        self.counts[pair] = now
        if n > 0:
            heapq.heappush(self.queue, (-now, pair))

    def best(self, least: int) -> str | None:
        while self.queue:
            n, pair = self.queue[0]
            now = self.counts.get(pair, 0)
            if now >= least and self.before(now, pair):
                if -n == now:
                    return pair
                heapq.heapreplace(self.queue, (-now, pair))
            else:
                heapq.heappop(self.queue)
        return None


def learn_sharded(words: DataFrame, num_merges: int, min_frequency: int = 2, counting: str = "compat", known: Iterable[tuple[Pair, int]] = (), shard_words: int = SHARD_WORDS, guess_words: int = GUESS_WORDS, pairs: int = KNOWN_PAIRS, tried: int = MOST_TRIED) -> list[tuple[Pair, int]]:
    """The rules that train.learn gives from words (pre_token, freq), known ones first, in rounds over shards.

    The driver holds pairs counts, guess_words words (GUESS_BYTES at most) and what a round changes in the counts before the bound; a task
    holds one shard of about shard_words words (SHARD_BYTES, one word at least). Each round reads and writes every shard once: a lost
    executor costs a round at most. Known rules are taken in one round.
    """
    if counting not in COUNTINGS:
        raise ValueError("counting is compat or exact")
    spark = words.sparkSession
    prepare(spark)
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("pre_token")), F.lit(0)).alias("bytes")).first()
    if not size.n:
        return list(known)[:num_merges]
    if num_merges <= len(known := list(known)):
        return known[:num_merges]
    shards = max(-(-size.n // shard_words), -(-size.bytes // SHARD_BYTES), min(spark.sparkContext.defaultParallelism, size.n))
    dealt = words.select(F.pmod(F.xxhash64("pre_token"), F.lit(shards)).cast("int").alias("shard"), "pre_token", "freq")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "pre_token")
    state = written(dealt.mapInPandas(partial(_build, counting=counting), "shard int, state binary"), "shards")
    frequent = words.where(F.octet_length("pre_token") <= 64).orderBy(F.desc("freq"), "pre_token").limit(min(guess_words, GUESS_BYTES // 16)).toArrow()
    guess = Guess(zip((w.encode() for w in frequent["pre_token"].to_pylist()), frequent["freq"].to_pylist()), counting)

    least = max(1, min_frequency)
    out: list[tuple[str, int]] = [(text(p), new) for p, new in list(known)[:num_merges]]
    taken, counts, last = list(out), None, 0
    length = 16
    while True:
        every = counts is None
        # Of the last merge the shards haven't told yet what it does.
        exact = {} if every else counts.counts.copy()
        for k, (pair, new) in enumerate(taken):
            guess.take(pair, new, exact if k == len(taken) - 1 else {}, last)
        trying = [] if every or len(out) == num_merges else guess.fork().ahead(exact, FIRST_MERGE + len(out), min(length, num_merges - len(out)), least)
        watched = set(counts.counts) if counts else set()
        known_shards = state if state.rdd.getNumPartitions() >= min(shards, spark.sparkContext.defaultParallelism) else state.repartitionById(shards, F.col("shard"))
        done = written(known_shards.mapInArrow(partial(_round, taken=taken, tried=trying, known=watched, every=every), ROUND), "shards")
        remove(spark, state._lexmill_path)
        place = done._lexmill_path
        state = done.where("state is not null").select("shard", "state")
        state._lexmill_path = place
        sums = done.where("state is null").groupBy("l", "r", "step").agg(F.sum("n").alias("n"))
        merged = {p for p, _ in out}
        if every:
            rows = sums.where(F.col("n") >= least).orderBy(F.desc("n"), "l", "r").limit(pairs + 1).collect()
            bound = (-rows[-1].n, text((rows[-1].l, rows[-1].r))) if len(rows) > pairs else None
            counts = Counts({text((r.l, r.r)): r.n for r in rows[:pairs]}, bound)
            changes: dict[int, list[tuple[str, int]]] = {}
        else:
            # Pairs that never reach the bound stay with the workers.
            floor = max(least, -counts.bound[0] if counts.bound else least)
            peak = F.sum(F.when(F.col("n") > 0, F.col("n"))).over(Window.partitionBy("l", "r"))
            rows = sums.withColumn("peak", peak).where(F.col("peak") >= floor).drop("peak").toArrow()
            start, changes = {}, {}
            for l, r, step, n in zip(*(rows[c].to_pylist() for c in ("l", "r", "step", "n"))):
                if step == 0:
                    start[chr(l) + chr(r)] = n
                else:
                    changes.setdefault(step, []).append((chr(l) + chr(r), n))
            counts = Counts({p: n for p, n in start.items() if p not in merged}, counts.bound)
        taken = []
        right = 0
        while len(out) + len(taken) < num_merges and (pair := counts.best(least)) is not None:
            taken.append((pair, FIRST_MERGE + len(out) + len(taken)))
            last = counts.counts.pop(pair)
            if right == len(trying) or trying[right][0] != pair:
                break
            right += 1
            for p, n in changes.get(right, ()):
                if n > 0 or p in counts.counts:
                    counts.add(p, n)
        length = min(tried, max(16, 2 * right + 8))
        out += taken
        if len(out) == num_merges:
            break
        if not taken:
            if counts.bound is None:
                break
            counts = None
    remove(spark, state._lexmill_path)
    return [(ids(p), new) for p, new in out]
