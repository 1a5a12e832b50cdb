"""Learning merges from word counts.

Counting is Spark's work and grows with the corpus; the rest depends on the distinct words alone. Up
to KERNEL_WORDS and KERNEL_BYTES of them one process learns the merges; beyond that shards of words learn together, many merges a
round (shards.learn_sharded). learn_relational is the rule as plain joins and sums, a few merges a step: what the others are held against.

counting="compat", the default, is the rule whose vocabularies this library reproduces: a merge adds
the pairs with the new token (a pair of two new ones twice) and takes every other pair of each visited
word away, whether the merge broke it or not; a pair that has fallen to nothing never returns; a pair's
words are those that had it when it came up. counting="exact" keeps true counts, the textbook's rule.
"""

from __future__ import annotations

import heapq
from array import array
from collections import defaultdict
from collections.abc import Iterable
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pretokens import pair_counts, pairs, postings, word_counts
from ..runtime import remove, temporary, written
from .vocab import FIRST_MERGE, Vocabulary

#: Distinct words that one process learns from, and bytes of them, at most: a process takes some 40 bytes of memory for each of theirs.
KERNEL_WORDS, KERNEL_BYTES = 1_000_000, 10 << 20
MAX_SIZE = 300_001
COUNTINGS = ("compat", "exact")

Pair = tuple[int, int]


def places() -> array:
    return array("i")


class Learner:
    """Pair counts over a table of words that one merge after another changes.

    A word is a string with one character a token, a pair a string of two: replacing is the string's own
    method, and strings compare as pairs of ids do. Postings are arrays that may name a word twice.
    """

    def __init__(self, words: Iterable[tuple[bytes, int]], counting: str = "compat"):
        if counting not in COUNTINGS:
            raise ValueError("counting is compat or exact")
        self.exact = counting == "exact"
        self.tokens: list[str] = []
        self.freq: list[int] = []
        self.count: dict[str, int] = defaultdict(int)
        self.words: dict[str, array] = defaultdict(places)
        for k, (word, freq) in enumerate(words):
            own = word.decode("latin-1")
            self.tokens.append(own)
            self.freq.append(freq)
            for i in range(len(own) - 1):
                self.count[own[i : i + 2]] += freq
                self.words[own[i : i + 2]].append(k)
        self.queue = [(-n, pair) for pair, n in self.count.items()]
        heapq.heapify(self.queue)

    def best(self, least: int) -> str | None:
        """The live pair of the highest count, ties to the smallest. Queue entries may be out of date; counts only fall after a pair's creation."""
        while self.queue:
            n, pair = self.queue[0]
            now = self.count.get(pair, 0)
            if -n == now and now >= least:
                return pair
            heapq.heappop(self.queue)
            if now >= least and -n != now:
                heapq.heappush(self.queue, (-now, pair))
        return None

    def visit(self, pair: str, new: int) -> tuple[dict[str, int], dict[str, int]]:
        """Merge in the pair's words; how much the pairs with the new token come to, and how much others lose."""
        visited = set(self.words.pop(pair, ()))
        grown: dict[str, int] = defaultdict(int)
        less: dict[str, int] = defaultdict(int)
        glyph = chr(new)
        if self.exact:
            return self._visit_exact(visited, pair, glyph)
        for w in visited:
            old, f = self.tokens[w], self.freq[w]
            now = old.replace(pair, glyph)
            i = now.find(glyph) if now != old else -1
            while i >= 0:
                if i:
                    grown[now[i - 1 : i + 1]] += f
                    self.words[now[i - 1 : i + 1]].append(w)
                if i + 1 < len(now):
                    grown[now[i : i + 2]] += f
                    self.words[now[i : i + 2]].append(w)
                i = now.find(glyph, i + 1)
            for i in range(len(old) - 1):
                less[old[i : i + 2]] += f
            self.tokens[w] = now
        return grown, {p: n for p, n in less.items() if n}

    def _visit_exact(self, visited: Iterable[int], pair: str, glyph: str) -> tuple[dict[str, int], dict[str, int]]:
        """visit for true counts: only the neighbours of what is merged change, the rest of a word is not looked at."""
        grown: dict[str, int] = defaultdict(int)
        less: dict[str, int] = defaultdict(int)
        left, right = pair
        for w in visited:
            parts = self.tokens[w].split(pair)
            if len(parts) == 1:
                continue
            f = self.freq[w]
            less[pair] += f * (len(parts) - 1)
            for k, part in enumerate(parts):
                if part:
                    if k:
                        less[right + part[0]] += f
                        grown[p := glyph + part[0]] += f
                        self.words[p].append(w)
                    if k < len(parts) - 1:
                        less[part[-1] + left] += f
                        grown[p := part[-1] + glyph] += f
                        self.words[p].append(w)
                elif 0 < k < len(parts) - 1:
                    less[right + left] += f
                    grown[p := glyph + glyph] += f
                    self.words[p].append(w)
            self.tokens[w] = glyph.join(parts)
        return grown, less

    def merge(self, pair: str, new: int) -> None:
        self.count.pop(pair, None)
        grown, less = self.visit(pair, new)
        # What grows has the new token and what shrinks has not; a pair that falls to nothing is dead.
        for p, n in less.items():
            if p in self.count:
                if self.count[p] > n:
                    self.count[p] -= n
                else:
                    del self.count[p]
        for p, n in grown.items():
            self.count[p] = n
            heapq.heappush(self.queue, (-n, p))


def learn(words: Iterable[tuple[bytes, int]], num_merges: int, min_frequency: int = 2, counting: str = "compat", first: int = FIRST_MERGE, known: Iterable[tuple[Pair, int]] = ()) -> list[tuple[Pair, int]]:
    """Up to num_merges rules from (bytes of a word, frequency); independent of the order of words.

    known: rules learned before, which come first and count; over the same words the rest is what learning all at once gives.
    """
    learner, out = Learner(words, counting), []
    for pair, new in list(known)[:num_merges]:
        out.append((pair, new))
        learner.merge(chr(pair[0]) + chr(pair[1]), new)
    while len(out) < num_merges and (pair := learner.best(min_frequency)) is not None:
        new = first + len(out)
        out.append(((ord(pair[0]), ord(pair[1])), new))
        learner.merge(pair, new)
    return out


def learn_relational(words: DataFrame, num_merges: int, min_frequency: int = 2, counting: str = "compat", known: Iterable[tuple[Pair, int]] = (), batch: int = 64, compact: int = 32) -> list[tuple[Pair, int]]:
    """Either rule as relational steps over words (freq, toks); the driver holds batch pairs a step.

    A step takes several merges where that gives what one after the other would: the best pairs of all, as many
    as no word has two of, up to the first that a pair made by an earlier one would have come before. It reads
    the words those pairs name and writes what changes, words, counts and postings, as frames beside the
    older ones; every compact steps these become one. Plans don't grow with steps, and lost executors cost one step.
    """
    spark = words.sparkSession
    if counting not in COUNTINGS:
        raise ValueError("counting is compat or exact")
    # Numbers that a written frame keeps tell words apart.
    words = written(words.select(F.monotonically_increasing_id().alias("word_id"), "freq", "toks", F.lit(0).alias("step")), "words")
    texts, counts = [words], [written(pair_counts(words), "pairs")]
    posts = [written(postings(words).sortWithinPartitions("l", "r"), "postings")]
    out: list[tuple[Pair, int]] = []
    forced = list(known)[:num_merges]
    for step in count(1):
        if len(out) == num_merges:
            break
        if len(out) < len(forced):
            best = [(forced[len(out)][0], 0)]
        else:
            live = _all(counts).groupBy("l", "r").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1, min_frequency))
            best = [((r.l, r.r), r.n) for r in live.orderBy(F.desc("n"), "l", "r").limit(min(batch, num_merges - len(out))).collect()]
        if not best:
            break
        first = FIRST_MERGE + len(out) if len(out) >= len(forced) else forced[len(out)][1]
        chosen = spark.createDataFrame([(k, *pair, first + k) for k, (pair, _) in enumerate(best)], "k int, own_l int, own_r int, new int")
        named = _all(posts).join(F.broadcast(chosen), (F.col("l") == F.col("own_l")) & (F.col("r") == F.col("own_r"))).select("word_id", "k", "own_l", "own_r", "new")
        named = written(named, "named")
        # The second of two pairs that name one word must wait for the first.
        second = named.groupBy("word_id").agg(F.sort_array(F.collect_set("k")).alias("all")).where(F.size("all") > 1).agg(F.min(F.col("all")[1])).first()[0]
        many = len(best) if second is None else second
        touched = named.where(F.col("k") < many)
        state = written(_merged_words(_all(texts), touched), "visited")
        sides = (F.col("p.l") == F.col("new")).cast("long") + (F.col("p.r") == F.col("new")).cast("long")
        come = state.select("k", "word_id", "freq", F.explode(pairs("now")).alias("p"), "new").withColumn("sides", sides)
        grown = come.where("sides > 0").groupBy("k", F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum(F.col("freq") * (F.col("sides") if counting == "compat" else F.lit(1))).alias("n"))
        grown = written(grown, "grown")
        if many > 1:
            made = {r.k: (r.top.n, r.top.l, r.top.r) for r in grown.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("n"), "l", "r")).alias("top")).collect()}
            best_made = None
            for k in range(many):
                (left, right), n = best[k]
                if best_made is not None and best_made[0] <= -min_frequency and best_made < (-n, left, right):
                    many = k
                    break
                if k in made and (best_made is None or made[k] < best_made):
                    best_made = made[k]
        out += [(pair, first + k) for k, (pair, _) in enumerate(best[:many])]
        spent = [named, state, grown]
        state, come, grown = (frame.where(F.col("k") < many) for frame in (state, come, grown))
        lost = state.select("freq", F.explode(pairs("toks")).alias("p"))
        if counting == "exact":
            # Pairs that a merge left as they were count again.
            lost = lost.unionByName(come.where("sides = 0").select((-F.col("freq")).alias("freq"), "p"))
        lost = lost.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg((-F.sum("freq")).alias("n"))
        over = chosen.where(F.col("k") < many).select(F.col("own_l").alias("l"), F.col("own_r").alias("r"), F.lit(GONE).alias("n"))
        texts.append(written(state.select("word_id", "freq", F.col("now").alias("toks"), F.lit(step).alias("step")), "words"))
        counts.append(written(grown.select("l", "r", "n").unionByName(lost).unionByName(over), "pairs"))
        posts.append(written(come.where("sides > 0").select(F.col("p.l").alias("l"), F.col("p.r").alias("r"), "word_id").distinct().sortWithinPartitions("l", "r"), "postings"))
        if step % compact == 0:
            spent += texts + counts + posts
            texts = [written(_all(texts).groupBy("word_id").agg(F.first("freq").alias("freq"), F.max_by("toks", "step").alias("toks"), F.max("step").alias("step")), "words")]
            # A pair that has fallen to nothing never comes back.
            counts = [written(_all(counts).groupBy("l", "r").agg(F.sum("n").alias("n")).where("n > 0"), "pairs")]
            posts = [written(_all(posts).join(counts[0].select("l", "r"), ["l", "r"], "left_semi").sortWithinPartitions("l", "r"), "postings")]
        for frame in spent:
            remove(spark, frame._lexmill_path)
    return out


#: Less than any count: what is added to the count of a pair that has been merged.
GONE = -(1 << 60)


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _merged_words(texts: DataFrame, touched: DataFrame) -> DataFrame:
    """k, word_id, freq, toks, now and new of the touched words (word_id, k, own_l, own_r, new), in their last state and merged."""
    own = texts.join(touched, "word_id").groupBy("word_id", "k", "own_l", "own_r", "new").agg(F.first("freq").alias("freq"), F.max_by("toks", "step").alias("toks"))
    # A fold from the left merges without overlap.
    last = lambda done: F.get(done, F.size(done) - 1)
    joined = F.aggregate(
        "toks",
        F.array().cast("array<int>"),
        lambda done, t: F.when((F.size(done) > 0) & (last(done) == F.col("own_l")) & (t == F.col("own_r")), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.col("new")))).otherwise(F.concat(done, F.array(t))),
    )
    return own.select("k", "word_id", "freq", "toks", joined.alias("now"), "new")


def train(docs: DataFrame, vocab_size: int = 300_000, min_frequency: int = 2, text_col: str = "text", counting: str = "compat", kernel_words: int = KERNEL_WORDS, resume: Vocabulary | None = None) -> Vocabulary:
    """A vocabulary from all texts of docs: 256 bytes and up to vocab_size - 256 merges, those of resume first.

    Up to kernel_words distinct words, and KERNEL_BYTES of them, one process learns; beyond that the same rules come from shards.
    Null texts have no words; an empty corpus gives the 256 bytes. vocab_size may not pass 300,001,
    where ids would meet those of special tokens; min_frequency must be 1 at least.
    """
    _check(vocab_size, min_frequency, counting)
    with temporary(docs.sparkSession):
        return train_counts(written(word_counts(docs, text_col), "word-counts"), vocab_size, min_frequency, counting, kernel_words, resume)


def _check(vocab_size: int, min_frequency: int, counting: str) -> None:
    if min_frequency < 1:
        raise ValueError("min_frequency must be positive")
    if vocab_size > MAX_SIZE:
        raise ValueError(f"vocab_size may not pass {MAX_SIZE}")
    if counting not in COUNTINGS:
        raise ValueError("counting is compat or exact")


def train_counts(counts: DataFrame, vocab_size: int = 300_000, min_frequency: int = 2, counting: str = "compat", kernel_words: int = KERNEL_WORDS, resume: Vocabulary | None = None) -> Vocabulary:
    """As train, from counts: pre_token and freq, each pre-token once; worked out once, as they are read several times."""
    _check(vocab_size, min_frequency, counting)
    with temporary(counts.sparkSession):
        if not hasattr(counts, "_lexmill_path"):
            counts = written(counts.select("pre_token", "freq"), "word-counts")
        merges = vocab_size - len(Vocabulary().token_bytes)
        known = resume.merges if resume else ()
        size = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("pre_token")), F.lit(0)).alias("bytes")).first()
        if size.n <= kernel_words and size.bytes <= KERNEL_BYTES:
            table = counts.toArrow()
            words = zip((w.encode() for w in table["pre_token"].to_pylist()), table["freq"].to_pylist())
            return Vocabulary.of_merges(learn(words, merges, min_frequency, counting, known=known))
        from .shards import learn_sharded

        return Vocabulary.of_merges(learn_sharded(counts, merges, min_frequency, counting, known))
