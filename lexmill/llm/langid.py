"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of its labelled text is built. A text is
parsed, left to right, into the longest phrases that occur in that sample; per character and times
the logarithm of the sample's length, the number of phrases estimates the cross-entropy (Ziv and
Merhav). The language that needs the fewest normalised phrases wins.

Case is folded, and runs of other characters than letters count as one space. Every letter of the
samples has a code of its own. An automaton's edges lie in one sparse table, so its size grows with
the sample and not with the alphabet.

Whole texts are parsed. So that many texts' parts advance together, a character a step, texts are
first cut into blocks of BLOCK characters and each block is parsed as if a phrase began there. Then
each block is parsed again from where the block before it really ended, until a phrase begins where
one began the first time: from there on both are the same. The result is the parse of the whole text.
"""

from __future__ import annotations

import hashlib
import math
import sys
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import prepare
from .tokens import kept, slices

BLOCK = 1024
UNKNOWN, GAP = 0, 1
LOW = (1 << 32) - 1
SCHEMA = "doc_id long, lang_pred string, score double"


class Automaton:
    """Suffix automaton of a sequence of small integers; state 0 accepts the empty string."""

    def __init__(self, codes):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in codes:
            cur = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    twin = self._state(self.length[p] + 1, dict(self.next[q]))
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1


@cache
def folded() -> np.ndarray:
    """For each code point that is a letter, that of its lower case where this is one character, else its own; 0 for the others."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.int32)
    for i in range(sys.maxunicode + 1):
        if (c := chr(i)).isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def sparse(edges: list[dict[int, int]], width: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Every state's place in a table, all different, and the table: at a state's place plus a code, the state's place (high) and the next state's (low).

    Codes are below width. States are put where their edges meet no other's, those with the most edges first, the rest by the round.
    """
    rng = np.random.default_rng(seed)
    degree = np.array([len(e) for e in edges])
    code = np.fromiter((c for e in edges for c in e), np.int64, int(degree.sum()))
    to = np.fromiter((t for e in edges for t in e.values()), np.int64, len(code))
    first = np.cumsum(degree) - degree
    room = 2 * max(len(code), len(edges)) + 64
    place, used, taken = np.full(len(edges), -1, np.int64), np.zeros(room, bool), np.zeros(room + width, bool)
    order = np.argsort(-degree, kind="stable")
    many = int((degree > 8).sum())
    for s in order[:many].tolist():
        own = code[first[s] : first[s] + degree[s]]
        while True:
            at = rng.integers(0, room, 32)
            at = at[~used[at] & ~taken[at[:, None] + own].any(axis=1)]
            if len(at):
                break
        place[s], used[at[0]], taken[at[0] + own] = at[0], True, True
    wait = order[many:]
    while len(wait):
        at = rng.integers(0, room, len(wait))
        n = degree[wait]
        edge = np.repeat(first[wait] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cell = np.repeat(at, n) + code[edge]
        alone = np.zeros(len(cell), bool)
        alone[np.unique(cell, return_index=True)[1]] = True
        bad = np.bincount(np.repeat(np.arange(len(wait)), n), taken[cell] | ~alone, len(wait)) > 0
        single = np.zeros(len(wait), bool)
        single[np.unique(at, return_index=True)[1]] = True
        ok = ~bad & single & ~used[at]
        place[wait[ok]], used[at[ok]] = at[ok], True
        taken[cell[np.repeat(ok, n)]] = True
        wait = wait[~ok]
    table = np.full(room + width, -1, dtype=np.int64)
    owner = np.repeat(place, degree)
    table[owner + code] = (owner << 32) | place[to]
    return place, table


class Parser:
    """samples: for each language, pieces of its text."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        fold = folded()
        seen = [np.unique(fold[points(t)]) for own in samples.values() for t in own]
        letters = np.unique(np.concatenate([np.zeros(1, np.int32), *seen]))[1:]
        #: Code points of the letters known; a letter's code is its place here and 2 more.
        self.letters = letters
        self.width = len(letters) + 2
        self.tables, self.firsts, self.logs = [], [], []
        for lang in self.langs:
            # The ends of pieces have the code of unknown letters, which nothing is matched with.
            joined = np.concatenate([np.append(self.of(t), UNKNOWN) for t in samples[lang]])
            edges = [{c: to for c, to in e.items() if c != UNKNOWN} for e in Automaton(joined.tolist()).next]
            # One state more than the automaton's: after a character that the sample lacks, which is a phrase alone.
            place, table = sparse([*edges, {}], self.width)
            first = np.full(self.width, place[-1])
            for c, to in edges[0].items():
                first[c] = place[to]
            self.tables.append(table)
            self.firsts.append(first)
            self.logs.append(math.log2(max(2, len(joined))))

    @property
    def size(self) -> int:
        """Bytes."""
        return sum(x.nbytes for x in (self.letters, *self.tables, *self.firsts))

    def of(self, text: str) -> np.ndarray:
        """Codes of a text, runs of gaps as one; none for a gap at the start."""
        own = folded()[points(text)]
        if not len(own):
            return np.zeros(0, np.int32)
        at = np.searchsorted(self.letters, own)
        known = np.append(self.letters, -1)[at] == own
        gap = own == 0
        codes = np.where(gap, GAP, np.where(known, at + 2, UNKNOWN)).astype(np.int32)
        return codes[~(gap & np.concatenate(([True], gap[:-1])))]

    def phrases(self, k: int, steps: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How many phrases of language k begin in each block.

        steps: codes, a row a step and a column a block, the longest first; sizes of blocks; before: the block before each in its text, or -1.
        """
        table, first = self.tables[k], self.firsts[k]
        state = first.take(steps[0])
        begins = np.zeros(steps.shape, dtype=bool)
        begins[0] = True
        active = np.searchsorted(-sizes, -np.arange(len(steps)), side="left").tolist()
        for t in range(1, len(steps)):
            a = active[t]
            own, code = state[:a], steps[t, :a]
            entry = table.take(own + code)
            new = np.not_equal(entry >> 32, own, out=begins[t, :a])
            entry &= LOW
            own[:] = np.where(new, first.take(code), entry)
        total = begins.sum(axis=0, dtype=np.int64)
        # What a block counts and where it ends if it is parsed as the text's part.
        count, end = total.copy(), state.copy()
        after = np.full(len(sizes), -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        todo = np.flatnonzero(before >= 0)
        while len(todo):
            lane, own = todo, end[before[todo]]
            got, passed = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
            changed = []
            for t in range(len(steps)):
                done = sizes[lane] == t
                if done.any():
                    changed.append(lane[done][end[lane[done]] != own[done]])
                    count[lane[done]], end[lane[done]] = got[done], own[done]
                    lane, own, got, passed = (x[~done] for x in (lane, own, got, passed))
                if not len(lane):
                    break
                code, old = steps[t, lane], begins[t, lane]
                entry = table.take(own + code)
                new = entry >> 32 != own
                if (same := new & old).any():
                    which = lane[same]
                    changed.append(which[end[which] != state[which]])
                    count[which], end[which] = got[same] + total[which] - passed[same], state[which]
                    rest = ~same
                    lane, got, passed, code, entry, new, old = (x[rest] for x in (lane, got, passed, code, entry, new, old))
                own = np.where(new, first.take(code), entry & LOW)
                got += new
                passed += old
            else:
                changed.append(lane[end[lane] != own])
                count[lane], end[lane] = got, own
            todo = after[np.concatenate(changed)] if changed else todo[:0]
            todo = np.unique(todo[todo >= 0])
        return count

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text, bits a character by language; whether it has a letter."""
        codes = [self.of(t) if t else np.zeros(0, np.int32) for t in texts]
        lettered = np.array([bool((c != GAP).any()) for c in codes], dtype=bool)
        sizes = np.array([len(c) for c in codes], dtype=np.int64)
        parts = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(codes)), parts)
        total = np.zeros((len(self.langs), len(codes)))
        if len(owner):
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            lengths = np.minimum(BLOCK, sizes[owner] - nth * BLOCK)
            starts = np.cumsum(lengths) - lengths
            order = np.argsort(-lengths, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            before = np.where(nth > 0, np.concatenate(([-1], rank[:-1])), -1)[order]
            flat = np.concatenate((*codes, np.zeros(BLOCK, np.int32)))
            steps = np.lib.stride_tricks.sliding_window_view(flat, BLOCK)[starts[order], : int(lengths.max())].T.astype(np.int64, order="C")
            for k in range(len(self.langs)):
                total[k] = np.bincount(owner[order], weights=self.phrases(k, steps, lengths[order], before), minlength=len(codes)) * self.logs[k]
        return total / np.maximum(sizes, 1), lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        bits, lettered = self.entropies(texts)
        best = bits.argmin(axis=0)
        ranked = np.sort(bits, axis=0)
        score = 1 - ranked[0] / np.maximum(ranked[1], 1e-9) if len(self.langs) > 1 else np.ones(len(texts))
        return [self.langs[b] if ok else "und" for b, ok in zip(best, lettered)], [float(s) if ok else 0.0 for s, ok in zip(score, lettered)]


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = 20_000, all_chars: int = 1_000_000, piece_chars: int = 2_000, most_langs: int = 1_000) -> dict[str, list[str]]:
    """A sample of each language's labelled text, the same whatever the partitions.

    Bound: sample_chars characters a language (less if there are so many languages that all of them
    would pass all_chars), in pieces of at most piece_chars a document, each cut at a place that a hash tells.
    Documents are taken by the hash of their id and text, however often one is repeated; the driver gathers a few times the bound. Of more than most_langs
    different languages the most frequent are learned, ties by name. Rows that train refuses or of null id,
    language or text count for nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), train.alias("ok"))
    rows = rows.where("ok and doc_id is not null and lang is not null and lang <> 'und' and text <> ''")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    if not counts:
        return {}
    chars = max(1, min(sample_chars, all_chars // len(counts)))
    least = 3 * -(-chars // piece_chars) + 20
    # Documents may be shorter than a piece, so several times as many are taken as pieces would fill the bound.
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    start = F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.greatest(F.length("text") - piece_chars, F.lit(0)) + 1)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "text"))

    def taken(shares: dict[str, float]):
        near = rows.join(F.broadcast(docs.sparkSession.createDataFrame(list(shares.items()), "own_lang string, share double")), F.col("lang") == F.col("own_lang"))
        near = near.where(place < F.col("share") * (1 << 30)).select("lang", place.alias("place"), "doc_id", F.col("text").substr((start + 1).cast("int"), F.lit(piece_chars)).alias("text"))
        return near.withColumn("rank", rank).where(F.col("rank") <= 4 * least).collect()

    got = taken({lang: min(1.0, 2.0 * least / n) for lang, n in counts.items()})
    # A language of few different rows may have none of them among those.
    if missing := counts.keys() - {r.lang for r in got}:
        got += taken(dict.fromkeys(sorted(missing), 1.0))
    out: dict[str, list[str]] = {}
    left = dict.fromkeys(counts, chars)
    for r in sorted(got, key=lambda r: (r.lang, r["rank"])):
        if left[r.lang] > 0:
            out.setdefault(r.lang, []).append(r.text[: left[r.lang]])
            left[r.lang] -= len(r.text)
    return out


def shared(docs: DataFrame, samples: dict[str, list[str]]):
    """The parser of samples, built once at the driver and sent to the workers; its size is bounded as that of the samples is."""
    prepare(docs.sparkSession)
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast(kept(("parser", key), lambda: Parser(samples)))


def predict(docs: DataFrame, samples: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score in 0 to 1 (by how much the best language's entropy is below the next one's).

    Null text, or text without a letter: und, 0. Ties go to the first language by name. Letters that
    no sample has are a phrase each. Without any labelled text all are und. Repeated
    and null ids are rows like any other; an empty table gives none; other columns are ignored.
    """
    known = shared(docs, samples)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, rows=4096, text="text", most=2_000_000):
                lang, score = known.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def accept(docs: DataFrame, samples: dict[str, list[str]], langs: frozenset[str] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is known, and one of langs if given; und (see predict) goes."""
    known = shared(docs, samples)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, rows=4096, text=text_col, most=2_000_000):
                lang, _ = known.value.predict(part.column(text_col).to_pylist())
                yield part.filter(pa.array([x != "und" and (langs is None or x in langs) for x in lang], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
