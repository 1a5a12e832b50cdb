"""Static range asymmetric numeral system over token ids, in numpy, with many interleaved lanes.

A lane is a 64-bit state in [2^31, 2^63); symbol k of a block belongs to lane k modulo the number of
lanes. All lanes share one table of frequencies that add up to 2^PRECISION and one stream of 32-bit
words, so a step codes one symbol in every lane at once.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

PRECISION = 20
LOW = 31
WORD = 32
MAX_LANES = 2048
U = np.uint64


class Table:
    """Frequencies of the symbols 0 to n-1, scaled to 2^PRECISION; a symbol that was counted keeps 1 at least."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        if int(self.freq.sum()) not in (0, 1 << PRECISION):
            raise ValueError("frequencies don't add up")
        ends = np.cumsum(self.freq)
        self.first = ends - self.freq
        self.symbols = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    @classmethod
    def of_counts(cls, counts: dict[int, int]) -> Table:
        if not counts:
            return cls(np.zeros(0))
        raw = np.zeros(max(counts) + 1)
        raw[list(counts)] = list(counts.values())
        if (raw > 0).sum() > 1 << PRECISION:
            raise ValueError("too many symbols for the precision")
        freq = np.where(raw > 0, np.maximum(1, np.floor(raw * ((1 << PRECISION) / raw.sum()))), 0).astype(np.int64)
        over = int(freq.sum()) - (1 << PRECISION)
        if over > 0:
            spare = np.maximum(freq - 1, 0)
            freq -= spare * over // int(spare.sum())
        order = np.argsort(-freq, kind="stable")
        rest = (1 << PRECISION) - int(freq.sum())
        if rest > 0:
            freq[order[0]] += rest
        while rest < 0:
            some = order[: -rest][freq[order[: -rest]] > 1]
            freq[some] -= 1
            rest += len(some)
        return cls(freq)

    def to_bytes(self) -> bytes:
        body = zlib.compress(self.freq.astype("<u4").tobytes())
        return struct.pack(">8sIII", b"LXTABLE1", len(self.freq), zlib.crc32(body), len(body)) + body + b"\n"

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        magic, n, crc, size = struct.unpack_from(">8sIII", data)
        body = data[20 : 20 + size]
        if magic != b"LXTABLE1" or zlib.crc32(body) != crc:
            raise ValueError("not a whole frequency table")
        freq = np.frombuffer(zlib.decompress(body), "<u4")
        if len(freq) != n:
            raise ValueError("not a whole frequency table")
        return cls(freq)


def encode(tokens: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """The lanes' states and the words; a decoder reads the words first to last."""
    n = len(tokens)
    lanes = min(MAX_LANES, max(1, n // 32))
    if n and (tokens.max() >= len(table.freq) or not table.freq[tokens].min()):
        raise ValueError("a symbol is not in the table")
    freq, first = table.freq[tokens], table.first[tokens]
    x = np.full(lanes, 1 << LOW, dtype=np.uint64)
    words = []
    for at in range((n - 1) // lanes * lanes, -1, -lanes) if n else ():
        f = freq[at : at + lanes]
        own = x[: len(f)]
        full = own >= f << U(LOW - PRECISION + WORD)
        if full.any():
            words.append(own[full].astype(np.uint32))
            own[full] >>= U(WORD)
        q = own // f
        own[:] = (q << U(PRECISION)) + (own - q * f) + first[at : at + lanes]
    return x, np.concatenate(words[::-1]) if words else np.zeros(0, dtype=np.uint32)


def decode(n: int, states: np.ndarray, words: np.ndarray, table: Table) -> np.ndarray:
    lanes = len(states)
    x = states.astype(np.uint64)
    out = np.empty(n, dtype=np.uint32)
    mask, at, words = U((1 << PRECISION) - 1), 0, words.astype(np.uint64)
    for i in range(0, n, lanes):
        own = x[: min(lanes, n - i)]
        slot = own & mask
        s = table.symbols[slot]
        out[i : i + lanes] = s
        own[:] = table.freq[s] * (own >> U(PRECISION)) + slot - table.first[s]
        low = own < U(1 << LOW)
        k = int(np.count_nonzero(low))
        if k:
            own[low] = own[low] << U(WORD) | words[at : at + k]
            at += k
    if at != len(words) or (x != U(1 << LOW)).any():
        raise ValueError("damaged block")
    return out
