"""Hashes of words and of runs of words, computed for whole batches of texts at once.

A word's hash is a polynomial over random numbers that stand for its bytes; prefix sums over a
block of text give every word's value without a loop over words. There are two independent
64-bit lanes, so equal pairs may stand for equal words.
"""

from __future__ import annotations

import numpy as np

from memberlens.llm.common import shipped, worker_cache

shipped(__name__)

BLOCK = 1 << 18  # bytes hashed with one table of powers; a longer word gets a table of its own
# fixed values: odd multipliers of the two lanes and of the final mixing
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
GRAM_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
MIX = 0xBF58476D1CE4E5B9


def _powers(lane: int, n: int) -> np.ndarray:
    """The lane's base to the powers 0 to n."""
    out = np.full(n + 1, BASES[lane], dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1), [_powers(lane, BLOCK) for lane in range(2)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
    x ^= x >> np.uint64(29)
    x *= np.uint64(BASES[1])
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of some texts in a row: their bytes, hashes and the text each belongs to."""

    def __init__(self, texts: list[bytes | None], lanes: int = 2):
        split = [(t or b"").split() for t in texts]
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])  # text i has the words firsts[i] to firsts[i + 1]
        self.buffer = b" ".join([b" ".join(words) for words in split if words])
        self.n = int(self.firsts[-1])
        data = np.frombuffer(self.buffer, np.uint8)
        spaces = np.flatnonzero(data == 32)
        self.starts = np.concatenate([[0], spaces + 1])[:self.n]
        self.ends = np.concatenate([spaces, [len(data)]])[:self.n]
        self.lanes = self._hashes(data, lanes)

    def _hashes(self, data: np.ndarray, lanes: int) -> np.ndarray:
        codes, powers = worker_cache("word-hash", _tables)
        out, at = np.empty((lanes, self.n), np.uint64), 0
        while at < self.n:
            lo = int(self.starts[at])
            to = max(int(np.searchsorted(self.ends, lo + BLOCK, "right")), at + 1)
            block = data[lo:self.ends[to - 1]]
            s, e = self.starts[at:to] - lo, self.ends[at:to] - lo
            for lane in range(lanes):
                p = powers[lane] if len(block) <= BLOCK else _powers(lane, len(block))
                sums = np.zeros(len(block) + 1, np.uint64)
                np.cumsum(codes[lane][block] * p[:len(block)], out=sums[1:])
                out[lane, at:to] = mixed((sums[e] - sums[s]) * powers[lane][BLOCK - s])
            at = to
        return out

    def texts_of(self) -> np.ndarray:
        """Number of the text of every word."""
        return np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)

    def joined(self, text: int, kept: np.ndarray | None = None) -> bytes:
        """A text's words (those marked in `kept`) with one space between them."""
        lo, hi = int(self.firsts[text]), int(self.firsts[text + 1])
        if lo == hi:
            return b""
        if kept is None or kept.all():
            return self.buffer[self.starts[lo]:self.ends[hi - 1]]
        # stretches of kept words are cut out whole
        edges = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]]).astype(np.int8)))
        return b" ".join([self.buffer[self.starts[lo + a]:self.ends[lo + b - 1]] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])


def grams(hashes: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """Hash of each `size` consecutive words; empty if there are fewer."""
    if len(hashes) < size:
        return hashes[:0]
    n = len(hashes) - size + 1
    out, used, part, width, power = None, 0, hashes, 1, np.array([GRAM_BASES[lane]], np.uint64)
    while True:
        if size & width:
            tail = part[used:used + n]
            out = tail.copy() if out is None else out * power + tail
            used += width
        if width << 1 > size:
            return mixed(out)
        part = part[:-width] * power + part[width:]
        power = power * power
        width <<= 1
