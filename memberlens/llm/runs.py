"""Periodic runs of words, found with a suffix automaton and link-cut access.

The suffix automaton of a text has a link tree whose root paths are the suffixes of its prefixes. When a
word is appended, the path of the new prefix is accessed: it falls into segments that end at the same
earlier occurrence, and all of it takes the new end as its colour. A segment of colour c whose longest
string has L words tells that the last L words also end at c; with d the distance of the two ends and L at
least d, a square of period d ends here, which lies in a run of L + d words. The access keeps the
link tree on its heavy paths: each holds its colour segments on a stack, whose top an access replaces.

Words that no run can hold are left out beforehand: every word of a run lies in SEED consecutive words
that come again, within the stretch of such words, at a distance of a quarter of the stretch at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.llm.common import arrow_batches, shipped, without
from memberlens.llm.wordhash import Words, grams

shipped(__name__)

LEAST = 6  # words of a run at least
PERIODS = 4  # periods of a run at least
SEED = 5  # consecutive words that every run of LEAST words and PERIODS periods must repeat
ROUNDS = 4  # times the stretches are narrowed

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links and longest lengths of the states, and the state of every prefix."""
    following: list[dict[int, int]] = [{}]
    link, length, ends = [-1], [0], []
    last = 0
    for w in words:
        new = len(link)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in following[p]:
            following[p][w] = new
            p = link[p]
        if p >= 0:
            q = following[p][w]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(link)
                following.append(following[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(w) == q:
                    following[p][w] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
        ends.append(new)
    return link, length, ends


def heavy_paths(link: list[int], length: list[int]) -> tuple[list[int], list[int]]:
    """Topmost state of every state's heavy path, and the state above that one."""
    n = len(link)
    order = sorted(range(1, n), key=length.__getitem__)
    size, heavy = [1] * n, [-1] * n
    for v in reversed(order):
        size[link[v]] += size[v]
    for v in order:
        p = link[v]
        if heavy[p] < 0 or size[v] > size[heavy[p]]:
            heavy[p] = v
    top, above = [0] * n, [-1] * n
    for v in order:
        p = link[v]
        if heavy[p] == v:
            top[v] = top[p]
        else:
            top[v] = v
            above[v] = p
    return top, above


def runs_of(words: list[int], least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of one sequence, by start and period."""
    n = len(words)
    if n < least:
        return []
    link, length, ends = automaton(words)
    top, above = heavy_paths(link, length)
    # per heavy path: colour segments as (length of the longest string, colour), the topmost last
    stacks: dict[int, list[tuple[int, int]]] = {}
    found = []
    for i, state in enumerate(ends):
        v = state
        while v >= 0:
            t, reach = top[v], length[v]
            stack = stacks.get(t)
            if stack is None:
                stacks[t] = [(reach, i)]
            else:
                while stack:
                    longest, c = stack[-1]
                    part = longest if longest < reach else reach
                    d = i - c
                    # the string of `part` words that ends at i ends at c as well: the words from there on have period d
                    if part >= (periods - 1) * d and part + d >= least and (i + 1 == n or words[i + 1] != words[i + 1 - d]):
                        s = i - d - part
                        if s < 0 or words[s] != words[s + d]:
                            found.append((s + 1, part + d, d))
                    if longest > reach:
                        break
                    stack.pop()
                    if longest == reach:
                        break
                stack.append((reach, i))
            v = above[t]
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray, texts: np.ndarray, periods: int, seed: int) -> list[tuple[int, int]]:
    """Stretches (first word, word after the last) outside which there is no run of at least `seed` + 1 words."""
    n = len(hashes) - seed + 1
    if n <= 0:
        return []
    at = np.flatnonzero(texts[:n] == texts[seed - 1:])
    key = grams(hashes, seed)[at] ^ (texts[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    limit = np.full(len(hashes), len(hashes), np.int64)  # longest period that a run at a word can have
    bounds: list[tuple[int, int]] = []
    for _ in range(ROUNDS):
        order = np.argsort(key, kind="stable")
        k, p = key[order], at[order]
        near = (k[1:] == k[:-1]) & (p[1:] - p[:-1] <= limit[p[1:]]) & (texts[p[1:]] == texts[p[:-1]])
        again = np.zeros(len(p), bool)
        again[1:] |= near
        again[:-1] |= near
        marked = np.sort(p[again])
        edges = np.zeros(len(hashes) + 1, np.int32)
        np.add.at(edges, marked, 1)
        np.add.at(edges, marked + seed, -1)
        inside = np.cumsum(edges[:-1]) > 0
        cut = np.concatenate([[False], (texts[1:] != texts[:-1]) & inside[1:] & inside[:-1], [False]])  # a stretch ends with its text
        change = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
        first = np.flatnonzero((change == 1) | cut)
        after = np.flatnonzero((change == -1) | cut)
        size = after - first
        limit[:] = 0
        limit[inside] = np.repeat(size // periods, size)
        old, bounds = bounds, list(zip(first.tolist(), after.tolist(), strict=True))
        keep = limit[at] > 0
        at, key = at[keep], key[keep]
        if bounds == old or not bounds:
            break
    return bounds


def runs_of_texts(words: Words, least: int = LEAST, periods: int = PERIODS) -> list[list[tuple[int, int, int]]]:
    """The runs of each text of a batch."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words.counts]
    texts = words.texts_of()
    # of a run of period q, all words but q come again q words on: so many at least
    seed = min(SEED, least - least // periods, (periods - 1) * (least // periods + 1))
    for first, after in stretches(words.lanes[0], texts, periods, seed):
        if after - first < least:
            continue
        # words by number, told apart by the words themselves
        numbers: dict[bytes, int] = {}
        span = words.buffer[words.starts[first]:words.ends[after - 1]].split(b" ")
        text = int(texts[first])
        shift = first - int(words.firsts[text])
        out[text] += [(s + shift, size, period) for s, size, period in runs_of([numbers.setdefault(w, len(numbers)) for w in span], least, periods)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray | None:
    """Which of n words stay: of each run the first period; None if all do."""
    if not runs:
        return None
    edges = np.zeros(n + 1, np.int32)
    for start, size, period in runs:
        edges[start + period] += 1
        edges[start + size] -= 1
    return np.cumsum(edges[:n]) == 0


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """The columns `keep` (default: all) of `docs` plus n_words, runs (start, length, period) and collapsed_text.

    A run is a stretch of at least max(least, periods * period) words of smallest period `period` that cannot be extended; in
    collapsed_text only the first period of each run stays, with one space between words. Null and empty texts have no words
    and no runs, and collapse to the empty text. Each row is read whole and on its own, so ties, repeated rows and
    hot keys do not matter; memory is proportional to the longest text. Input columns named like an added one are replaced.
    """
    if periods < 3 or least < 3:
        raise ValueError("runs have three periods and three words at least")
    arrow_batches(docs.sparkSession)
    keep = tuple(docs.columns) if keep is None else tuple(keep)
    source = without(docs.select(*keep), "n_words", "runs", "collapsed_text")
    names = source.columns
    rows = docs.select(F.struct(*names).alias("_row"), F.col(text).cast("string").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            words = Words(b.column("_text").to_pylist(), lanes=1)
            found = runs_of_texts(words, least, periods)
            texts = [words.joined(i, collapsed_words(int(words.counts[i]), r)) for i, r in enumerate(found)]
            flat = np.array([x for r in found for x in r], np.int64).reshape(-1, 3)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(words.counts), pa.ListArray.from_arrays(pa.array(offsets), values).cast(kind), pa.array(texts, pa.binary())],
                                             ["_row", "n_words", "runs", "collapsed_text"])

    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed_text binary"
    return rows.mapInArrow(run, schema).select("_row.*", "n_words", "runs", F.col("collapsed_text").cast("string").alias("collapsed_text"))
