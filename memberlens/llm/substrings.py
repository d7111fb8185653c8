"""Substring removal: word windows that start earlier in the corpus go, found with a count-min prefilter.

Every window of WINDOW words is represented by its anchor, the SEED consecutive words in it of
least hash: equal windows have equal anchors, so the count of an anchor is never below the count of a
window. Pass one counts anchors in partition sketches of fixed size, which are merged cell by cell. Pass two
sends the windows whose anchor is estimated to occur twice or more, and groups them exactly by a
128-bit hash of their words; of each group the earliest start stays. Neighbouring windows share
their anchor, so the sketch sees about a sixth of the windows, and what is told of a text stays together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memberlens.llm.common import arrow_batches, shipped, without
from memberlens.llm.wordhash import Words, grams

shipped(__name__)

WINDOW = 20
SEED = 10  # words of an anchor
ROWS = 2  # rows of the sketch
CELL_BITS = 27  # cells of a row, as a power of two: both rows are 32 MB as bitmaps, whatever the input
BLOCK_BITS = 16  # cells of a row are merged in blocks of this size, as a power of two
FLUSH = 1 << 20  # windows or anchors a task holds before it passes them on
RUN = 1 << 20  # consecutive starts told by one number, at most: the first times RUN, plus those that follow
PART_WINDOWS = 2_000_000  # windows grouped together in memory, at most about

_RESULT = "n_words long, n_removed long, kept_text binary, kept_sha256 string"


def anchors(words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the place of each one's anchor, and the hash of every place's `seed` words."""
    last = words.n - window + 1
    if last <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = grams(words.lanes[0], seed)
    best, place = h[:last].copy(), np.zeros(last, np.int16)
    for k in range(1, window - seed + 1):
        less = h[k:k + last] < best  # ties stay with the first place
        best[less] = h[k:k + last][less]
        place[less] = k
    inside = np.zeros(words.n + 1, np.int8)
    full = words.counts >= window
    np.add.at(inside, words.firsts[:-1][full], 1)
    np.add.at(inside, words.firsts[1:][full] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:last], dtype=np.int8))
    return starts, starts + place[starts], h


def cells(hashes: np.ndarray, row: int) -> np.ndarray:
    return (hashes >> np.uint64(row * 29)) & np.uint64((1 << CELL_BITS) - 1)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col(text).cast("string").cast("binary").alias("_text"))


def partition_sketches(docs: DataFrame, text: str, window: int, seed: int) -> DataFrame:
    """Cells that a task's anchors hit once, and more than once: per row and block, as 16-bit places in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flushed() -> pa.RecordBatch:
            hashes, out = np.concatenate(held), []
            held.clear()
            for row in range(ROWS):
                found, n = np.unique(cells(hashes, row), return_counts=True)
                blocks = (found >> np.uint64(BLOCK_BITS)).astype(np.int64)
                place, more = found.astype(np.uint16), n > 1
                used, at = np.unique(blocks, return_index=True)
                for b, lo, hi in zip(used.tolist(), at.tolist(), [*at[1:].tolist(), len(found)], strict=True):
                    m = more[lo:hi]
                    out.append((row, b, place[lo:hi][~m].tobytes(), place[lo:hi][m].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                                              ["row", "block", "once", "more"])

        for b in batches:
            words = Words(b.column("_text").to_pylist(), lanes=1)
            _, places, h = anchors(words, window, seed)
            if len(places):
                held.append(h[places[np.concatenate([[True], places[1:] != places[:-1]])]])
            if sum(map(len, held)) >= FLUSH:
                yield flushed()
        if held:
            yield flushed()

    return _texts(docs, text).mapInArrow(run, "row int, block int, once binary, more binary")


def merged_sketch(pieces: DataFrame) -> list[np.ndarray]:
    """One bitmap per row: the cells whose merged count is two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for row, block, once, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c = counts.get((row, block))
                if c is None:
                    c = counts[row, block] = np.zeros(1 << BLOCK_BITS, np.uint8)
                at = np.frombuffer(once, np.uint16)
                c[at] = np.minimum(c[at] + 1, 2)
                c[np.frombuffer(more, np.uint16)] = 2
        for (row, block), c in counts.items():
            if (c > 1).any():
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([np.packbits(c > 1, bitorder="little").tobytes()], pa.binary())],
                                                 ["row", "block", "bits"])

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = 1 << (BLOCK_BITS - 3)
    out = [np.zeros(1 << (CELL_BITS - 3), np.uint8) for _ in range(ROWS)]
    # at most ROWS * 2^(CELL_BITS - BLOCK_BITS) rows of 8 KB, whatever the input
    for r in pieces.repartition(n, "row", "block").mapInArrow(run, "row int, block int, bits binary").toLocalIterator():
        out[r["row"]][r["block"] * width:(r["block"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return out


def estimated_repeated(sketch: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Whether every row of the sketch has counted the hash twice or more; never false for one that occurs twice."""
    out = np.ones(len(hashes), bool)
    for row, bits in enumerate(sketch):
        c = cells(hashes, row)
        out &= (bits[c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def candidates(words: Words, sketch: list[np.ndarray], window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows estimated repeated, and the hash of each one's anchor."""
    starts, places, h = anchors(words, window, seed)
    if not len(starts):
        return starts, h[:0]
    new = np.concatenate([[True], places[1:] != places[:-1]])
    repeated = estimated_repeated(sketch, h[places[new]])[np.cumsum(new) - 1]
    return starts[repeated], h[places[repeated]]


def _ranked(ids: list, hashes: list[int]) -> np.ndarray:
    """Rank of each document: by id, nulls last, then by the hash of its text."""
    order = sorted({(i is None, i, x) for i, x in zip(ids, hashes, strict=True)}, key=lambda k: (k[0], 0 if k[0] else k[1], k[2]))
    rank = {k: n for n, k in enumerate(order)}
    return np.fromiter((rank[i is None, i, x] for i, x in zip(ids, hashes, strict=True)), np.int64, len(ids))


def _earliest(k1: np.ndarray, k2: np.ndarray, rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places of the earliest entry of each key."""
    order = np.lexsort((start, rank, k2, k1))
    a, b = k1[order], k2[order]
    return order[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])] if len(order) else order


def repeated_windows(rows: DataFrame, sketch, window: int, seed: int, parts: int) -> DataFrame:
    """Windows estimated repeated, the earliest of each kind per task, in `parts` parts by anchor."""
    id_kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.value
        ids: list = []
        hashes: list[int] = []
        held: list[tuple[np.ndarray, ...]] = []
        id_type = None

        def flushed() -> pa.RecordBatch:
            k1, k2, anchor, doc, start = (np.concatenate(c) for c in zip(*held, strict=True))
            first = _earliest(k1, k2, _ranked(ids, hashes)[doc], start)
            part = anchor[first] % np.uint64(parts)  # low bits: the high ones of a least hash are mostly 0
            order = np.lexsort((start[first], doc[first], part))
            first, part, out = first[order], part[order], []
            used, at = np.unique(part, return_index=True)
            for p, lo, hi in zip(used.tolist(), at.tolist(), [*at[1:].tolist(), len(part)], strict=True):
                of = first[lo:hi]
                docs, which = np.unique(doc[of], return_inverse=True)
                docs = docs.tolist()
                out.append((int(p), [ids[d] for d in docs], [hashes[d] for d in docs], k1[of].tobytes(), k2[of].tobytes(), which.astype("<u4").tobytes(), start[of].astype("<u4").tobytes()))
            held.clear(), ids.clear(), hashes.clear()
            kinds = (pa.int32(), pa.list_(id_type), pa.list_(pa.int64()), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "ids", "hashes", "k1", "k2", "doc", "start"])

        for b in batches:
            id_type = b.column("_id").type
            words = Words(b.column("_text").to_pylist())
            at, anchor = candidates(words, bits, window, seed)
            if len(at):
                doc = np.searchsorted(words.firsts, at, "right") - 1
                k1, k2 = (grams(words.lanes[lane], window, lane)[at] for lane in range(2))
                held.append((k1, k2, anchor, doc + len(ids), at - words.firsts[doc]))
                ids.extend(b.column("_id").to_pylist())
                hashes.extend(b.column("_hash").to_pylist())
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield flushed()
        if held:
            yield flushed()

    schema = f"part int, ids array<{id_kind}>, hashes array<long>, k1 binary, k2 binary, doc binary, start binary"
    return rows.select("_id", "_hash", "_text").mapInArrow(run, schema)


def earliest_windows(pieces: DataFrame, parts: int) -> DataFrame:
    """(_id, _hash, run): windows of a document that no earlier window equals, as runs of starts; a part at a time in memory."""
    id_kind = pieces.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        hashes: list[int] = []
        held: list[tuple[np.ndarray, ...]] = []
        current, id_type = None, None

        def flushed() -> Iterator[pa.RecordBatch]:
            k1, k2, doc, start = (np.concatenate(c) for c in zip(*held, strict=True))
            rank = _ranked(ids, hashes)
            first = _earliest(k1, k2, rank[doc], start)
            r, start = rank[doc[first]], start[first]
            order = np.lexsort((start, r))
            r, start, of = r[order], start[order], doc[first][order]
            at = np.arange(len(r))
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (start[1:] != start[:-1] + 1)])
            new |= (at - at[new][np.cumsum(new) - 1]) % RUN == 0
            cut = np.flatnonzero(new)
            run = (start[cut].astype(np.int64) * RUN) + np.diff(np.concatenate([cut, [len(r)]])) - 1
            for lo in range(0, len(cut), 100_000):
                docs = of[cut[lo:lo + 100_000]].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in docs], id_type), pa.array([hashes[d] for d in docs], pa.int64()), pa.array(run[lo:lo + 100_000])], ["_id", "_hash", "run"])
            held.clear(), ids.clear(), hashes.clear()

        for b in batches:
            id_type = b.column("ids").type.value_type
            for part, i, h, k1, k2, doc, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and part != current:
                    yield from flushed()
                current = part
                held.append((np.frombuffer(k1, np.uint64), np.frombuffer(k2, np.uint64), np.frombuffer(doc, "<u4").astype(np.int64) + len(ids), np.frombuffer(start, "<u4")))
                ids.extend(i)
                hashes.extend(h)
        if held:
            yield from flushed()

    dealt = pieces.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, f"_id {id_kind}, _hash long, run long")


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of `starts`."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + window, n), -1)
    return np.cumsum(edges[:n]) > 0


def _cut(rows: DataFrame, sketch, window: int, seed: int) -> DataFrame:
    """Documents with their earliest windows (`_starts`, runs) as (_row, n_words, n_removed, kept_text, kept_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.value
        for b in batches:
            words = Words(b.column("_text").to_pylist())
            at, _ = candidates(words, bits, window, seed)
            bounds, removed, texts = np.searchsorted(at, words.firsts), [], []
            for i, pieces in enumerate(b.column("_starts").to_pylist()):
                own, gone = at[bounds[i]:bounds[i + 1]] - words.firsts[i], None
                if len(own):
                    runs = np.array(pieces or [], np.int64)
                    size = runs % RUN + 1
                    first = np.repeat(runs // RUN - np.cumsum(size) + size, size) + np.arange(size.sum())
                    gone = covered(int(words.counts[i]), own[~np.isin(own, first)], window)
                removed.append(0 if gone is None else int(gone.sum()))
                texts.append(words.joined(i, None if gone is None else ~gone))
            yield pa.RecordBatch.from_arrays(
                [b.column("_row"), pa.array(words.counts), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                ["_row", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, {_RESULT}")


def without_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, seed: int = SEED, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns `keep` (default: all) of `docs` plus n_words, n_removed, kept_text and kept_sha256.

    A word goes if a window of `window` words covers it whose words also start earlier: in a document of smaller id,
    or before in its own. Null texts have no words; a text shorter than a window loses nothing. Null ids come last.
    Rows that share an id are documents ordered by the hash of their text; rows that share both are one
    document and each get its result. Input columns named like an added one are replaced; an empty table gives an empty result.
    """
    if not 0 < seed <= window:
        raise ValueError("an anchor must fit into a window")
    spark = docs.sparkSession
    arrow_batches(spark)
    keep = tuple(docs.columns) if keep is None else tuple(keep)
    source = without(docs.select(*keep), "n_words", "n_removed", "kept_text", "kept_sha256")
    body = F.col(text).cast("string")
    names = source.columns
    rows = docs.select(F.struct(*names).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("_hash"), body.cast("binary").alias("_text"))
    sketch = spark.sparkContext.broadcast(merged_sketch(partition_sketches(docs, text, window, seed)))  # 2^CELL_BITS bits a row
    parts = part_count(spark, docs, text)
    firsts = earliest_windows(repeated_windows(rows, sketch, window, seed, parts), parts)
    firsts = firsts.groupBy("_id", "_hash").agg(F.collect_list("run").alias("_starts")).withColumnsRenamed({"_id": "_i", "_hash": "_h"})
    met = rows.join(firsts, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left").select("_row", "_text", "_starts")
    return _cut(met, sketch, window, seed).select("_row.*", "n_words", "n_removed", F.col("kept_text").cast("string").alias("kept_text"), "kept_sha256")


def part_count(spark: SparkSession, docs: DataFrame, text: str) -> int:
    """Parts that windows are grouped in: so many that one fits into memory if all windows repeat."""
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (4 * PART_WINDOWS)))
