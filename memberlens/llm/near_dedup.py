"""Near-duplicate groups by one-permutation MinHash, banded buckets and star-shaped candidate edges.

A text's set of word shingles is hashed once; the least hash in each of BANDS * ROWS ranges is
its signature, and empty ranges borrow from others by optimal densification. Texts with equal
sets form a class, and only classes are compared. Classes that agree on a band share a bucket.
Each bucket has a star: its centre is the member that meets most others in all its buckets, in a
group of copies the original. A member is first compared with the best centre it meets. Then, in
buckets whose members are still in several components, further centres are taken, eight times
as many each time and those of small components first, and compared with the members outside
their component. Two bit sketches rule out most such pairs without losing any that is similar enough. Only the
new links between components are then joined up. So a bucket of copies costs an edge per member, no link between bucket members is lost, and edges
are confirmed on whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.llm.common import arrow_batches, shipped, stored, without

shipped(__name__)

SHINGLE_WORDS = 5
PERCENT = 80  # least similarity: shared shingles in a hundred of all
BANDS, ROWS = 25, 5  # a pair at 0.8 shares no band with probability (1 - 0.8^5)^25 = 5e-5
PROBES = 2048  # places an empty range tries before it takes the next filled one
SKETCH_BITS = 4096  # of the sketch that rules out pairs without loss
PARITY_WORDS = 8  # of 64 bits each, of the smaller sketch that is looked at first
LOCAL_EDGES = 200_000  # edges that a task joins up by itself
BROADCAST_ROWS = 1_000_000  # ids sent to every executor, at most; beyond, the join shuffles
_WORDS_HELD = 300_000
_ODD = [f"odd{i}" for i in range(PARITY_WORDS)]

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64


class _WordHashes(dict):
    """Hash bytes of words; forgets all when full."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _WORDS_HELD:
            self.clear()
        out = self[word] = xxhash.xxh3_64_digest(word)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def shingles(text: str | None, size: int, hashes: dict) -> np.ndarray:
    """Ordered distinct hashes of the text's shingles; of all its words if they are fewer than `size`."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=_U)
    h = np.frombuffer(b"".join(map(hashes.__getitem__, words)), dtype=">u8").astype(_U)
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, dtype=_U)
    for i in range(n):
        out = _mix(out + h[i:len(h) - n + 1 + i])
    return np.unique(out)


def signature(found: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Least hash per range, densified; `probes[t, j]` is the t-th place that range j tries."""
    k = probes.shape[1]
    ranges = ((found >> _U(32)) * _U(k) >> _U(32)).astype(np.int64)
    filled, at = np.unique(ranges, return_index=True)
    out, there = np.zeros(k, dtype=_U), np.zeros(k, dtype=bool)
    out[filled], there[filled] = found[at], True
    empty = np.flatnonzero(~there)
    first = 0
    while len(empty) and first < len(probes):
        tried = probes[first:first + 16, empty]
        hit = there[tried]
        got = hit.any(axis=0)
        out[empty[got]] = out[tried[hit.argmax(axis=0), np.arange(len(empty))][got]]
        empty, first = empty[~got], first + 16
    for j in empty:
        out[j] = out[filled[np.searchsorted(filled, j) % len(filled)]]
    return out


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit bucket number per band; bands have buckets of their own."""
    parts = sig.reshape(-1, rows)
    out = np.arange(1, len(parts) + 1, dtype=_U)
    for i in range(rows):
        out = _mix(out + parts[:, i])
    return out.astype(np.int64)


def sketch(found: np.ndarray) -> np.ndarray:
    """The set as SKETCH_BITS bits, one for each shingle's hash."""
    bits = np.zeros(SKETCH_BITS, dtype=np.uint8)
    bits[(found % _U(SKETCH_BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def parity(found: np.ndarray) -> np.ndarray:
    """Per bit whether the number of shingles with that bit is odd. Bits that differ are no more than the shingles only one set has."""
    bits = np.bincount((found % _U(SKETCH_BITS)).astype(np.int64) % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) % 2
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _places(bands: int, rows: int) -> np.ndarray:
    return np.random.RandomState(97).randint(0, bands * rows, (PROBES, bands * rows))


def described(docs: DataFrame, text: str, id_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """Per row: id, hash of the text, size of its set, key of its set (null if empty), bucket numbers."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, places = _WordHashes(), _places(bands, rows)
        for b in batches:
            n, keys, buckets = [], [], []
            for t in b.column("text").to_pylist():
                found = shingles(t, size, hashes)
                n.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                buckets.append(band_hashes(signature(found, places), rows) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                ["id", "text_hash", "n", "key", "buckets"])

    return source.mapInArrow(run, f"id {kind}, text_hash long, n long, key binary, buckets array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, text: str, id_col: str, size: int) -> DataFrame:
    """(key, set, bits) of the wanted (id, text_hash) rows: whole texts are read again, not stored."""
    few = wanted.count() <= BROADCAST_ROWS
    wanted = wanted.select(F.col("id").alias("_i"), F.col("text_hash").alias("_h"))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text"))
    found = source.join(F.broadcast(wanted) if few else wanted, (F.col("text_hash") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_i")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for b in batches:
            sets = [shingles(t, size, hashes) for t in b.column("text").to_pylist()]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            bits = [sketch(s) for s in sets]
            odd = np.array([parity(s) for s in sets], dtype=np.int64).reshape(-1, PARITY_WORDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(bits, pa.list_(pa.int64())),
                                              *[pa.array(np.ascontiguousarray(odd[:, i])) for i in range(PARITY_WORDS)]], ["key", "set", "bits", *_ODD])

    described = found.mapInArrow(run, "key binary, set binary, bits array<long>, " + ", ".join(f"{c} long" for c in _ODD))
    return described.groupBy("key").agg(*[F.first(c).alias(c) for c in ("set", "bits", *_ODD)])


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b and others) whose whole sets are similar enough."""
    left = sets.select(F.col("key").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("key").alias("b"), F.col("set").alias("set_b"))
    pairs = edges.join(left, "a").join(right, "b").select(*edges.columns, "set_a", "set_b")
    names = edges.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=_U), np.frombuffer(y.as_buffer(), dtype=_U)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield b.select(names).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, edges.schema)


def forest(edges: list[tuple[bytes, bytes]]) -> dict[bytes, bytes]:
    """Every key of the edges with the least key it reaches through them."""
    above: dict[bytes, bytes] = {}

    def top(key: bytes) -> bytes:
        path = []
        while (up := above.setdefault(key, key)) != key:
            path.append(key)
            key = up
        for k in path:
            above[k] = key
        return key

    for u, v in edges:
        u, v = top(u), top(v)
        above[max(u, v)] = min(u, v)
    return {key: top(key) for key in list(above)}


def _joined_up(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components: each task replaces up to LOCAL_EDGES of its own by links to least keys."""
    def rows(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        links = [(u, v) for u, v in forest(held).items() if u != v]
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.binary()), pa.array([v for _, v in links], pa.binary())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        for b in batches:
            held += zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)
            if len(held) >= LOCAL_EDGES:
                yield rows(held)
                held = []
        yield rows(held)

    return edges.coalesce(edges.count() // LOCAL_EDGES + 1).mapInArrow(run, "u binary, v binary")


def components(links: DataFrame) -> DataFrame:
    """(key, root) for every key of the undirected links (a, b): root is the component's least key.

    Tasks join up what they hold; large-star and small-star steps then alternate until every key points to a root that points to nothing.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    edges = stored(_joined_up(edges))
    while True:
        ends = edges.select(F.col("u").alias("key"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
            edges.select(F.col("v").alias("key"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        loose = ends.groupBy("key").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below = 1 and above = 1)")
        if loose.isEmpty():
            own = edges.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct()
            return stored(edges.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(own))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct())


def near_links(docs: DataFrame, classes: DataFrame, text: str, id_col: str, size: int, percent: int) -> DataFrame:
    """Components (key, root) of the classes (key, id, text_hash, n, buckets) that share a bucket with another."""
    members = classes.select("key", "n", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(members.join(shared, "bucket"))
    # bucket mates of a member in all its buckets: the original of a group of copies has most
    mates = members.groupBy("key").agg(F.sum(F.col("size") - 1).alias("mates"))
    met = members.join(mates, "key")
    centres = met.groupBy("bucket").agg(F.max(F.struct("mates", F.col("key").alias("centre"), F.col("n").alias("n_centre"))).alias("top"))
    near = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    starred = members.join(centres, "bucket").where((F.col("key") != F.col("top.centre")) & near(F.col("n"), F.col("top.n_centre")))
    star = starred.groupBy("key").agg(F.max("top").alias("top")).select(F.least("key", "top.centre").alias("a"), F.greatest("key", "top.centre").alias("b"))
    edges = stored(star.distinct())
    wanted = stored(classes.join(members.select("key").distinct(), "key", "left_semi").select("id", "text_hash"))
    sets = stored(_sets(docs, wanted, text, id_col, size))
    tried = edges
    linked = components(_confirmed(edges, sets, percent))
    roots = stored(members.select("key").distinct().join(linked, "key", "left").select("key", F.coalesce("root", "key").alias("root")))
    width, rest = 8, members.select("bucket", "key", "n")
    while True:
        # members that have not been a centre, of buckets in which such members still have several roots
        rooted = rest.join(roots, "key")
        mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        rooted = stored(rooted.join(mixed.select("bucket"), "bucket", "left_semi"))
        if rooted.isEmpty():
            return roots
        # small components first: the bucket is done when only members of its largest one are left
        alike = F.count(F.lit(1)).over(Window.partitionBy("bucket", "root"))
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("alike", "root", "key"))
        ranked = stored(rooted.withColumn("alike", alike).withColumn("rank", rank).drop("alike").join(sets.select("key", "bits", *_ODD), "key"))
        first = ranked.where(F.col("rank") <= width).select("bucket", *[F.col(c).alias(f"{c}_a") for c in ("key", "n", "rank", "root", "bits", *_ODD)])
        # each bit in which two sketches differ stands for a shingle that only one text has: no pair above the limit fails this
        differ = F.aggregate(F.zip_with("bits", "bits_a", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, v: acc + v)
        odd = reduce(Column.__add__, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_a"))) for c in _ODD])
        both = F.col("n") + F.col("n_a")
        # each sketch stands once here: what stands twice is computed beforehand for every pair
        most = both * (100 - percent)
        possible = (odd * (100 + percent) <= most) & (differ * (100 + percent) <= most)
        pairs = (ranked.join(first, "bucket").where((F.col("rank") > F.col("rank_a")) & (F.col("root") != F.col("root_a")) & near(F.col("n"), F.col("n_a")) & possible)
                 .select(F.least("key_a", "key").alias("a"), F.greatest("key_a", "key").alias("b"), F.least("root_a", "root").alias("low"), F.greatest("root_a", "root").alias("high"))
                 .distinct().join(tried, ["a", "b"], "left_anti"))
        edges = stored(pairs)
        if not edges.isEmpty():
            tried = tried.unionByName(edges.select("a", "b"))
            joined = components(_confirmed(edges, sets, percent).select(F.col("low").alias("a"), F.col("high").alias("b"))).select(F.col("key").alias("root"), F.col("root").alias("least"))
            count = joined.count()
            if count:
                joined = F.broadcast(joined) if count <= BROADCAST_ROWS else joined
                roots = stored(roots.join(joined, "root", "left").select("key", F.coalesce("least", "root").alias("root")))
        rest, width = ranked.where(F.col("rank") > width).select("bucket", "key", "n"), width * 8


def grouped(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = SHINGLE_WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Every row as (id_col, text_hash, n_shingles, component_id, kept).

    component_id is the smallest id that links reach, kept whether it is the row's own. Texts
    without words have an empty set and stand alone. A null id never is a component's id unless all
    ids there are null; such rows are kept. Repeated rows get equal results. Other columns are not read.
    """
    arrow_batches(docs.sparkSession)
    all_rows = stored(described(docs, text, id_col, size, bands, rows))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))
    classes = stored(all_rows.where("key is not null").groupBy("key").agg(first.alias("rep"), F.first("n").alias("n"), F.first("buckets").alias("buckets"))
                     .select("key", "rep.id", "rep.text_hash", "n", "buckets"))
    roots = near_links(docs, classes, text, id_col, size, percent)
    least = classes.select("key", "id").join(roots, "key").groupBy("root").agg(F.min("id").alias("least"))
    final = classes.select("key", "id").join(roots.join(least, "root").select("key", "least"), "key", "left").select("key", F.coalesce("least", "id").alias("component_id"))
    joined = all_rows.select("id", "text_hash", "n", "key").join(final, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").alias(id_col), "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` that `grouped` keeps, with all their columns."""
    dropped = stored(grouped(docs, text, id_col, **options).where("not kept").select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    docs = without(docs, "_id", "_hash")
    gone = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text)) == F.col("_hash")), "left_anti")
