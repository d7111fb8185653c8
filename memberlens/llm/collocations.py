"""Phrase collocations: n-gram counts from an FM-index per shard, summed across shards.

A shard holds texts of one language as word numbers, 0 between pieces that no phrase crosses. Its index
is bidirectional: the Burrows-Wheeler transforms of the word sequence and of its reverse, sorted by CONTEXT
words, which is enough for phrases shorter than that. A phrase is an interval in both;
one backward step extends all intervals of a level to the left, and the
reversed interval, kept in step, gives the words to the right. Levels are first counted by key: a key has 20 bits and the number of a
part, so sums across shards are never below a phrase's count, and only phrases whose parts may be frequent everywhere
together are extended at the next level. A last pass counts what is left by its words. Shards learn which keys are left from a Bloom filter of
bounded size; its false hits and keys that coincide cost time but change nothing, since the last sums decide.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memberlens.llm.common import arrow_batches, shipped, stored
from memberlens.llm.wordhash import Words, mixed

shipped(__name__)

LEAST = 100  # occurrences of a candidate
LONGEST = 5  # words of a candidate
TOP = 2000  # phrases reported per language
SHARD_WORDS = 3 << 18
CONTEXT = 8  # words that suffixes are sorted by
KEY_BITS = 20  # bits of a key beside its part; parts are as many as shuffle partitions, so a part's phrases do not grow with the data
HELD_KEYS = 1 << 21  # keys that a task gathers before it sends them
BITS = 16  # bits of the filter per phrase
BLOCK = 1 << 15  # fixed value: bits of one bitmap of bitmap_construct_agg
MOST_BLOCKS = 4096  # of a filter: 16 MB
UNKNOWN = "und"
SALTS = 64

_EDGE = b"\xff"  # never part of UTF-8: stands for the edge of a piece
#: ASCII letters in lower case, marks and line ends as line ends.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b for b in range(256))


def folded(text: bytes | None) -> bytes:
    """Words of a text and edges of its pieces, with white space between them."""
    return (text or b"").translate(_FOLD).replace(b"\n", b" \xff ")


def context_order(sequence: np.ndarray) -> np.ndarray:
    """Places of the cyclic sequence sorted by the CONTEXT words from there on, ties by place."""
    rank, width, n = sequence.astype(np.int64), 1, len(sequence)
    while True:
        key = rank * n + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        width *= 2
        if width >= CONTEXT:
            return order
        k = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
        rank = new


def transform(sequence: np.ndarray) -> np.ndarray:
    """The word before each suffix, in the order of suffixes."""
    return np.roll(sequence, 1)[context_order(sequence)]


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words, the edge first, and the texts as one sequence of their numbers with an edge at both ends."""
    words = Words([_EDGE, *[t + b" \xff" for t in texts]])
    found, first, number = np.unique(words.lanes[0], return_index=True, return_inverse=True)
    if (words.lanes[1] != words.lanes[1][first][number]).any():  # two words with one hash in the first lane
        pairs = np.stack([words.lanes[0], words.lanes[1]], axis=1)
        found, first, number = np.unique(pairs, axis=0, return_index=True, return_inverse=True)
        number = number.ravel()
    edge = int(number[0])
    often = np.bincount(number)
    often[edge] = len(number)
    order = np.argsort(-often, kind="stable")  # frequent words have small numbers, which take less room
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    first = first[order]
    return [words.buffer[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)], place[number]


def planes(numbers: np.ndarray) -> bytes:
    """All lowest bytes of 32-bit numbers, then all second ones and so on: most high bytes are 0 and compress to nothing."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def without_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def shards(docs: DataFrame, text: str = "text", lang: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Indexes of all texts: (lang, n, words, forward, backward), n the number of words; a task closes a shard of about `shard_words` words per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def index(name: str) -> pa.RecordBatch:
            words, sequence = numbered(held.pop(name))
            sizes.pop(name)
            row = [name], [int(np.count_nonzero(sequence))], [b"\n".join(words)], [planes(transform(sequence))], [planes(transform(sequence[::-1]))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.string(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["lang", "n", "words", "forward", "backward"])

        for b in batches:
            for name, t in zip(b.column("_lang").to_pylist(), b.column("_text").to_pylist(), strict=True):
                part = folded(t)
                held.setdefault(name, []).append(part)
                sizes[name] = sizes.get(name, 0) + part.count(b" ") + 1
                if sizes[name] >= shard_words:
                    yield index(name)
            while sum(sizes.values()) >= 2 * shard_words:  # many small languages
                yield index(max(sizes, key=sizes.__getitem__))
        for name in list(held):
            yield index(name)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("_lang"), F.col(text).cast("string").cast("binary").alias("_text"))
    return rows.mapInArrow(run, "lang string, n long, words binary, forward binary, backward binary")


class Filter:
    """Blocked Bloom filter over 64-bit keys."""

    def __init__(self, blocks: int, bits: dict[int, bytes]):
        self.blocks = blocks
        self.bits = np.zeros((blocks, BLOCK // 8), np.uint8)
        for b, x in bits.items():
            self.bits[b] = np.frombuffer(x, np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        block = ((keys >> np.uint64(30)) % np.uint64(self.blocks)).astype(np.int64)
        out = np.ones(len(keys), bool)
        for shift in (0, 15):
            at = (keys >> np.uint64(shift)) & np.uint64(BLOCK - 1)
            out &= (self.bits[block, (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def phrase_filter(frequent: DataFrame) -> Filter:
    """The keys of `frequent` (column `key`); at most MOST_BLOCKS bitmaps come to the driver."""
    blocks = max(1, min(MOST_BLOCKS, -(-frequent.count() * BITS // BLOCK)))
    key = F.col("key")
    at = F.array(key.bitwiseAND(F.lit(BLOCK - 1)), F.shiftrightunsigned(key, 15).bitwiseAND(F.lit(BLOCK - 1)))
    slots = frequent.select(F.pmod(F.shiftrightunsigned(key, 30), F.lit(blocks)).cast("int").alias("block"), F.explode(at).alias("at"))
    return Filter(blocks, {r["block"]: bytes(r["bits"]) for r in slots.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")).collect()})


class Index:
    """One direction of a shard's index: the transform and where the suffixes of each word begin."""

    def __init__(self, data: bytes, n_words: int):
        self.before = without_planes(data).astype(np.int64)
        self.counts = np.bincount(self.before, minlength=n_words)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    @functools.cached_property
    def step(self) -> np.ndarray:
        """Row of the suffix that is one word longer."""
        out = np.empty(len(self.before), np.int64)
        out[np.argsort(self.before, kind="stable")] = np.arange(len(self.before))
        return out

    def rows(self, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """All rows of the intervals, one interval after the other."""
        return np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))

    def only_word(self, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The word before all occurrences of each interval, 0 if there are several or an edge."""
        if not len(lo):
            return np.zeros(0, np.int64)
        found, at = self.before[self.rows(lo, size)], np.concatenate([[0], np.cumsum(size)[:-1]])
        least = np.minimum.reduceat(found, at)
        return np.where(least == np.maximum.reduceat(found, at), least, 0)


class Level:
    """Phrases of one length in a shard: word numbers, interval in both directions (sorted by the first), and keys."""

    def __init__(self, words: np.ndarray, lo: np.ndarray, size: np.ndarray, back: np.ndarray, keys: np.ndarray):
        self.words, self.lo, self.size, self.back, self.keys = words, lo, size, back, keys

    def only(self, kept: np.ndarray) -> Level:
        return Level(self.words[kept], self.lo[kept], self.size[kept], self.back[kept], self.keys[kept])


def key_of(keys: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Keys of phrases from those without their first word and the hashes of that word."""
    x = (keys * np.uint64(0x9E3779B97F4A7C15)) ^ before
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(30))


def single_words(forward: Index, hashes: np.ndarray) -> Level:
    number = np.flatnonzero(forward.counts)
    number = number[number > 0]
    return Level(number[:, None], forward.first[number], forward.counts[number], forward.first[number], key_of(np.zeros(len(number), np.uint64), hashes[number]))


def extended(level: Level, forward: Index, hashes: np.ndarray) -> Level:
    """Phrases one word longer whose two parts, without the first and without the last word, are in `level`."""
    n_words = len(hashes)
    rows = forward.rows(level.lo, level.size)
    owner = np.repeat(np.arange(len(level.lo)), level.size)
    key, first, size = np.unique(owner * n_words + forward.before[rows], return_index=True, return_counts=True)
    owner, word = key // n_words, key % n_words
    # in the reversed interval words come in order, so smaller ones shift it
    smaller = np.cumsum(size) - size
    back = level.back[owner] + smaller - smaller[np.searchsorted(owner, owner)] if len(owner) else smaller
    lo = forward.step[rows[first]]
    inside = np.searchsorted(level.lo, lo, "right") - 1
    known = (word > 0) & (inside >= 0)
    known[known] = lo[known] < level.lo[inside[known]] + level.size[inside[known]]
    owner, word, lo, size, back = owner[known], word[known], lo[known], size[known], back[known]
    order = np.argsort(lo)
    owner, word, lo, size, back = owner[order], word[order], lo[order], size[order], back[order]
    return Level(np.concatenate([word[:, None], level.words[owner]], axis=1), lo, size, back, key_of(level.keys[owner], hashes[word]))


def reduced(keys: np.ndarray, parts: int) -> np.ndarray:
    """A key's part and its lower KEY_BITS bits, as one number."""
    return (((keys >> np.uint64(32)) % np.uint64(parts)) << np.uint64(KEY_BITS)) | (keys & np.uint64((1 << KEY_BITS) - 1))


def gaps(numbers: np.ndarray) -> bytes:
    """Ascending numbers as 16-bit steps, 65535 for a step without a number; all low bytes before all high ones."""
    step = np.diff(numbers, prepend=0)
    skips = step // 65535
    out = np.full(int(skips.sum()) + len(step), 65535, np.uint16)
    out[np.cumsum(skips + 1) - 1] = step % 65535
    return out.view(np.uint8).reshape(-1, 2).T.tobytes()


def without_gaps(data: bytes) -> np.ndarray:
    step = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(2, -1).T).view(np.uint16).ravel()
    return np.cumsum(step, dtype=np.int64)[step != 65535]


def levels(words: bytes, forward: bytes, lang: str, filters: list[Filter], parts: int) -> Iterator[tuple[Level, Index, np.ndarray, list[bytes]]]:
    """Phrases of 1, 2, ... words of a shard: of each level those whose parts pass the filters, one level more than there are filters."""
    names = words.split(b"\n")
    seed = xxhash.xxh32_intdigest(lang.encode())
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in names), np.uint64, len(names))
    ahead = Index(forward, len(names))
    level = single_words(ahead, hashes)
    for f in filters:
        level = level.only(f.holds(mixed(reduced(level.keys, parts))))
        yield level, ahead, hashes, names
        level = extended(level, ahead, hashes)
    yield level, ahead, hashes, names


def frequent_keys(indexes: DataFrame, filters: list, parts: int, least: int) -> DataFrame:
    """Keys (mixed) of the next level that come to `least` occurrences across shards. Counts are sent part by part as arrays."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of several shards, whatever their language: keys that lie closer take less room

        def pieces() -> pa.RecordBatch:
            keys, n = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, n = keys[at], np.add.reduceat(n, at)
            part, low = (keys >> np.uint64(KEY_BITS)).astype(np.int64), (keys & np.uint64((1 << KEY_BITS) - 1)).astype(np.int64)
            small = np.minimum(n, 255).astype(np.uint8)
            used, at = np.unique(part, return_index=True)
            cut = list(zip(at.tolist(), [*at[1:].tolist(), len(part)], strict=True))
            data = [zlib.compress(gaps(low[x:y]) + small[x:y].tobytes(), 1) for x, y in cut]
            columns = [used, [y - x for x, y in cut], data, [n[x:y][small[x:y] == 255].tobytes() for x, y in cut]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "size", "data", "large"])

        for b in batches:
            for lang, words, forward in zip(*(b.column(c) for c in ("lang", "words", "forward")), strict=True):
                level = None
                for level, *_ in levels(words.as_py(), forward.as_py(), lang.as_py(), known, parts):
                    pass
                if not len(level.keys):
                    continue
                held.append((reduced(level.keys, parts), level.size))
                if sum(len(k) for k, _ in held) >= HELD_KEYS:
                    yield pieces()
        if held:
            yield pieces()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        current = None

        def summed() -> pa.RecordBatch:
            keys, n = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            often = keys[at][np.add.reduceat(n, at) >= least].astype(np.uint64) | np.uint64(current << KEY_BITS)
            return pa.RecordBatch.from_arrays([pa.array(mixed(often).view(np.int64))], ["key"])

        for b in batches:
            for part, size, data, large in zip(*(b.column(c).to_pylist() for c in ("part", "size", "data", "large")), strict=True):
                if held and part != current:
                    yield summed()
                current = part
                data = zlib.decompress(data)
                n = np.frombuffer(data[-size:], np.uint8).astype(np.int64)
                n[n == 255] = np.frombuffer(large, np.int64)
                held.append((without_gaps(data[:-size]), n))
        if held:
            yield summed()

    pieces = indexes.select("lang", "words", "forward").mapInArrow(count, "part int, size int, data binary, large binary")
    return pieces.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(add, "key long")


def words_of_pairs(indexes: DataFrame, filters: list, parts: int) -> DataFrame:
    """Keys (mixed) of the words that occur in pairs which pass the filters: no other word is part of a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        for b in batches:
            for lang, words, forward in zip(*(b.column(c) for c in ("lang", "words", "forward")), strict=True):
                for level, _, hashes, _ in levels(words.as_py(), forward.as_py(), lang.as_py(), known, parts):
                    if level.words.shape[1] == 2:
                        used = np.unique(level.words)
                        keys = np.unique(mixed(reduced(key_of(np.zeros(len(used), np.uint64), hashes[used]), parts)))
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])
                        break

    return indexes.select("lang", "words", "forward").mapInArrow(run, "key long").distinct()


def phrase_counts(indexes: DataFrame, filters: list, parts: int, least: int) -> DataFrame:
    """Phrases that pass the filters of their length and occur `least` times: lang, size, phrase, n, inner.

    Shards send their phrases part by part with counts and, where all occurrences have the same word to the left or right, a byte
    of its hash. So `inner` may be set wrongly where words differ but their bytes do not; `confirmed` decides.
    """
    longest = len(filters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        for b in batches:
            for lang, words, forward, backward in zip(*(b.column(c) for c in ("lang", "words", "forward", "backward")), strict=True):
                lang, backward = lang.as_py(), backward.as_py()
                behind, phrases, numbers, sides = None, [], [], []
                for size, (level, ahead, hashes, names) in zip(range(1, longest + 1), levels(words.as_py(), forward.as_py(), lang, known, parts), strict=False):
                    behind = behind or Index(backward, len(names))
                    only = [np.zeros(len(level.lo), np.int64)] * 2
                    if 1 < size < longest:
                        only = [ahead.only_word(level.lo, level.size), behind.only_word(level.back, level.size)]
                    phrases += [b" ".join([names[i] for i in p]) for p in level.words.tolist()]
                    numbers.append(level.size)
                    # a byte of the word's hash, never 0: who has no longer phrase around it will mostly have two of them
                    sides.append(np.stack([np.where(x > 0, hashes[x] % np.uint64(255) + np.uint64(1), np.uint64(0)).astype(np.uint8) for x in only]))
                if phrases:
                    numbers, sides = np.concatenate(numbers).astype("<u4"), np.concatenate(sides, axis=1)
                    by_part: dict[int, list[int]] = {}
                    for i in sorted(range(len(phrases)), key=phrases.__getitem__):
                        by_part.setdefault(zlib.crc32(phrases[i]) % parts, []).append(i)
                    rows = [(part, lang, zlib.compress(b"\n".join([phrases[i] for i in of]), 1), zlib.compress(planes(numbers[of]) + sides[:, of].tobytes(), 1)) for part, of in by_part.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["part", "lang", "phrases", "numbers"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], list[int]] = {}
        current = None

        def summed() -> pa.RecordBatch:
            rows = [(lang, p.count(b" ") + 1, p, n, bool(left or right)) for (lang, p), (n, left, right) in held.items() if n >= least]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()), strict=True)],
                                              ["lang", "size", "phrase", "n", "inner"])

        for b in batches:
            for part, lang, phrases, numbers in zip(*(b.column(c).to_pylist() for c in ("part", "lang", "phrases", "numbers")), strict=True):
                if held and part != current:
                    yield summed()
                current = part
                numbers = zlib.decompress(numbers)
                cut = len(numbers) // 6 * 4
                columns = without_planes(numbers[:cut]).tolist(), *np.frombuffer(numbers[cut:], np.uint8).reshape(2, -1).tolist()
                for p, n, left, right in zip(zlib.decompress(phrases).split(b"\n"), *columns, strict=True):
                    seen = held.get((lang, p))
                    if seen is None:
                        held[lang, p] = [n, left, right]
                    else:
                        seen[0] += n
                        if seen[1] != left:
                            seen[1] = 0
                        if seen[2] != right:
                            seen[2] = 0
        if held:
            yield summed()

    pieces = indexes.select("lang", "words", "forward", "backward").mapInArrow(count, "part int, lang string, phrases binary, numbers binary")
    dealt = pieces.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(add, "lang string, size int, phrase binary, n long, inner boolean")


def confirmed(phrases: DataFrame) -> DataFrame:
    """`inner` as it is: a phrase one word longer that contains this one occurs as often."""
    words = F.split("phrase", " ")
    parts = F.array(F.slice(words, F.lit(1), F.col("size") - 1), F.slice(words, F.lit(2), F.col("size") - 1))
    longer = phrases.where(F.col("size") > 2).select("lang", "n", F.explode(parts).alias("w")).select("lang", "n", F.array_join("w", " ").alias("phrase")).distinct()
    some = phrases.where("inner").select("lang", "phrase", "n").join(longer, ["lang", "phrase", "n"], "left_semi").withColumn("_inner", F.lit(True))
    return phrases.join(some, ["lang", "phrase", "n"], "left").select("lang", "size", "phrase", "n", F.col("_inner").isNotNull().alias("inner"))


def frequent_phrases(indexes: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Candidates of up to `longest` words with `least` occurrences and the words they consist of, and the number of words per language (lang, total).

    The phrases are (lang, size, phrase, n, inner); inner if every occurrence may have the same word before it, or behind it.
    """
    if longest >= CONTEXT:
        raise ValueError(f"phrases have fewer than {CONTEXT} words")
    spark, filters = indexes.sparkSession, []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(longest):
        filters.append(spark.sparkContext.broadcast(phrase_filter(stored(frequent_keys(indexes, filters, parts, least)))))
    if longest > 1:
        filters[0] = spark.sparkContext.broadcast(phrase_filter(stored(words_of_pairs(indexes, filters[:2], parts))))
    phrases = phrase_counts(indexes, filters, parts, least).select("lang", "size", F.col("phrase").cast("string").alias("phrase"), "n", "inner")
    return phrases, indexes.groupBy("lang").agg(F.sum("n").alias("total"))


def scored(phrases: DataFrame, total: DataFrame) -> DataFrame:
    """Candidates with the scores of their weakest cuts: lang, phrase, a, l, r, n, score."""
    counts = phrases.select("lang", "phrase", "n")
    words = F.split("phrase", " ")
    cuts = phrases.where((F.col("size") > 1) & ~F.col("inner")).select("lang", "phrase", F.col("n").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(
        counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.join(total.select("lang", F.col("total").alias("n")), "lang")
    score = F.expr("cast(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(19,0)) as decimal(38,0)) div cast(cast(l as decimal(19,0)) * cast(r as decimal(18,0)) as decimal(38,0))")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The `top` phrases of each language as (lang, rank, phrase, a, l, r, n, score).

    A text is cut into pieces at .,;:!? and line ends, pieces into words at blanks and tabs; A-Z count as lower case. A phrase of 2 to
    `longest` words occurring `least` times or more in pieces is a candidate, unless all its occurrences lie in one longer
    candidate. Null texts are empty; a null language is `und`. Ties go by count, then phrase. Repeated rows count each
    time; other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    indexes = stored(shards(docs, text, lang, shard_words), compression="zstd")
    arrow_batches(spark, rows=1)  # a shard is some megabytes: one at a time in memory
    reader = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(reader)
    spark.conf.set(reader, "1")
    try:
        phrases, total = frequent_phrases(indexes, least, longest)
        phrases = confirmed(stored(phrases))
    finally:
        spark.conf.set(reader, before)
        arrow_batches(spark)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each of SALTS parts of a language, then the best of those: no task sees a whole language
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = scored(phrases, total).withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
