"""Packing documents into token windows with their lexical neighbours.

Texts are tokenised once into a stored table. Document frequencies of all texts give the
weights of a BM25 inverted index, which is built shard by shard. Texts are routed to shards by content: they are
ranged by two weighted min-hashes of their terms, so that texts with rare terms in common come one after the other, and
a task closes a shard after SHARD_DOCS of them. A text longer than a window fills whole windows by
itself; what is left of it is placed by the terms of the whole text. Each seed asks its shard's index, with all its terms, for unused
neighbours, which fill its window one after the other; the last is cut at the edge
and becomes the next seed. What a shard cannot complete moves on to the next one, and a task's
last window is cut into windows of 1, 2, 4 ... tokens, which need no padding.
"""

from __future__ import annotations

import itertools
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.llm.common import arrow_batches, shipped, stored, worker_cache

shipped(__name__)

WINDOW = 2048
END_ID = 1
SHARD_DOCS = 1024
K1, B = 1.2, 0.75
WORD_END = "</w>"  # fixed value: what a piece at a word's end carries in the vocabulary
_WORDS_HELD = 1_500_000
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)  # ASCII marks without the apostrophe
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")  # the letters of ASCII and Latin-1 in UTF-8
_LETTERS_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")  # letters, then such marks


def load_tokenizer(content: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(content.decode("utf-8"))


class WordIds(dict):
    """Ids of words as bytes; a word is encoded when first looked up in a Python worker and remembered, up to _WORDS_HELD of them."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.tokenize, self.tails = tokenizer, tokenizer.model.tokenize, {}
        # how the tokenizer writes letters before it looks up pieces, which may be byte by byte
        split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.pieces = {ord(c): split(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}
        self.latin = {ord(c): self.pieces.get(ord(c.lower()), c.lower()) for c in map(chr, range(0x100)) if c.isalpha()}

    def __missing__(self, word: bytes) -> bytes:
        """A word of letters with marks behind it is the word, then the marks."""
        base = word.rstrip(_MARKS)
        # Latin letters, which most words consist of: each has one lower-case letter, and nothing else is normalised in them
        if base.isalpha():
            letters = base.lower().decode("ascii")
        elif _LATIN.fullmatch(base):
            letters = base.decode("utf-8").translate(self.latin)
        else:
            ids = self[word] = self._other(word.decode("utf-8", "surrogatepass"))
            return ids
        if len(base) == len(word):
            ids = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
        else:
            ids = self[base] + self._tail(word[len(base):].decode("ascii"))
        self[word] = ids
        return ids

    def _other(self, text: str) -> bytes:
        m = _LETTERS_MARKS.fullmatch(text)
        # letters must stay letters when the tokenizer normalises them
        if m and m[2] and unicodedata.normalize("NFC", m[1]).lower().isalpha():
            return self[m[1].encode("utf-8", "surrogatepass")] + self._tail(m[2])
        return self._encoded(text)

    def _tail(self, marks: str) -> bytes:
        ids = self.tails.get(marks)
        if ids is None:
            ids = self.tails[marks] = self._encoded(marks)
        return ids

    def _encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def token_ids(texts: pa.Array, held: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (binary) one after the other, and where each text begins: no token crosses white space, and letter case does not matter."""
    if len(held) > _WORDS_HELD:
        held.clear()
        held.tails.clear()
    raw = texts.fill_null(b"").view(pa.string())
    # written in lower case a special token's name would become one
    split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(raw, "<|"), raw, pc.ascii_lower(raw)))
    words = split.flatten().dictionary_encode()  # there are empty words at the ends of texts
    distinct = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary), "\n")
    found = [held[w] for w in distinct[0].as_buffer().to_pybytes().split(b"\n")]
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    number = words.indices.to_numpy()
    size = sizes[number]
    ends = np.cumsum(size)
    at = np.repeat((np.cumsum(sizes) - sizes)[number] - ends + size, size)
    at += np.arange(len(at))
    offsets = split.offsets.to_numpy()
    return np.frombuffer(b"".join(found), dtype="<u4")[at], np.concatenate([[0], ends])[offsets - offsets[0]]


def tokenised(docs: DataFrame, content: bytes, text: str, id_col: str) -> DataFrame:
    """(id, ids, sums) per row; ids as little-endian 16-bit numbers where the vocabulary permits, else 32-bit, without the end.

    A task's last row has, instead, `sums`: the number of its texts, of their ids, and of the texts that contain each id.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_cache(f"words-{zlib.crc32(content)}", lambda: WordIds(load_tokenizer(content)))
        width = np.dtype(id_width(held.tokenizer))
        n, length, id_type, counts = 0, 0, None, np.zeros(held.tokenizer.get_vocab_size(), dtype=np.int64)
        terms = Terms(len(counts))
        for b in batches:
            id_type = b.column("id").type
            ids, starts = token_ids(b.column("text"), held)
            n, length = n + len(starts) - 1, length + len(ids)
            for lo, hi in itertools.pairwise(starts.tolist()):
                found, _ = terms.counted(ids[lo:hi])
                if len(terms.place) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(terms.place) - len(counts), dtype=np.int64)])
                counts[found] += 1
            data = [None, pa.py_buffer((starts * width.itemsize).astype(np.int32)), pa.py_buffer(ids.astype(width))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.Array.from_buffers(pa.binary(), len(starts) - 1, data), pa.nulls(len(starts) - 1, pa.binary())], ["id", "ids", "sums"])
        if n:
            sums = np.concatenate([[n, length], counts]).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.array([zlib.compress(sums.tobytes(), 1)])], ["id", "ids", "sums"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(run, f"id {kind}, ids binary, sums binary")


def id_width(tokenizer) -> str:
    return "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


class Terms:
    """Distinct ids of a text and their frequencies, in no order: every id points to one of its places, where it is counted."""

    def __init__(self, size: int):
        self.place = np.zeros(size, dtype=np.int64)

    def counted(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(ids):
            return ids, np.zeros(0, dtype=np.int64)
        if (most := int(ids.max())) >= len(self.place):
            self.place = np.zeros(2 * most, dtype=np.int64)
        self.place[ids] = np.arange(len(ids))
        counts = np.bincount(self.place[ids])
        at = np.flatnonzero(counts)
        return ids[at], counts[at]


def document_frequencies(rows: DataFrame) -> tuple[int, float, np.ndarray]:
    """Number of texts, their mean length, and texts per id (one number per vocabulary entry), from the tasks' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(0, dtype=np.int64)
        for b in batches:
            for x in b.column("sums"):
                sums = np.frombuffer(zlib.decompress(x.as_buffer()), dtype="<i8")
                out = np.concatenate([out, np.zeros(max(0, len(sums) - len(out)), dtype=np.int64)])
                out[:len(sums)] += sums
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(used - 2), pa.array(out[used])], ["term", "n"])

    sums = {r["term"]: r["n"] for r in rows.where("sums is not null").select("sums").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, length = sums.pop(-2, 0), sums.pop(-1, 0)
    df = np.zeros(max(sums, default=0) + 1, dtype=np.int64)
    df[list(sums)] = list(sums.values())
    return n, length / max(n, 1), df


def routed(rows: DataFrame, idf, width: str) -> DataFrame:
    """`rows` ranged by content: texts agree in a route as likely as their sets of terms, weighted by idf, overlap.

    The id's hash comes last, so a large group of like texts is spread over several tasks. Tasks are as many as the data fills.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, _ = idf.value
        rng = np.random.default_rng(6)
        with np.errstate(divide="ignore"):
            draws = [np.where(weights > 0, rng.exponential(size=len(weights)) / weights, np.inf).astype(np.float32) for _ in range(2)]
        for b in batches:
            routes = ([], [])
            for x in b.column("ids"):
                ids = np.frombuffer(x.as_buffer(), dtype=width)
                for d, out in zip(draws, routes, strict=True):
                    out.append(int(ids[d[ids].argmin()]) if len(ids) else -1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ids"), pa.array(routes[0], pa.int32()), pa.array(routes[1], pa.int32())], ["id", "ids", "r1", "r2"])

    by = ["r1", "r2", F.xxhash64("id"), "id"]
    return rows.mapInArrow(run, f"id {kind}, ids binary, r1 int, r2 int").repartitionByRange(*by).sortWithinPartitions(*by).select("id", "ids")


class Shard:
    """Inverted index of up to SHARD_DOCS pieces and the greedy filling of windows from it."""

    def __init__(self, pieces: list[tuple], idf: np.ndarray, mean: float, window: int):
        # a piece: (document, first id, ids, terms of its document, their frequencies, its length); documents are numbered by the caller
        self.pieces, self.window = [p[:3] for p in pieces], window
        self.at = [0] * len(pieces)
        self.unused = np.ones(len(pieces), dtype=bool)
        sizes = [len(p[3]) for p in pieces]
        terms = np.concatenate([p[3] for p in pieces])
        tf = np.concatenate([p[4] for p in pieces]).astype(np.float64)
        norm = np.repeat([K1 * (1 - B + B * p[5] / max(mean, 1.0)) for p in pieces], sizes)
        gain = idf[np.minimum(terms, len(idf) - 1)]
        weights = gain * tf * (K1 + 1) / (tf + norm)
        docs = np.repeat(np.arange(len(pieces)), sizes)
        used = gain > 0
        terms, weights, docs = terms[used], weights[used], docs[used]
        self.cuts = np.searchsorted(docs, np.arange(len(pieces) + 1))
        order = np.argsort(terms, kind="stable")
        self.docs, self.weights = docs[order], weights[order]
        _, self.queries, self.sizes = np.unique(terms, return_inverse=True, return_counts=True)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.indexed = len(pieces)

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused pieces by falling BM25 score for all terms of the seed, ties in order; strangers last."""
        left = np.flatnonzero(self.unused)
        if 5 * len(left) < 4 * self.indexed:
            self._forget_used(len(left))
        query = self.queries[self.cuts[seed]:self.cuts[seed + 1]]
        sizes = self.sizes[query]
        take = np.repeat(self.starts[query] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        score = np.bincount(self.docs[take], self.weights[take], len(self.pieces))
        return left[np.argsort(-score[left], kind="stable")]

    def _forget_used(self, left: int) -> None:
        """The postings of used pieces go; nobody asks for them any more."""
        kept = self.unused[self.docs]
        before = np.concatenate([[0], np.cumsum(kept)])
        self.sizes = before[self.starts + self.sizes] - before[self.starts]
        self.starts = before[self.starts]
        self.docs, self.weights, self.indexed = self.docs[kept], self.weights[kept], left

    def windows(self) -> Iterator[list[tuple]]:
        """Windows as lists of (document, first id, ids); all but the last are full."""
        seed, cut = 0, None
        while True:
            if cut is None:
                while seed < len(self.pieces) and not self.unused[seed]:
                    seed += 1
                if seed == len(self.pieces):
                    return
                start = seed
            else:
                start = cut
            out, room, cut = [], self.window, None
            room = self._take(start, room, out)
            for other in self.neighbours(start):
                if not room:
                    break
                room = self._take(other, room, out)
                if self.unused[other]:
                    cut = other
            yield out

    def _take(self, i: int, room: int, out: list[tuple]) -> int:
        document, first, ids = self.pieces[i]
        part = ids[self.at[i]:self.at[i] + room]
        out.append((document, first + self.at[i], part))
        self.at[i] += len(part)
        self.unused[i] = self.at[i] < len(ids)
        return room - len(part)


def _halved(window: list[tuple]) -> Iterator[list[tuple]]:
    """A short window as windows whose lengths are powers of two, longest first."""
    total = sum(len(x) for _, _, x in window)
    for bit in reversed(range(total.bit_length())):
        room, out = (1 << bit) & total, []
        while room:
            document, first, ids = window[0]
            out.append((document, first, ids[:room]))
            if len(ids) > room:
                window = [(document, first + room, ids[room:]), *window[1:]]
            else:
                window = window[1:]
            room -= len(out[-1][2])
        if out:
            yield out


def packed(docs: DataFrame, tokenizer_path: str, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, end_id: int = END_ID,
           shard_docs: int = SHARD_DOCS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    Every id of every document, its end included, lies in exactly one piece; null and empty texts consist of
    the end alone. Repeated rows are documents of their own. sequence_id numbers windows, with gaps
    between tasks. Other columns are not read; an empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    content = Path(tokenizer_path).read_bytes()  # the driver's file; tasks get its content
    width = id_width(load_tokenizer(content))
    rows = stored(tokenised(docs, content, text, id_col))
    n, mean, df = document_frequencies(rows)
    # texts that contain a term in more than half of the cases say nothing about it: weight 0
    idf = docs.sparkSession.sparkContext.broadcast(((np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0.0) * (df > 0)).astype(np.float32), mean))
    rows = routed(rows.where("sums is null").select("id", "ids"), idf, width)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, average = idf.value
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        rows_out: list[tuple] = []
        terms = Terms(len(weights))
        id_type = None

        def emit(pieces: list[tuple]) -> None:
            nonlocal sequence
            at = 0
            for (doc, total), first, ids in pieces:
                long = ids.astype("<u4")
                rows_out.append((doc, first, len(ids), zlib.crc32(long.tobytes()), total, sequence, at) + ((long,) if with_ids else ()))
                at += len(ids)
            sequence += 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows_out, strict=True)) or [()] * len(names)
            kinds = [id_type] + [pa.int64()] * 6 + [pa.list_(pa.int64())] * with_ids
            rows_out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def piece(doc, ids: np.ndarray, first: int) -> tuple:
            return (doc, len(ids)), first, ids[first:], *terms.counted(ids[:-1]), len(ids) - 1

        pool: list[tuple] = []
        for b in batches:
            id_type = b.column("id").type
            for doc, x in zip(b.column("id").to_pylist(), b.column("ids"), strict=True):
                ids = np.append(np.frombuffer(x.as_buffer(), dtype=width), np.array([end_id], dtype=width))
                whole = len(ids) // window * window
                for at in range(0, whole, window):
                    emit([((doc, len(ids)), at, ids[at:at + window])])
                if whole < len(ids):
                    pool.append(piece(doc, ids, whole))
                if len(pool) >= shard_docs:
                    last = None
                    for pieces in Shard(pool, weights, average, window).windows():
                        if sum(len(p[2]) for p in pieces) == window:
                            emit(pieces)
                        else:
                            last = pieces
                    # a short window's pieces go on as pieces of their own
                    pool = [((d, total), first, part, *terms.counted(part), len(part)) for (d, total), first, part in last or []]
                if len(rows_out) >= 5000:
                    yield flushed()
        if pool:
            for pieces in Shard(pool, weights, average, window).windows():
                if sum(len(p[2]) for p in pieces) == window:
                    emit(pieces)
                else:
                    for part in _halved(pieces):
                        emit(part)
        if rows_out:
            yield flushed()

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if with_ids else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
