"""Toxicity scores from a factorization machine over hashed terms.

Terms are lower-case words and word beginnings, hashed to 32 bits. Besides a weight each term
has a short vector, and the product of two vectors adds to the score, so pairs such as an
insult with a group name count beyond their parts. No term is chosen by its own link with the
label: weights are fitted alone first, then with the vectors, under penalties that follow the
noise of each term. Fitted on a bounded sample of labelled rows; every text is scored whole, in
parallel, by a model of bounded size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.llm.common import arrow_batches, shipped

shipped(__name__)

TRAIN_ROWS = 20_000  # bound of the labelled sample
MIN_TEXTS = 4  # sampled texts that must contain a term of the model
WEIGHT_PENALTY = 2.5  # in standard errors of a term's gradient without any link; falls with the weight
VECTOR_PENALTY = 0.3  # the same for vectors, squared
WEIGHTS_ALONE = 0.1  # share of the passes that fit weights only
PREFIX = 4  # letters of a word beginning
FACTORS = 4
UPDATES = 3_000  # mini-batches of the fit; at least three passes
FOLDS = 5  # fixed value: one fold of so many is held out
_WORDS = re.compile(r"[^\W\d_]+")
_CACHE = 300_000  # words a worker remembers before it starts anew


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def _hashes(word: str) -> tuple[int, int]:
    """Hash of the word and of its beginning."""
    return zlib.crc32(word.encode("utf-8", "surrogatepass")), zlib.crc32(b"\0" + word[:PREFIX].encode("utf-8", "surrogatepass"))


def terms(text: str | None) -> np.ndarray:
    """Distinct hashed terms of a text, in order."""
    out = set()
    for word in set(_WORDS.findall((text or "").lower())):
        out.update(_hashes(word))
    return np.array(sorted(out), dtype=np.uint32)


@dataclass
class Machine:
    """Hashed terms in order with their weights and vectors."""

    keys: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    bias: float

    def scores(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability per text; text i has the rows ids[starts[i]:starts[i + 1]] of the model."""
        return 1.0 / (1.0 + np.exp(-np.clip(_raw(ids, starts, self.weights, self.vectors)[0] + self.bias, -30, 30)))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between starts; empty ranges give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def _raw(ids, starts, weights, vectors):
    """Sums of weights and of products of vectors, these over the root of the number of terms: long texts have many pairs."""
    v = vectors[ids]
    s = _sums(v, starts)
    part = 1.0 / np.sqrt(np.maximum(np.diff(starts), 1))
    return _sums(weights[ids], starts) + 0.5 * part * (s**2 - _sums(v**2, starts)).sum(axis=1), v, s, part


def fit(rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, updates: int = UPDATES, rate: float = 0.3, seed: int = 11) -> Machine:
    """Logistic loss by proximal AdaGrad over shuffled mini-batches. Without both labels the model is their mean alone."""
    rng = np.random.default_rng(seed)
    mean = float(labels.mean()) if len(labels) else 0.0
    flat = np.concatenate(rows) if rows else np.array([], dtype=np.uint32)
    found, counts = np.unique(flat, return_counts=True)
    keys, share = found[counts >= MIN_TEXTS], counts[counts >= MIN_TEXTS] / max(len(rows), 1)
    if not 0 < mean < 1 or not len(keys):
        return Machine(keys[:0], np.zeros(0, np.float32), np.zeros((0, factors), np.float32), float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6))))
    encoded = []
    for r in rows:
        at = np.minimum(np.searchsorted(keys, r), len(keys) - 1)
        encoded.append(at[keys[at] == r])
    noise = np.sqrt(np.maximum(share * (1 - share), len(rows) ** -2.0) * mean * (1 - mean) / len(rows))
    w, v = np.zeros(len(keys)), rng.normal(0, 0.05, (len(keys), factors))
    bias, gw, gv, gb = float(np.log(mean / (1 - mean))), np.full(len(keys), 1e-2), np.full((len(keys), factors), 1e-2), 1e-2
    passes = max(3, -(-updates * 128 // len(rows)))
    for k in range(passes):
        alone = k < WEIGHTS_ALONE * passes
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            batch = order[at:at + 128]
            ids = np.concatenate([encoded[i] for i in batch])
            sizes = np.array([len(encoded[i]) for i in batch])
            starts = np.concatenate([[0], np.cumsum(sizes)])
            if alone:
                raw = _sums(w[ids], starts)
            else:
                raw, vi, s, part = _raw(ids, starts, w, v)
            error = 1.0 / (1.0 + np.exp(-np.clip(raw + bias, -30, 30))) - labels[batch]
            each = np.repeat(error, sizes)
            dw = np.bincount(ids, each, len(keys)) / len(batch)
            gw += dw**2
            step = rate / np.sqrt(gw)
            w -= step * dw
            w = np.sign(w) * np.maximum(np.abs(w) - step * WEIGHT_PENALTY * noise / (1 + 20 * np.abs(w)), 0)
            if not alone:
                pull = (each * np.repeat(part, sizes))[:, None] * (np.repeat(s, sizes, axis=0) - vi)
                dv = np.stack([np.bincount(ids, pull[:, f], len(keys)) for f in range(factors)], axis=1) / len(batch)
                gv += dv**2
                step = 0.3 * rate / np.sqrt(gv)
                v = (v - step * dv) / (1 + step * VECTOR_PENALTY * noise[:, None])
            db = error.mean()
            gb += db**2
            bias -= rate * db / np.sqrt(gb)
    return Machine(keys, w.astype(np.float32), v.astype(np.float32), bias)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> Machine:
    """Fit on at most about `train_rows` labelled texts outside the held-out fold, chosen by hash of the id.

    Rows without id or label are left out; an id labelled twice counts once, as toxic if any label says so.
    """
    arrow_batches(docs.sparkSession)
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (fold(F.col(id_col)) != 0))
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label")))
    n = known.count()
    share = min(1.0, train_rows / max(n, 1))
    bounded = known.where(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(F.xxhash64("_id", F.lit(7))).limit(train_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(bounded), "_id").select("_id", "_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms(t).tobytes() for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_label"), pa.array(found, pa.binary())], ["_id", "_label", "_terms"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = sorted(texts.mapInArrow(run, f"_id {kind}, _label int, _terms binary").collect(), key=lambda r: (r["_id"], bytes(r["_terms"])))
    return fit([np.frombuffer(r["_terms"], dtype=np.uint32) for r in rows], np.array([float(r["_label"]) for r in rows]))


def scored(docs: DataFrame, machine: Machine, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every row as (id_col, held_out, score, predicted). Null and empty texts get the score of no terms."""
    spark = docs.sparkSession
    arrow_batches(spark)
    model = spark.sparkContext.broadcast((machine.keys, machine.weights, machine.vectors, machine.bias))  # at most TRAIN_ROWS texts' terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*model.value)
        rows = {int(k): i for i, k in enumerate(m.keys)}
        seen: dict[str, tuple[int, ...]] = {}
        for b in batches:
            ids, starts = [], [0]
            for t in b.column("_text").to_pylist():
                found: set[int] = set()
                for word in set(_WORDS.findall((t or "").lower())):
                    at = seen.get(word)
                    if at is None:
                        if len(seen) >= _CACHE:
                            seen.clear()
                        at = seen[word] = tuple(rows[h] for h in _hashes(word) if h in rows)
                    found.update(at)
                ids.extend(found)
                starts.append(len(ids))
            score = m.scores(np.array(ids, dtype=np.int64), np.array(starts))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(score, pa.float64())], ["_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"_id {kind}, score double")
    return out.select(F.col("_id").alias(id_col), F.coalesce(fold(F.col("_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
