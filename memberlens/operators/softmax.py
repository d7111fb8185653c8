"""Multinomial logistic regression under several penalties at once.

A pass over the rows gives loss and gradient of every fit that still moves: a task multiplies blocks of rows with the coefficients of all
fits and passes on one small array. Steps are quasi-Newton steps (L-BFGS). They start from an upper bound of the curvature, which follows from the features' second moments
(Böhning), and go on from the exact curvature at a point close to the minimum, which takes one further pass for all fits.

The minimised function is that of Spark's LogisticRegression with an L2 penalty: weighted mean loss plus half the penalty times the
squared coefficients of features scaled to deviation 1; intercepts are free.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import DenseMatrix, DenseVector, Matrix, Vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.session import cut_lineage, shipped

shipped(__name__)

BLOCK_ROWS = 256  # stored together: a row group of a hundred blocks stays small
JOINED_ROWS = 4096  # multiplied at once
SLICE = 16384  # numbers added up by one task
TOLERANCE = 1e-9  # of the loss that a step may still gain when a fit ends
CURVATURE_AFTER = 8  # passes under the bound of the curvature
CURVATURE_AGAIN = 25  # passes under the same exact curvature
MAX_PASSES = 400
ABSENT = -100.0  # intercept of a class without rows


@dataclass
class SoftmaxModel:
    """Coefficients (classes x features) and intercepts for plain feature values."""

    coefficientMatrix: Matrix
    interceptVector: Vector

    @staticmethod
    def of(coefficients: np.ndarray, intercepts: np.ndarray) -> SoftmaxModel:
        return SoftmaxModel(DenseMatrix(*coefficients.shape, coefficients.ravel(order="F").tolist()), DenseVector(intercepts.tolist()))

    def probabilities(self, values: Column) -> Column:
        """Array of class probabilities of an array of feature values."""
        coefficients, intercepts = self.coefficientMatrix.toArray(), self.interceptVector.toArray()

        @F.arrow_udf("array<double>")
        def proba(v: pa.Array) -> pa.Array:
            p = _scaled_exp(_matrix(v) @ coefficients.T + intercepts)[0]
            return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))

        return proba(values)


def _matrix(values: pa.Array) -> np.ndarray:
    x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
    if np.isnan(x).any():
        raise ValueError("a feature value is not a number")
    return x


def _scaled_exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of every row of scores, and the log of the sum of their exponentials."""
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=1, keepdims=True)
    return e / total, (top + np.log(total))[:, 0]


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse of a positive definite matrix by elimination: LAPACK's threaded factorisation was seen to hang in a driver."""
    a = matrix.copy()
    for i in range(len(a)):
        pivot, row, column = a[i, i], a[i] / a[i, i], a[:, i].copy()
        a -= np.multiply.outer(column, row)
        a[i], a[:, i] = row, -column / pivot
        a[i, i] = 1.0 / pivot
    return a


# --- rows ------------------------------------------------------------------------------

def blocks(rows: DataFrame) -> DataFrame:
    """Rows (`label`, `values`) stored as matrices of at most BLOCK_ROWS rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = b.column("label").to_numpy().astype(np.int32)
            cuts = range(0, len(labels), BLOCK_ROWS)
            x = _matrix(b.column("values")) if len(labels) else None
            yield pa.RecordBatch.from_arrays([pa.array([len(labels[i:i + BLOCK_ROWS]) for i in cuts], pa.int32()), pa.array([labels[i:i + BLOCK_ROWS].tobytes() for i in cuts], pa.binary()),
                                              pa.array([x[i:i + BLOCK_ROWS].tobytes() for i in cuts], pa.binary())], ["n", "labels", "values"])

    return cut_lineage(rows.select("label", "values").mapInArrow(run, "n int, labels binary, values binary"), fine=True)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Labels and values of the blocks, some blocks at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        for n, labels, values in zip(*[b.column(c) for c in ("n", "labels", "values")], strict=True):
            held.append((np.frombuffer(labels.as_buffer(), np.int32), np.frombuffer(values.as_buffer(), float).reshape(n.as_py(), -1)))
            if sum(len(y) for y, _ in held) >= JOINED_ROWS:
                yield tuple(np.concatenate(a) for a in zip(*held, strict=True))
                held = []
    if held:
        yield tuple(np.concatenate(a) for a in zip(*held, strict=True))


def _summed(data: DataFrame, rows: int, width: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Sums over all rows of what `add` puts into an array of that shape, which depends on features and classes only.

    Tasks pass on their arrays in slices; a task adds up one slice of all of them.
    """
    cuts = range(0, rows * width, SLICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width))
        for labels, values in _opened(batches):
            add(total, labels, values)
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.int32()), pa.array([flat[i:i + SLICE].tobytes() for i in cuts], pa.binary())], ["place", "sums"])

    def added(parts: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(p.as_buffer(), float) for p in parts.column("sums"))
        return pa.table({"place": parts.column("place")[:1], "sums": pa.array([sums.tobytes()], pa.binary())})

    parts = data.mapInArrow(run, "place int, sums binary").groupBy("place").applyInArrow(added, "place int, sums binary").collect()
    return np.concatenate([np.frombuffer(p.sums, float) for p in sorted(parts, key=lambda p: p.place)]).reshape(rows, width)


@dataclass
class Moments:
    """Per class the second moments of (1, features - origin)."""

    origin: np.ndarray
    by_class: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return self.by_class[:, 0, 0]

    def weighted(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean, deviation (of samples, under reliability weights) and second moments about the mean, under a weight per class."""
        m = np.tensordot(weights, self.by_class, 1)
        total = m[0, 0]
        shift = m[0, 1:] / total
        about = m[1:, 1:] / total - np.outer(shift, shift)
        rest = total - (weights ** 2 * self.counts).sum() / total
        variance = np.where(np.diag(about) > 1e-14 * shift ** 2, np.diag(about), 0.0) * (total / rest if rest > 0 else 0.0)
        return self.origin + shift, np.sqrt(variance), about


def moments(data: DataFrame, n_classes: int) -> Moments:
    found = data.where("n > 0").first()
    if found is None:
        raise ValueError("there are no rows to fit")
    origin = np.frombuffer(found["values"], float).reshape(found.n, -1)[0]
    width = len(origin) + 1

    def add(total: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
        if len(labels) and not 0 <= labels.min() <= labels.max() < n_classes:
            raise ValueError(f"labels must lie within 0 and {n_classes - 1}")
        x = np.column_stack([np.ones(len(values)), values - origin])
        for c in np.unique(labels).tolist():
            mine = x[labels == c]
            total[c * width:(c + 1) * width] += mine.T @ mine

    return Moments(origin, _summed(data, n_classes * width, width, add).reshape(n_classes, width, width))


# --- fits ------------------------------------------------------------------------------

@dataclass
class _Descent:
    """One fit on its way: coefficients of scaled features with the intercept in front (classes x columns)."""

    penalty: np.ndarray  # per column
    trial: np.ndarray
    inverse: Callable[[np.ndarray], np.ndarray]
    exact: bool = False
    at: np.ndarray | None = None
    loss: float = np.inf
    gradient: np.ndarray | None = None
    direction: np.ndarray | None = None
    gain: float = 0.0
    step: float = 1.0
    done: bool = False
    steps: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def take(self, loss: float, gradient: np.ndarray) -> None:
        """Move to the tried point if the loss falls enough there, else try half the way."""
        loss = loss + (self.penalty * self.trial ** 2).sum() / 2
        gradient = gradient + self.penalty * self.trial
        if self.at is not None:
            if not loss <= self.loss - 1e-4 * self.step * self.gain:
                self.step /= 2
                self.trial = self.at - self.step * self.direction
                self.done = self.step < 1e-6  # no number between has a smaller loss
                return
            moved, bent = self.trial - self.at, gradient - self.gradient
            if (moved * bent).sum() > 0:
                self.steps = [*self.steps[-39:], (moved, bent)]
        self.at, self.loss, self.gradient = self.trial, loss, gradient
        self.aim()

    def aim(self) -> None:
        q, passed = self.gradient, []
        for moved, bent in reversed(self.steps):
            share = (moved * q).sum() / (moved * bent).sum()
            passed.append(share)
            q = q - share * bent
        d = self.inverse(q)
        if self.steps and not self.exact:
            moved, bent = self.steps[-1]
            d = d * ((moved * bent).sum() / (self.inverse(bent) * bent).sum())
        for (moved, bent), share in zip(self.steps, reversed(passed), strict=True):
            d = d + (share - (bent * d).sum() / (moved * bent).sum()) * moved
        self.direction, self.gain, self.step = d, float((self.gradient * d).sum()), 1.0
        self.trial = self.at - d
        self.done = self.gain <= TOLERANCE


def fit_many(data: DataFrame, known: Moments, strengths: Sequence[float], weights: Sequence[float],
             start: Sequence[SoftmaxModel] | None = None) -> list[SoftmaxModel]:
    """One model per penalty, all under the same weight per class. `start`: models close to them, from other weights."""
    present = np.flatnonzero(known.counts)
    k, place = len(present), np.zeros(len(known.counts), dtype=np.int64)
    place[present] = np.arange(k)
    weight = np.asarray(weights, float)
    mean, deviation, about = known.weighted(weight)
    scale = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
    width, total = len(mean) + 1, float((weight * known.counts).sum())

    def opened(labels: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.ones((len(values), width))
        np.subtract(values, mean, out=x[:, 1:])
        x[:, 1:] *= scale
        return x, place[labels], weight[labels] / total

    def losses(points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        every = np.concatenate(points)

        def add(sums: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
            x, y, w = opened(labels, values)
            z, row = x @ every.T, np.arange(len(x))
            for i in range(len(points)):
                mine = z[:, i * k:(i + 1) * k]
                p, log_sum = _scaled_exp(mine)
                sums[i * k, width] += (w * (log_sum - mine[row, y])).sum()
                p[row, y] -= 1.0
                mine[:] = p * w[:, None]
            sums[:, :width] += z.T @ x

        sums = _summed(data, len(every), width + 1, add).reshape(len(points), k, width + 1)
        return [(float(s[0, width]), s[:, :width]) for s in sums]

    pairs = [(a, b) for a in range(k) for b in range(a, k)]

    def curvatures(points: list[np.ndarray]) -> list[np.ndarray]:
        """Second derivatives of the loss, one block of columns x columns for each pair of classes."""
        every = np.concatenate(points)

        def add(sums: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
            x, _, w = opened(labels, values)
            z = x @ every.T
            for i in range(len(points)):
                p, _ = _scaled_exp(z[:, i * k:(i + 1) * k])
                for j, (a, b) in enumerate(pairs):
                    at = (i * len(pairs) + j) * width
                    sums[at:at + width] += (x * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x

        sums = _summed(data, len(points) * len(pairs) * width, width, add).reshape(len(points), len(pairs), width, width)
        out = []
        for s in sums:
            h = np.zeros((k, width, k, width))
            for (a, b), block in zip(pairs, s, strict=True):
                h[a, :, b, :] = h[b, :, a, :] = block
            out.append(h.reshape(k * width, k * width))
        return out

    def bend(descents: list[_Descent]) -> None:
        shifted = np.tile(np.eye(1, width)[0], k)  # adding one number to all intercepts changes nothing
        for d, h in zip(descents, curvatures([d.trial if d.at is None else d.at for d in descents]), strict=True):
            inverse = _inverse(h + np.diag(np.tile(d.penalty + 1e-10, k)) + np.outer(shifted, shifted))
            d.inverse, d.exact, d.steps = (lambda q, inverse=inverse: (inverse @ q.ravel()).reshape(q.shape)), True, []
            if d.at is not None:
                d.aim()

    second = np.zeros((width, width))
    second[0, 0], second[1:, 1:] = 1.0, about * np.outer(scale, scale)
    descents = []
    for i, strength in enumerate(strengths):
        penalty = np.full(width, float(strength))
        penalty[0] = 0.0
        bound = _inverse(second / 2 + np.diag(penalty + 1e-10))
        first = np.zeros((k, width))
        if start:
            raw = start[i].coefficientMatrix.toArray()[present]
            first = np.column_stack([start[i].interceptVector.toArray()[present] + raw @ mean, raw * deviation])
        descents.append(_Descent(penalty, first, lambda q, bound=bound: q @ bound))
    if start:
        bend(descents)

    moving, since = list(descents), 0
    for number in range(1, MAX_PASSES + 1):
        for d, found in zip(moving, losses([d.trial for d in moving]), strict=True):
            d.take(*found)
        moving = [d for d in moving if not d.done]
        since += 1
        if not moving:
            break
        if since >= (CURVATURE_AGAIN if moving[0].exact else CURVATURE_AFTER):
            bend(moving)
            moving, since = [d for d in moving if not d.done], 0

    models = []
    for d in descents:
        coefficients, intercepts = np.zeros((len(place), width - 1)), np.full(len(place), ABSENT)
        coefficients[present] = d.at[:, 1:] * scale
        free = d.at[:, 0] - coefficients[present] @ mean
        intercepts[present] = free - free.mean()
        models.append(SoftmaxModel.of(coefficients, intercepts))
    return models
