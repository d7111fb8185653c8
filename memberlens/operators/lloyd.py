"""K-Means for many models at once.

All starts of all settings are updated by the same pass: a task assigns its rows under every model that still moves
and passes on one array of sums per model and cluster, which are added up in Spark. Starts come from
a bounded sample, on which each is refined first; the passes over all rows then decide, and end
when no centre moves any more. The quality figures of all models take two further passes.

Points are stored as blocks of many rows, which tasks read as matrices. Points may belong to several populations
(`part`) and to draws from them (bits of `draws`); models of different populations then share their passes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.session import cut_lineage, shipped

shipped(__name__)

SAMPLE_ROWS = 10_000  # rows that starts are taken from, at most
TOLERANCE = 1e-4  # distance that a centre may still move when a fit ends
BLOCK_ROWS = 8192


@dataclass(frozen=True)
class Spec:
    """What to fit: number of clusters, leading dimensions (None: all), the seed of its starts, the population and the draw (None: all of it)."""

    k: int
    dims: int | None = None
    seed: int = 42
    part: int = 0
    draw: int | None = None


class Model(NamedTuple):
    """Centres and the rows they are for."""

    centres: np.ndarray
    part: int = 0
    draw: int | None = None


@dataclass
class Fit:
    spec: Spec
    centres: np.ndarray
    inertia: float

    @property
    def centroids(self) -> list[list[float]]:
        return [[float(x) for x in c] for c in self.centres]


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of every row to every centre; differences are taken about the centres' mean, which keeps small distances exact enough."""
    middle = centres.mean(axis=0)
    x, c = x - middle, centres - middle
    return np.maximum((x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1), 0.0)


def widened(x: np.ndarray) -> np.ndarray:
    """Columns that a cluster adds up: 1, squared norm, coordinates."""
    return np.column_stack([np.ones(len(x)), (x * x).sum(axis=1), x])


def assigned_sums(wide: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Per cluster the sums of the nearest rows' columns: two products of matrices, none per row and cluster."""
    nearest = ((centres * centres).sum(axis=1)[:, None] - 2.0 * (centres @ wide[:, 2:].T)).argmin(axis=0)
    return (nearest == np.arange(len(centres))[:, None]).astype(float) @ wide


def moved(sums: np.ndarray, counts: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Means of the clusters; an empty cluster keeps its centre."""
    return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)


def start(sample: np.ndarray, spec: Spec, number: int, max_iter: int) -> np.ndarray:
    """Centres spread over the sample (each new one drawn by its squared distance to the others) and refined on it."""
    x = sample[:, :spec.dims] if spec.dims else sample
    rng = np.random.default_rng(zlib.crc32(f"{spec.seed}:{number}".encode()))
    centres = x[rng.integers(len(x))][None, :]
    nearest = squared_distances(x, centres)[:, 0]
    while len(centres) < spec.k:
        total = nearest.sum()
        pick = rng.integers(len(x)) if total <= 0 else min(int(np.searchsorted(np.cumsum(nearest), rng.random() * total)), len(x) - 1)
        centres = np.concatenate([centres, x[pick][None, :]])
        nearest = np.minimum(nearest, ((x - x[pick]) ** 2).sum(axis=1))
    wide = widened(x)
    for _ in range(max_iter):
        sums = assigned_sums(wide, centres)
        new = moved(sums[:, 2:], sums[:, 0], centres)
        shift = np.sqrt(((new - centres) ** 2).sum(axis=1)).max()
        centres = new
        if shift <= TOLERANCE:
            break
    return centres


def _matrix(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def blocks(points: DataFrame) -> DataFrame:
    """Points (`point`, perhaps `part` and `draws`) as matrices of at most BLOCK_ROWS rows of one population; blocks stay what they are."""
    if "values" in points.columns:
        return points
    columns = {"part": F.lit(0), "draws": F.lit(0).cast("long")}
    rows = points.select("point", *[(F.col(c) if c in points.columns else other).alias(c) for c, other in columns.items()])

    def block(part: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        values, draws = (np.concatenate(a) for a in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(values)], pa.int32()), pa.array([values.tobytes()], pa.binary()), pa.array([draws.tobytes()], pa.binary())],
                                          ["part", "n", "values", "draws"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            parts, draws = b.column("part").to_numpy(), b.column("draws").to_numpy()
            for part in np.unique(parts).tolist():
                mine = np.flatnonzero(parts == part)
                x, d = _matrix(b.column("point").take(pa.array(mine))), draws[mine]
                while len(x):
                    room = BLOCK_ROWS - sum(len(v) for v, _ in held.setdefault(part, []))
                    held[part].append((x[:room], d[:room]))
                    x, d = x[room:], d[room:]
                    if len(held[part][-1][0]) == room:
                        yield block(part, held.pop(part))
        for part, rest in held.items():
            if rest:
                yield block(part, rest)

    return rows.mapInArrow(run, "part int, n int, values binary, draws binary")


def packed(points: DataFrame) -> DataFrame:
    """The points stored as blocks, dealt evenly: a pass spends seconds of arithmetic on a megabyte."""
    if "values" in points.columns:
        return points
    dealt = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut_lineage(blocks(dealt.sortWithinPartitions("part") if "part" in points.columns else dealt), fine=True)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Population, points and draws of every block."""
    for b in batches:
        for part, n, values, draws in zip(*[b.column(c) for c in ("part", "n", "values", "draws")], strict=True):
            yield part.as_py(), np.frombuffer(values.as_buffer(), float).reshape(n.as_py(), -1), np.frombuffer(draws.as_buffer(), np.int64)


def _drawn(x: np.ndarray, draws: np.ndarray, draw: int | None) -> np.ndarray:
    return x if draw is None else x[(draws >> draw) & 1 == 1]


def _sample(points: DataFrame, seed: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per population SAMPLE_ROWS of its rows at most, and the draws they are in."""
    sizes = {r.part: r.n for r in points.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row per population
    shares = {part: 1.0 if n <= SAMPLE_ROWS else 1.1 * SAMPLE_ROWS / n for part, n in sizes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, draws in _opened(batches):
            if shares[part] < 1:
                mine = np.random.default_rng([seed, zlib.crc32(x)]).random(len(x)) < shares[part]
                x, draws = x[mine], draws[mine]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([draws.tobytes()], pa.binary())],
                                                 ["part", "n", "values", "draws"])

    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in points.mapInArrow(run, "part int, n int, values binary, draws binary").collect():  # about SAMPLE_ROWS rows of each population
        found.setdefault(r.part, []).append((np.frombuffer(r["values"], float).reshape(r.n, -1), np.frombuffer(r.draws, np.int64)))
    out = {}
    for part, held in found.items():
        x, draws = (np.concatenate(a)[:SAMPLE_ROWS] for a in zip(*held, strict=True))
        order = np.lexsort(x.T)  # starts of a whole population do not depend on how it is partitioned
        out[part] = x[order], draws[order]
    return out


def starts(points: DataFrame, specs: Sequence[Spec], n_init: int, max_iter: int) -> list[np.ndarray]:
    """n_init starts of every spec, refined side by side by the executors."""
    spark = points.sparkSession
    rows = _sample(points, specs[0].seed)
    if any(s.part not in rows or not len(_drawn(*rows[s.part], s.draw)) for s in specs):
        raise ValueError("there are no points to cluster")
    sample = spark.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.column("model").to_pylist():
                spec = specs[m // n_init]
                centres = start(_drawn(*sample.value[spec.part], spec.draw), spec, m % n_init, max_iter)
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([centres.ravel()], pa.list_(pa.float64()))], ["model", "centres"])

    count = len(specs) * n_init
    models = spark.range(count).select(F.col("id").cast("int").alias("model")).repartition(min(count, spark.sparkContext.defaultParallelism))
    found = {r.model: np.array(r.centres).reshape(specs[r.model // n_init].k, -1) for r in models.mapInArrow(run, "model int, centres array<double>").collect()}
    return [found[m] for m in range(count)]


def _added(points: DataFrame, models: Sequence[Model | np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """Per model and cluster the sums of one pass: rows, squared distances, squared norms, coordinates.

    The rows that come back are as many as there are centres, whatever the input. Only populations that have a model are read.
    """
    spark = points.sparkSession
    models = [m if isinstance(m, Model) else Model(m) for m in models]
    shared = spark.sparkContext.broadcast([tuple(m) for m in models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(c), 3 + c.shape[1])) for c, _, _ in shared.value]
        for part, whole, draws in _opened(batches):
            wide: dict[tuple[int, int | None], np.ndarray] = {}
            for (c, own, draw), t in zip(shared.value, total, strict=True):
                if own != part:
                    continue
                key = c.shape[1], draw
                if key not in wide:
                    wide[key] = widened(_drawn(whole, draws, draw)[:, :c.shape[1]])
                sums = assigned_sums(wide[key], c)
                t[:, 0] += sums[:, 0]
                t[:, 1] += sums[:, 1] - 2.0 * (c * sums[:, 2:]).sum(axis=1) + (c * c).sum(axis=1) * sums[:, 0]
                t[:, 2:] += sums[:, 1:]
        # one batch a task: a batch for every model would cost more than its sums
        rows = np.concatenate([np.column_stack([t, np.zeros((len(t), width - t.shape[1]))]) for t in total])
        used = np.flatnonzero(rows[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(place[used, 0]), pa.array(place[used, 1]), *[pa.array(np.ascontiguousarray(rows[used, i])) for i in range(width)]], names)

    width = 3 + max(m.centres.shape[1] for m in models)
    place = np.array([(m, c) for m, model in enumerate(models) for c in range(len(model.centres))], dtype=np.int32)
    names = ["model", "cluster", *[f"_{i}" for i in range(width)]]
    read = blocks(points).where(F.col("part").isin(sorted({m.part for m in models})))
    parts = read.mapInArrow(run, "model int, cluster int, " + ", ".join(f"_{i} double" for i in range(width)))
    sums = parts.groupBy("model", "cluster").agg(*[F.sum(f"_{i}").alias(f"_{i}") for i in range(width)]).toArrow()
    found = np.column_stack([sums.column(n).to_numpy() for n in names])
    return {(int(r[0]), int(r[1])): r[2:5 + models[int(r[0])].centres.shape[1]] for r in found}


def _table(sums: dict[tuple[int, int], np.ndarray], model: int, centres: np.ndarray) -> np.ndarray:
    out = np.zeros((len(centres), 3 + centres.shape[1]))
    for c in range(len(centres)):
        if (model, c) in sums:
            out[c] = sums[model, c]
    return out


def distinct(models: list[np.ndarray], among: Sequence[int], n_init: int) -> list[int]:
    """Those of `among` that are the first start of their setting with these centres, in any order. Equal centres move alike."""
    seen, out = set(), []
    for m in among:
        c = np.round(models[m], 9) + 0.0
        key = m // n_init, c[np.lexsort(c.T[::-1])].tobytes()
        if key not in seen:
            seen.add(key)
            out.append(m)
    return out


def fit_many(points: DataFrame, specs: Sequence[Spec], n_init: int, max_iter: int = 300) -> list[Fit]:
    """The best of n_init fits of every spec on `point`. Every pass reads all points: they are packed once, unless they are.

    Passes end when no centre moves by more than TOLERANCE, or after max_iter of them. Starts that have come to the same
    centres go on as one.
    """
    points = packed(points)
    models = starts(points, specs, n_init, max_iter)
    inertia = np.full(len(models), np.inf)
    moving = distinct(models, range(len(models)), n_init)
    for _ in range(max_iter):
        sums = _added(points, [Model(models[m], specs[m // n_init].part, specs[m // n_init].draw) for m in moving])
        still = []
        for at, m in enumerate(moving):
            t = _table(sums, at, models[m])
            new = moved(t[:, 3:], t[:, 0], models[m])
            inertia[m] = t[:, 1].sum()
            if np.sqrt(((new - models[m]) ** 2).sum(axis=1)).max() > TOLERANCE:
                models[m] = new
                still.append(m)
        moving = distinct(models, still, n_init)
        for m in set(still) - set(moving):
            inertia[m] = np.inf  # another start has these centres and goes on
        if not moving:
            break
    out = []
    for i, spec in enumerate(specs):
        best = min(range(i * n_init, (i + 1) * n_init), key=lambda m: inertia[m])
        out.append(Fit(spec, models[best], float(inertia[best])))
    return out


def measure_many(points: DataFrame, models: Sequence[np.ndarray]) -> list[dict[str, float]]:
    """Davies-Bouldin, Calinski-Harabasz, silhouette on squared distances, sizes: of every model over all rows, in two passes."""
    models, points = list(models), blocks(points)
    sums = _added(points, models)
    tables = [_table(sums, m, c) for m, c in enumerate(models)]
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast((models, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, known = shared.value
        spread = [np.zeros((len(c), 3)) for c in centres]
        for _, whole, _ in _opened(batches):
            for c, t, s in zip(centres, known, spread, strict=True):
                x = whole[:, :c.shape[1]]
                label = squared_distances(x, c).argmin(axis=1)
                used = np.flatnonzero(t[:, 0])
                n, means, norms = t[used, 0], t[used, 3:] / t[used, 0][:, None], t[used, 2] / t[used, 0]
                place = np.searchsorted(used, label)
                own = ((x - means[place]) ** 2).sum(axis=1)
                s[:, 0] += np.bincount(label, np.sqrt(own), len(c))
                s[:, 1] += np.bincount(label, own, len(c))
                # mean squared distance to all rows of a cluster, from its mean and mean squared norm
                mean = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ means.T + norms, 0.0)
                at = np.arange(len(x))
                a = mean[at, place] * n[place] / np.maximum(n[place] - 1, 1)
                mean[at, place] = np.inf
                other = mean.min(axis=1) if len(used) > 1 else np.zeros(len(x))
                widest = np.maximum(a, other)
                value = np.where((n[place] <= 1) | (len(used) < 2) | (widest == 0), 0.0, (other - a) / np.where(widest == 0, 1.0, widest))
                s[:, 2] += np.bincount(label, value, len(c))
        for m, s in enumerate(spread):
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(s), pa.int32()), pa.array(np.arange(len(s)), pa.int32()), *[pa.array(s[:, i]) for i in range(3)]], ["model", "cluster", "distance", "within", "silhouette"])

    parts = points.mapInArrow(run, "model int, cluster int, distance double, within double, silhouette double")
    spread = {(r.model, r.cluster): r for r in parts.groupBy("model", "cluster").agg(F.sum("distance").alias("distance"), F.sum("within").alias("within"), F.sum("silhouette").alias("silhouette")).collect()}
    return [_figures(t, [spread[m, c] for c in range(len(t))]) for m, t in enumerate(tables)]


def _figures(table: np.ndarray, spread: list) -> dict[str, float]:
    used = np.flatnonzero(table[:, 0])
    n, means = table[used, 0], table[used, 3:] / table[used, 0][:, None]
    total, k = n.sum(), len(used)
    silhouette = sum(spread[c].silhouette for c in used) / total
    if k < 2:
        return {"n_clusters": k, "n": int(total), "davies_bouldin": float("nan"), "calinski_harabasz": float("nan"), "min_share": 1.0, "silhouette": float(silhouette)}
    distance, within = np.array([spread[c].distance for c in used]) / n, sum(spread[c].within for c in used)
    apart = np.sqrt(((means[:, None, :] - means[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    worst = ((distance[:, None] + distance[None, :]) / np.where(apart == 0, np.inf, apart)).max(axis=1)
    middle = (means * n[:, None]).sum(axis=0) / total
    between = float((n * ((means - middle) ** 2).sum(axis=1)).sum())
    ch = (between / (k - 1)) / (within / (total - k)) if within > 0 else 1.0
    return {"n_clusters": k, "n": int(total), "davies_bouldin": float(worst.mean()), "calinski_harabasz": float(ch), "min_share": float(n.min() / total), "silhouette": float(silhouette)}
