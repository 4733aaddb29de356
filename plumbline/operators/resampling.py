"""Fits that are repeated hundreds of times, all of them moving together over one table.

A repetition is a column of numbers that a row can state for itself: its weight in a resampling, its label in a
permutation. So a round of every repetition is one pass in which tasks add sums, and what reaches the driver
grows with the repetitions, classes and dimensions, never with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task works on at once.
CHUNK = 512
#: Centres that a round moves by no more than this are at rest: sums of the same rows differ in their last bits alone.
STILL = 1e-12
#: Numbers of a sum that travel together.
PART = 1 << 16
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def poisson_weights(key: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(rows, n) Poisson(1) numbers, the times that each row is drawn in each of n resamplings; they follow from the row's key."""
    which = mixed(np.arange(1, n + 1, dtype=np.uint64) + (_U(seed) << _U(32)))
    u = (mixed(key[:, None] ^ which[None]) >> _U(11)).astype(np.float64) / float(1 << 53)
    steps = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 18)]))
    return np.searchsorted(steps, u, side="right").astype(np.float64)


def permuted(at: np.ndarray, n: int, which: np.ndarray, seed: int) -> np.ndarray:
    """(rows, permutations): the places of 0..n-1 under seeded permutations, each stated by a four-round Feistel network.

    The network permutes the next power of four; places beyond n walk on until they are below it.
    """
    half = max(1, (int(max(n - 1, 1)).bit_length() + 1) // 2)
    low = _U((1 << half) - 1)
    keys = mixed(which.astype(np.uint64)[None] * _U(4) + np.arange(4, dtype=np.uint64)[:, None] + (_U(seed) << _U(40)))
    x = np.broadcast_to(at.astype(np.uint64)[:, None], (len(at), len(which))).copy()
    todo = np.ones(x.shape, bool)
    while todo.any():
        i, j = np.nonzero(todo)
        left, right = x[i, j] >> _U(half), x[i, j] & low
        for r in range(4):
            left, right = right, left ^ (mixed(right ^ keys[r, j]) & low)
        x[i, j] = (left << _U(half)) | right
        todo[i, j] = x[i, j] >= n
    return x.astype(np.int64)


def _matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, CHUNK):
            yield b.slice(i, CHUNK)


def summed(rows: DataFrame, columns: list[str], f: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what ``f(chunk)`` returns, a flat array of ``size`` numbers; parts of it are added apart, in order of task."""
    schema = "part int, task int, v binary"

    def out(part: int, task: int, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["part", "task", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(size), False
        for b in _chunks(batches):
            total += f(b)
            any_ = True
        for i in range(0, size if any_ else 0, PART):
            yield out(i // PART, TaskContext.get().partitionId(), total[i : i + PART])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, np.empty(0)
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if k != part and part is not None:
                    yield out(part, 0, total)
                total = np.frombuffer(v).copy() if k != part else total + np.frombuffer(v)
                part = k
        if part is not None:
            yield out(part, 0, total)

    parts = -(-size // PART)
    sums = rows.select(*columns).mapInArrow(run, schema).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "task").mapInArrow(add, schema)
    total = np.zeros(size)
    for r in sums.collect():  # ``size`` numbers
        total[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.v)
    return total


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared distances) of the nearest of each set's centres, both (rows, sets)."""
    r, k, d = centres.shape
    flat = centres.reshape(r * k, d)
    far = x @ (-2 * flat.T)
    far += (x * x).sum(axis=1)[:, None]
    far += (flat * flat).sum(axis=1)[None]
    far = np.maximum(far, 0, out=far).reshape(len(x), r, k)
    return far.argmin(axis=2), far.min(axis=2)


def weighted_kmeans(rows: DataFrame, starts: np.ndarray, repeats: int, n_boot: int, seed: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(centres, cost) of k-means from every start, ``repeats`` starts for each of ``n_boot`` resamplings of ``rows(key, x)``.

    With no resampling every row counts once.
    """
    r, k, d = starts.shape
    centres, cost = starts.copy(), np.full(r, np.inf)
    moving = np.arange(r)  # a set whose centres a round leaves as they are would stay so: it is done
    for _ in range(rounds):
        here, which = centres[moving], moving

        def sums(b: pa.RecordBatch) -> np.ndarray:
            x, m = _matrix(b, "x"), len(which)  # noqa: B023
            w = poisson_weights(b.column(0).to_numpy().view(np.uint64), n_boot, seed)[:, which // repeats] if n_boot else np.ones((len(x), m))  # noqa: B023
            at, far = _nearest(x, here)  # noqa: B023
            out, size = np.zeros((m, k, d)), np.zeros((m, k))
            for j in range(k):
                share = w * (at == j)
                out[:, j], size[:, j] = share.T @ x, share.sum(axis=0)
            return np.concatenate([out.ravel(), size.ravel(), (w * far).sum(axis=0)])

        m = len(moving)
        got = summed(rows, ["key", "x"], sums, m * k * d + m * k + m)
        total, size, cost[moving] = got[: m * k * d].reshape(m, k, d), got[m * k * d : m * k * (d + 1)].reshape(m, k), got[-m:]
        new = np.where(size[:, :, None] > 0, total / np.maximum(size, 1e-300)[:, :, None], here)
        centres[moving] = new
        if np.allclose(new, here, atol=1e-6):
            break
        moving = moving[np.abs(new - here).max(axis=(1, 2)) > STILL]
    return centres, cost


def cluster_tables(rows: DataFrame, reference: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(sets, k, k): rows by cluster of the reference centres and by cluster of each set's."""
    r, k, _ = centres.shape

    def count(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b, "x")
        mine, theirs = _nearest(x, reference[None])[0][:, 0], _nearest(x, centres)[0]
        cell = (np.arange(r)[None] * k + mine[:, None]) * k + theirs
        return np.bincount(cell.ravel(), minlength=r * k * k).astype(float)

    return summed(rows, ["x"], count, r * k * k).reshape(r, k, k)


@dataclass
class Design:
    """What a task needs to state labels and standardised features: arrays alone."""

    n: int
    sizes: list[int]
    n_perm: int
    seed: int
    folds: list[int]
    mean: list[np.ndarray]
    sd: list[np.ndarray]

    def labels(self, b: pa.RecordBatch) -> np.ndarray:
        """(rows, 1 + permutations) class codes, the real ones first."""
        place = permuted(b.column(0).to_numpy(), self.n, np.arange(1, self.n_perm + 1), self.seed)
        return np.concatenate([b.column(1).to_numpy()[:, None], np.searchsorted(np.cumsum(self.sizes), place, side="right")], axis=1)

    def features(self, b: pa.RecordBatch, f: int) -> np.ndarray:
        z = (_matrix(b, "x") - self.mean[f]) / self.sd[f]
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


class Logistic:
    """One-against-rest logistic fits out of fold, of the real labels and of permuted ones, by rounds over ``rows(at, code, fold, x)``.

    The real labels' fits take Newton steps. The permuted ones take steps by the curvature's bound, a quarter of the
    standardised products, which all permutations share; without signal it is nearly the curvature, so few rounds do.
    ``at`` numbers the rows 0..n-1; permutation p gives a row the label of its place under ``permuted``, so each keeps
    the classes' sizes. ``sums`` are the folds' products (``probes.fold_sums``).
    """

    COLUMNS = ["at", "code", "fold", "x"]

    def __init__(self, rows: DataFrame, sums: dict[int, np.ndarray], sizes: list[int], n_perm: int, seed: int, penalty: float = 1.0):
        self.rows, folds, d = rows, sorted(sums), len(next(iter(sums.values()))) - 2
        self.ridge, self.bound, mean, sd = np.diag([1.0 / penalty] * d + [1e-9]), [], [], []
        for f in folds:
            s = sum(v for g, v in sums.items() if g != f)
            n, m = s[-1, -1], s[:d, -1] / s[-1, -1]
            cov = s[:d, :d] / n - np.outer(m, m)
            dev = np.sqrt(np.maximum(np.diag(cov), 0))
            dev = np.where(dev > 1e-12, dev, 1.0)
            h = np.zeros((d + 1, d + 1))
            h[:-1, :-1], h[-1, -1] = n * cov / np.outer(dev, dev), n
            mean.append(m)
            sd.append(dev)
            self.bound.append(np.linalg.inv(h / 4 + self.ridge))
        self.design, self.shape = Design(sum(sizes), sizes, n_perm, seed, folds, mean, sd), (len(folds), n_perm + 1, len(sizes), d + 1)

    def fit(self, rounds: int = 25, close: float = 1e-4) -> np.ndarray:
        """Weights (folds, 1 + permutations, classes, dimension + 1)."""
        nf, p, k, d = self.shape
        w, design = np.zeros(self.shape), self.design
        for _ in range(rounds):
            here = w

            def slope(b: pa.RecordBatch) -> np.ndarray:
                hit = (design.labels(b)[:, :, None] == np.arange(k)).astype(float)
                grad, curve = np.zeros((nf, p, k, d)), np.zeros((nf, k, d, d))
                for f, number in enumerate(design.folds):
                    train = b.column(2).to_numpy() != number
                    z = design.features(b, f)[train]
                    s = _sigmoid(np.tensordot(z, here[f], axes=(1, 2)))  # noqa: B023
                    grad[f] = np.tensordot(hit[train] - s, z, axes=(0, 0))
                    for c in range(k):
                        curve[f, c] = (z * (s[:, 0, c] * (1 - s[:, 0, c]))[:, None]).T @ z
                return np.concatenate([grad.ravel(), curve.ravel()])

            got = summed(self.rows, self.COLUMNS, slope, nf * p * k * d + nf * k * d * d)
            grad, curve = got[: nf * p * k * d].reshape(self.shape), got[nf * p * k * d :].reshape(nf, k, d, d)
            step = np.einsum("fij,fpkj->fpki", np.array(self.bound), grad - w @ self.ridge)
            for f in range(nf):
                for c in range(k):
                    step[f, 0, c] = np.linalg.solve(curve[f, c] + self.ridge, grad[f, 0, c] - self.ridge @ w[f, 0, c])
            w = w + step
            if np.abs(step).max() < close:
                break
        return w

    def scored(self, w: np.ndarray) -> DataFrame:
        """(code, fold, s array): the real labels' scores of each row by the model of its fold."""
        design, k = self.design, self.shape[2]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _chunks(batches):
                out = np.zeros((b.num_rows, k))
                for f, number in enumerate(design.folds):
                    mine = b.column(2).to_numpy() == number
                    out[mine] = design.features(b, f)[mine] @ w[f, 0].T
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(out.tolist(), pa.list_(pa.float64()))], names=["code", "fold", "s"])

        return self.rows.select(*self.COLUMNS).mapInArrow(run, "code int, fold int, s array<double>")

    def null_areas(self, w: np.ndarray, bins: int = 1024) -> np.ndarray:
        """AUC (mean over classes) of each permutation, from counts in ``bins`` ranges of the probability; pairs in one range count half."""
        design, p, k = self.design, self.shape[1] - 1, self.shape[2]

        def count(b: pa.RecordBatch) -> np.ndarray:
            y, out = design.labels(b)[:, 1:], np.zeros(p * k * 2 * bins)
            for f, number in enumerate(design.folds):
                mine = b.column(2).to_numpy() == number
                s = _sigmoid(np.tensordot(design.features(b, f)[mine], w[f, 1:], axes=(1, 2)))
                hit = y[mine][:, :, None] == np.arange(k)
                cell = ((np.arange(p)[None, :, None] * k + np.arange(k)) * 2 + hit) * bins + np.minimum(s * bins, bins - 1).astype(np.int64)
                out += np.bincount(cell.ravel(), minlength=len(out))
            return out

        n = summed(self.rows, self.COLUMNS, count, p * k * 2 * bins).reshape(p, k, 2, bins)
        under = np.cumsum(n[:, :, 0], axis=2) - n[:, :, 0] / 2
        return ((n[:, :, 1] * under).sum(axis=2) / np.maximum(n[:, :, 1].sum(axis=2) * n[:, :, 0].sum(axis=2), 1)).mean(axis=1)
