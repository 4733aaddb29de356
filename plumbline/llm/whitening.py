"""PCA whitening of embeddings from an exact integer scatter.

Entries become integers x = floor(scale * c) + offset. Tasks subtract one shift (the integers of some valid
row), and accumulate sums and cross-products of what is left without rounding: batches are split into 20-bit
limbs, whose products are exact in doubles, and carried into integers of any length. Spark adds the tasks' sums
limb by limb. The driver forms n XtX - S St exactly, only then divides to doubles and decomposes by eigh; what it
holds grows with the square of the dimension, not with the rows. The shift cancels, so any will do.

Rows whose vector is null, empty or holds null or non-finite entries are dropped; vectors of different lengths, or
entries whose x leaves 64 bits, raise an error. Repeated rows, and rows without an id, count and return as rows of
their own. Components of no variance (one row, constant or dependent dimensions) are not returned; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow

LIMB = 20
#: Rows whose products of limbs are added in doubles: 2^12 * 2^40 stays under 2^53.
ROWS = 1 << 12


def _view(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"))


def _integers(column: pa.ListArray, scale: float, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that stay, their x as a matrix)."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(size)), size)
    stays = (size > 0) & (np.bincount(row, ~np.isfinite(c), len(size)) == 0)
    if len(widths := np.unique(size[stays])) > 1:
        raise ValueError(f"vectors have different lengths: {widths.tolist()}")
    x = np.floor(scale * c[stays[row]])
    if len(x) and np.abs(x).max() >= 2.0**62:
        raise ValueError("an entry is too large for a 64-bit integer")
    return np.flatnonzero(stays), x.astype(np.int64).reshape(int(stays.sum()), int(widths[0]) if len(widths) else 0) + offset


class Scatter:
    """Exact n, sums and cross-products of integer rows less a shift."""

    def __init__(self, shift: np.ndarray):
        d = len(shift)
        self.n, self.shift = 0, shift
        self.sums, self.products = np.zeros(d, object), np.zeros((d, d), object)
        self._level: dict[int, np.ndarray] = {}
        self._adds = 0

    def add(self, x: np.ndarray) -> None:
        for i in range(0, len(x), ROWS):
            y = x[i : i + ROWS] - self.shift
            if ((x[i : i + ROWS] ^ self.shift) & (x[i : i + ROWS] ^ y) < 0).any():
                raise ValueError("an entry is too far from the shift for a 64-bit integer")
            self.n += len(y)
            limbs = []
            while True:  # low limbs are 0 to 2^20 - 1, the last one has the sign
                if not len(y) or np.abs(y).max() < 1 << LIMB:
                    limbs.append(y.astype(np.float64))
                    break
                limbs.append((y & ((1 << LIMB) - 1)).astype(np.float64))
                y = y >> LIMB
            for a, left in enumerate(limbs):
                self.sums += left.sum(axis=0).astype(np.int64).astype(object) * (1 << LIMB * a)
                for b, right in enumerate(limbs):
                    part = (left.T @ right).astype(np.int64)
                    self._level[a + b] = self._level[a + b] + part if a + b in self._level else part
                    self._adds += 1
            if self._adds >= 512:
                self.carry()

    def carry(self) -> None:
        for level, part in self._level.items():
            self.products += part.astype(object) * (1 << LIMB * level)
        self._level, self._adds = {}, 0


def _digits(v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, digits to base 2^32) of integers of any length; the last place keeps the sign."""
    place = 0
    while any(abs(int(x)) >> 62 for x in (v.max(), v.min())):
        yield place, (v & 0xFFFFFFFF).astype(np.int64)
        v, place = v >> 32, place + 1
    yield place, v.astype(np.int64)


@dataclass
class Model:
    scale: float
    offset: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def fit(df: DataFrame, scale: float = 64, offset: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> Model:
    """Components of all valid rows by falling eigenvalue of the covariance (divisor n)."""
    vecs = _view(df, id_col, vec_col).select("vec")
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    some = vecs.filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & finite).first()
    if some is None:
        return Model(scale, offset, 0, [], np.empty(0), np.empty((0, 0)), 0.0)
    shift = _integers(pa.array([some.vec], pa.list_(pa.float64())), scale, offset)[1][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_of = Scatter(shift)
        for b in batches:
            _, x = _integers(b.column(0), scale, offset)
            if len(x) and x.shape[1] != len(shift):
                raise ValueError(f"vectors have different lengths: {sorted((x.shape[1], len(shift)))}")
            all_of.add(x)
        all_of.carry()
        for i, v in [(-2, np.array([all_of.n], object)), (-1, all_of.sums), *((i, all_of.products[i, i:]) for i in range(len(shift)))]:
            for place, digit in _digits(v) if all_of.n else ():
                j = np.arange(len(digit), dtype=np.int32) + max(i, 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i, np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(j), place, np.int32)), pa.array(digit)], names=["i", "j", "place", "v"])

    parts = vecs.transform(arrow(run, "i int, j int, place int, v long"))
    n, d = 0, len(shift)
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    for i, j, place, v in parts.groupBy("i", "j", "place").agg(F.sum("v").alias("v")).collect():  # grows with the dimension alone
        if i == -2:
            n += v << 32 * place
        elif i == -1:
            sums[j] += v << 32 * place
        else:
            products[i, j] += v << 32 * place
    scatter = n * products - np.outer(sums, sums)
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = int(scatter[i, j]) / (n * n)  # correctly rounded
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    keep = e > max(e[0], 0) * d * np.finfo(float).eps
    u = u[:, keep] * np.sign(u[np.abs(u[:, keep]).argmax(axis=0), np.flatnonzero(keep)])  # the largest entry is positive
    trace = sum(int(scatter[i, i]) for i in range(d)) / (n * n)
    return Model(scale, offset, n, [int(s) + n * int(a) for s, a in zip(sums, shift)], e[keep], u, trace)


def whitened(df: DataFrame, model: Model, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened): x less the mean, projected on the first components over the root of their eigenvalues.

    deviation is the exact sum of (n x - S)^2 over dimensions, null beyond 38 digits.
    """
    n, k = model.n, min(components, len(model.values))
    whole = np.array([s // n for s in model.sums], np.int64) if n else np.empty(0, np.int64)
    rest = [s % n for s in model.sums] if n else []
    turn = model.vectors[:, :k] / np.sqrt(model.values[:k]) if k else np.empty((len(rest), 0))
    mean_rest = np.array([r / n for r in rest])
    square_rest = sum(r * r for r in rest)
    scale, offset = model.scale, model.offset

    def deviation(y: np.ndarray) -> list:
        # (n y - r)^2 summed is n^2 y.y - 2 n y.r + r.r, in 64 bits while the bound shows that they hold it.
        fits = not len(y) or int(np.abs(y).max()) * max(int(np.abs(y).max()), n) * y.shape[1] < 1 << 62
        z, r = (y, np.array(rest, np.int64)) if fits else (y.astype(object), np.array(rest, object))
        made = (n * n * int(a) - 2 * n * int(b) + square_rest for a, b in zip((z * z).sum(axis=1), (z * r).sum(axis=1)))
        return [decimal.Decimal(v) if v < 10**38 else None for v in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _integers(b.column(1), scale, offset)
            if not len(x):
                continue
            y = x - whole
            w = (y - mean_rest) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(deviation(y), pa.decimal128(38, 0)), lists], names=["vec_id", "deviation", "whitened"])

    return _view(df, id_col, vec_col).transform(arrow(run, f"vec_id {df.schema[id_col].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"))


def identity_error(white: DataFrame) -> float | None:
    """Largest absolute entry of the covariance of all ``whitened`` rows less the identity, measured on the rows.

    They are centred already, by the exact mean; tasks add doubles, and what reaches the driver grows with the components alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            w = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            n, s, g = n + len(w), w.sum(axis=0) + (0 if s is None else s), w.T @ w + (0 if g is None else g)
        if n:
            k = len(s)
            i, j = np.indices((k, k), np.int32).reshape(2, -1)
            both = [np.append(i, [-1] * k + [-2]), np.append(j, [*range(k), 0]), np.concatenate([g.ravel(), s, [n]])]
            yield pa.RecordBatch.from_arrays([pa.array(both[0].astype(np.int32)), pa.array(both[1].astype(np.int32)), pa.array(both[2])], names=["i", "j", "v"])

    cells = white.select("whitened").transform(arrow(run, "i int, j int, v double")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    at = {(r.i, r.j): r.v for r in cells}
    n = at.pop((-2, 0), 0)
    mean = {j: v / n for (i, j), v in at.items() if i == -1}
    return max((abs(v / n - mean[i] * mean[j] - (i == j)) for (i, j), v in at.items() if i >= 0), default=None)
