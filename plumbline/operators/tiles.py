"""All-pairs cosine of whole matrices by tiles (J8, A15, V8 and the neighbour searches that rest on them).

Rows are packed into blocks of bounded size, in order of their id. Each block is sent to every other one of its
matrix, so a row of the tile table holds two blocks, and a task makes one matrix product of them, a stripe at a
time. What leaves a tile is what is asked for: every pair, counts and moments, or the nearest rows of each row;
statistics of n rows never make the n^2 / 2 pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.embeddings import KEYS
from plumbline.session import cut, join_null_safe, written

#: Rows of a block where few blocks do, bytes of its vectors at most, and numbers of a product made at once.
ROWS, BYTES, STRIPE = 4096, 32 << 20, 1 << 20
#: Blocks that a table is cut into, about: each is sent to every other, so as long as BYTES allow it what is moved grows with the rows.
GROUPS = 24
BINS = 1 << 14
#: Rows of both sides of a part of a tile whose product stays in a core's cache, and rows that propose where percentiles lie.
SIDE, PILOT = 256, 2048
#: Blocks whose results a task holds while their tiles pass; more are written before their end, and met again after.
HELD = 8
#: Values of one counted range that are sorted; ranges with more are counted again in finer ones.
RANGE = 500_000


def blocks(m: DataFrame, id_col: str, vec: str = "vec", extra: str | None = None, rows: int | None = None) -> DataFrame:
    """(layer, pooling, block, n_blocks, ids, extras, dim, data): rows in order of id, at most ``rows`` and BYTES a block.

    Without ``rows`` a block has ROWS of them or a share of GROUPS, whichever is more.

    Rows without a vector or with an empty one are left out. ``extra`` is a column of integers that goes along, or
    None. Vectors of a matrix must have one length.
    """
    wide = "float" if dict(m.dtypes)[vec] == "array<float>" else "double"
    own = (F.col(extra) if extra else F.lit(0)).cast("long").alias("extra")
    flat = m.filter(F.size(vec) > 0).select(*[F.col(k).alias(k) for k in KEYS], F.col(id_col).alias("id"), own, F.col(vec).cast(f"array<{wide}>").alias("v"))
    kind = flat.schema["id"].dataType.simpleString()
    total = flat.count()
    rows = rows or max(ROWS, -(-total // GROUPS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, seq = None, [], 0, 0

        def out() -> pa.RecordBatch:
            nonlocal seq
            ids, extras, data = pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held])
            cols = [pa.array([x]) for x in (key[0], key[1], seq, data.shape[1])]
            cols[0], cols[2], cols[3] = (cols[i].cast(t) for i, t in ((0, pa.int32()), (2, pa.int64()), (3, pa.int32())))
            one = pa.array([0, len(ids)], pa.int32())
            seq += 1
            return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, extras), pa.array([data.tobytes()], pa.binary())], names=["layer", "pooling", "seq", "dim", "ids", "extras", "data"])

        for b in batches:
            if not b.num_rows:
                continue
            layer, pooling = b.column(0).to_pylist(), b.column(1).to_pylist()
            edge = [0, *(i for i in range(1, b.num_rows) if (layer[i], pooling[i]) != (layer[i - 1], pooling[i - 1])), b.num_rows]
            for a, z in zip(edge, edge[1:]):
                if key != (layer[a], pooling[a]) and held:
                    yield out()
                    held, size = [], 0
                key = (layer[a], pooling[a])
                lists = b.column(4).slice(a, z - a)
                dims = {*pc.unique(pc.list_value_length(lists)).to_pylist(), *([held[0][2].shape[1]] if held else [])}
                if len(dims) > 1:
                    raise ValueError(f"vectors of a matrix have different lengths: {sorted(dims)}")
                x = lists.flatten().to_numpy(zero_copy_only=False).reshape(z - a, -1)
                most = max(1, min(rows, BYTES // max(8 * x.shape[1], 1)))
                at = 0
                while at < len(x):
                    n = min(most - size, len(x) - at)
                    held.append((b.column(2).slice(a + at, n), b.column(3).slice(a + at, n), x[at : at + n]))
                    size, at = size + n, at + n
                    if size == most:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    order = [*KEYS, "id"]
    parts = max(1, -(-total // (4 * rows)))  # a part fills some blocks, and has one at most that is not full a matrix
    packed = flat.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, f"layer int, pooling string, seq long, dim int, ids array<{kind}>, extras array<long>, data binary")
    packed = cut(packed.withColumn("part", F.spark_partition_id()).withColumn("single", F.lit(wide == "float")))
    # One row a block: its place among the blocks of its matrix, which is the order of ids.
    names = packed.select(*KEYS, "part", "seq").distinct().withColumn("block", F.row_number().over(Window.partitionBy(*KEYS).orderBy("part", "seq")) - 1)
    names = names.withColumn("n_blocks", F.count("*").over(Window.partitionBy(*KEYS)))
    return join_null_safe(packed, names, [*KEYS, "part", "seq"]).drop("part", "seq")


def tiles(packed: DataFrame) -> DataFrame:
    """One row a pair of blocks of a matrix, ``lo`` not after ``hi``, with both sides' rows."""

    def side(s: str, own: str, other: str, others) -> DataFrame:
        cols = [F.col(c).alias(f"{c}_{s}") for c in ("ids", "extras", "data")]
        return packed.select(*KEYS, "dim", "single", F.col("block").alias(own), F.explode(others).alias(other), *cols)

    a = side("a", "lo", "hi", F.sequence(F.col("block"), F.col("n_blocks").cast("int") - 1))
    b = side("b", "hi", "lo", F.sequence(F.lit(0), F.col("block"))).drop("dim", "single")
    return join_null_safe(a, b, [*KEYS, "lo", "hi"])


def row_tiles(packed: DataFrame) -> DataFrame:
    """One row a block ``lo`` and a block ``hi`` of its matrix, itself included; a block's rows lie together, so a task can
    add up a block over all others and write it once."""
    name = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("ids", "extras", "data")]
    a = packed.select(*KEYS, "dim", "single", F.col("block").alias("lo"), *name("a"))
    b = packed.select(*KEYS, F.col("block").alias("hi"), F.explode(F.sequence(F.lit(0), F.col("n_blocks").cast("int") - 1)).alias("lo"), *name("b"))
    return join_null_safe(b, a, [*KEYS, "lo"])


def _rows(t: dict, side: str) -> np.ndarray:
    return np.frombuffer(t[f"data_{side}"], np.float32 if t["single"] else np.float64).reshape(-1, t["dim"]).astype(np.float64)


def _unit(t: dict, side: str) -> np.ndarray:
    v = _rows(t, side)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm == 0, 1.0, norm)


def stripes(t: dict) -> Iterator[tuple[int, np.ndarray]]:
    """(first row of a, cosines of the next rows of a with all of b)."""
    a = _unit(t, "a")
    b = a if t["lo"] == t["hi"] else _unit(t, "b")
    step = max(1, STRIPE // max(len(b), 1))
    for i in range(0, len(a), step):
        yield i, a[i : i + step] @ b.T


def distances(t: dict) -> Iterator[tuple[int, np.ndarray]]:
    """``stripes`` of Euclidean distances; a row's distance to itself is zero."""
    a = _rows(t, "a")
    b = a if t["lo"] == t["hi"] else _rows(t, "b")
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    step = max(1, STRIPE // max(len(b), 1))
    for i in range(0, len(a), step):
        d = np.sqrt(np.maximum(aa[i : i + step, None] + bb[None] - 2 * (a[i : i + step] @ b.T), 0))
        if t["lo"] == t["hi"]:
            d[np.arange(len(d)), np.arange(i, i + len(d))] = 0
        yield i, d


def upper(t: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Stripes with a mask of the pairs to count: all, or on the diagonal those after the row."""
    for i, c in stripes(t):
        yield i, c, np.ones(c.shape, bool) if t["lo"] < t["hi"] else np.arange(c.shape[1])[None] > np.arange(i, i + len(c))[:, None]


def on_tiles(tiled: DataFrame, f: Callable[[Iterator[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``f`` over the tiles of a task, one at a time; what it adds up over them is written once a task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                t = {n: one.column(k)[0].as_py() for k, n in enumerate(one.schema.names) if not n.startswith(("ids", "extras"))}
                yield t | {n: one.column(k).flatten() for k, n in enumerate(one.schema.names) if n.startswith(("ids", "extras"))}

    return tiled.mapInArrow(lambda batches: f(each(batches)), schema)


def _keyed(t: dict, n: int, /, **cols) -> pa.RecordBatch:
    first = {"layer": pa.array([t["layer"]] * n, pa.int32()), "pooling": pa.array([t["pooling"]] * n, pa.string())}
    return pa.RecordBatch.from_pydict(first | {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in cols.items()})


def all_pairs(m: DataFrame, id_col: str, vec: str = "vec", rows: int | None = None) -> DataFrame:
    """(layer, pooling, i, j, cos), i before j, of every pair; a stripe of a tile at a time."""

    def pairs(some: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for t in some:
            for at, c, use in upper(t):
                i, j = np.nonzero(use)
                yield _keyed(t, len(i), i=t["ids_a"].take(pa.array(i + at)), j=t["ids_b"].take(pa.array(j)), cos=c[use])

    kind = m.schema[id_col].dataType.simpleString()
    return on_tiles(tiles(blocks(m, id_col, vec, rows=rows)), pairs, f"layer int, pooling string, i {kind}, j {kind}, cos double")


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    at = (n - 1) * p
    return int(np.floor(at)), int(np.ceil(at)), at


def parts(t: dict) -> Iterator[np.ndarray]:
    """The cosines of a tile's pairs, each pair once, flat and a part at a time; the next part is written over it."""
    a = _unit(t, "a")
    same = t["lo"] == t["hi"]
    b = a if same else _unit(t, "b")
    room = np.empty(SIDE * SIDE)
    for i in range(0, len(a), SIDE):
        left = a[i : i + SIDE]
        for j in range(i if same else 0, len(b), SIDE):
            right = b[j : j + SIDE]
            c = np.matmul(left, right.T, out=room[: len(left) * len(right)].reshape(len(left), len(right)))
            x = c[np.triu_indices(len(c), 1)] if same and i == j else c.reshape(-1)
            if len(x):
                yield x


#: All cosines lie between these, whatever the rounding.
LEAST, MOST = -1.0 - 1e-9, 1.0 + 1e-9
#: Ranges this narrow are not cut again: their finer ones would be narrower than what tells numbers near 1 apart.
FINEST = 1e-11


def proposed(packed: DataFrame, probs: tuple[float, ...]) -> dict[tuple, list[tuple[float, float]]]:
    """For each matrix a range a percentile in which it likely lies, by the pairs of about PILOT rows; counts of all pairs decide."""

    def some_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                v = _rows({"data_a": r["data"], "single": r["single"], "dim": r["dim"]}, "a")
                k = min(len(v), -(-PILOT // r["n_blocks"]))
                v = v[np.arange(k) * len(v) // k]
                yield _keyed(r, 1, dim=pa.array([r["dim"]], pa.int32()), data=pa.array([v.tobytes()], pa.binary()))

    def propose(rows_: pa.Table) -> pa.Table:
        t = {"layer": rows_["layer"][0].as_py(), "pooling": rows_["pooling"][0].as_py()}
        u = _unit({"data_a": b"".join(rows_["data"].to_pylist()), "single": False, "dim": rows_["dim"][0].as_py()}, "a")
        n, out = len(u), []
        c = u @ u.T
        x = np.sort(c[np.triu_indices(n, 1)])
        for p in probs:
            lo, hi = LEAST, MOST
            if n >= 64 and np.isfinite(x).all():
                # The pairs of a row vary together, so the error of a rank is that of a mean over rows.
                slack = 12 * (c < x[int(p * (len(x) - 1))]).mean(axis=1).std() / np.sqrt(n) + 4 / n
                at = [int(np.floor((p + s * slack) * (len(x) - 1))) for s in (-1, 1)]
                lo = x[at[0]] - 1e-9 if at[0] > 0 else LEAST
                hi = x[at[1]] + 1e-9 if at[1] < len(x) - 1 else MOST
            out.append((lo, hi))
        return pa.Table.from_batches([_keyed(t, len(out), k=pa.array(range(len(out)), pa.int32()), lo=[float(r[0]) for r in out], hi=[float(r[1]) for r in out])])

    few = packed.select(*KEYS, "n_blocks", "single", "dim", "data").mapInArrow(some_rows, "layer int, pooling string, dim int, data binary")
    got = few.groupBy(*KEYS).applyInArrow(propose, "layer int, pooling string, k int, lo double, hi double")
    out: dict = {}
    for r in sorted(got.collect(), key=lambda r: r.k):  # a row a matrix and percentile
        out.setdefault((r.layer, r.pooling), []).append((r.lo, r.hi))
    return out


def cosine_summary(m: DataFrame, id_col: str, vec: str = "vec", probs: tuple[float, ...] = (0.05, 0.5, 0.95), rows: int | None = None, most: int = RANGE) -> DataFrame:
    """A15 over every pair: (layer, pooling, n_pairs, cos_mean, cos_std, cos_pXX ...), population deviation, exact interpolated percentiles.

    The pairs of some rows propose a range for each percentile. A pass over all pairs finds the moments, counts what lies
    below each range and counts the range itself in finer ones; the fine range that holds a wanted rank, or what is left
    beside a range that missed it, is counted again while it has more than ``most`` values. A last pass writes and sorts
    only the values of those. Matrices of under two rows have no row; a vector with NaN or infinities makes its matrix's
    results NaN.
    """
    spark = m.sparkSession
    packed = blocks(m, id_col, vec, rows=rows)
    tiled = tiles(packed).drop("ids_a", "ids_b", "extras_a", "extras_b")

    def edges(lo: float, hi: float) -> np.ndarray:
        return np.append(lo + np.arange(BINS) * ((hi - lo) / BINS), hi)

    def counts_of(ranges: dict, moments: bool) -> DataFrame:
        """(k, bin, n) of the ranges by their place, bin -1 for what lies below; without k the count, mean and squares of a tile."""

        def counts(some: Iterator[dict]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, list] = {}  # matrix and range: counts, values not yet counted

            def settle(total: np.ndarray, wait: list, lo: float, hi: float) -> None:
                if wait:
                    x, edge = np.concatenate(wait), edges(lo, hi)
                    b = np.minimum((x - lo) / (hi - lo) * BINS, BINS - 1).astype(np.int64)
                    b += x >= edge[b + 1]  # the edges decide, not the rounding of the division
                    b -= x < edge[b]
                    total[1:] += np.bincount(b, minlength=BINS)
                    wait.clear()

            def out() -> Iterator[pa.RecordBatch]:
                for (layer, pooling, k), (total, wait, lo, hi) in held.items():
                    settle(total, wait, lo, hi)
                    at = np.flatnonzero(total)
                    none = pa.nulls(len(at), pa.float64())
                    yield _keyed({"layer": layer, "pooling": pooling}, len(at), k=pa.array([k] * len(at), pa.int32()), bin=at - 1, n=total[at], mean=none, m2=none)
                held.clear()

            for t in some:
                own = [held.setdefault((t["layer"], t["pooling"], k), [np.zeros(BINS + 1, np.int64), [], lo, hi]) for k, (lo, hi) in enumerate(ranges.get((t["layer"], t["pooling"]), ()))]
                n, mean, m2, waiting = 0, 0.0, 0.0, 0
                for x in parts(t):
                    if moments:
                        new, k = x.mean(), len(x)
                        off = x - new
                        d, m2 = new - mean, m2 + np.dot(off, off)
                        m2 += d * d * n * k / (n + k)
                        mean, n = mean + d * k / (n + k), n + k
                    for total, wait, lo, hi in own:
                        below = x < lo
                        total[0] += np.count_nonzero(below)
                        at = np.flatnonzero((x < hi) ^ below)
                        if len(at):
                            wait.append(x[at])
                            waiting += len(at)
                    if waiting > STRIPE:
                        for h in own:
                            settle(*h)
                        waiting = 0
                for h in own:
                    settle(*h)
                if moments and n:
                    yield _keyed(t, 1, k=pa.nulls(1, pa.int32()), bin=pa.nulls(1, pa.int64()), n=[n], mean=[float(mean)], m2=[float(m2)])
                if len(held) > 64:
                    yield from out()
            yield from out()

        return on_tiles(tiled, counts, "layer int, pooling string, k int, bin long, n long, mean double, m2 double")

    def by_range(counted: DataFrame) -> dict:
        out: dict = {}
        for r in counted.filter("k is not null").groupBy(*KEYS, "k", "bin").agg(F.sum("n").alias("n")).collect():  # BINS a range
            out.setdefault((r.layer, r.pooling, r.k), []).append((r.bin, r.n))
        return {k: sorted(v) for k, v in out.items()}

    def narrowed(rank: int, lo: float, hi: float, fine: list, n_pairs: int) -> tuple:
        """The range of a rank after a count: (low, high, values below, values), the highest range of all closed."""
        upto = 0
        for b, n in fine:
            if rank < upto + n:
                e = edges(lo, hi)
                return (LEAST, lo, 0, n) if b < 0 else (float(e[b]), float(e[b + 1]), upto, n)
            upto += n
        return hi, MOST, upto, n_pairs - upto

    first = proposed(packed, probs)
    with written(counts_of(first, True)) as counted:
        each = counted.filter("k is null").select(*KEYS, "n", "mean", "m2")
        whole = each.groupBy(*KEYS).agg(F.sum("n").alias("n_pairs"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("cos_mean"))
        spread = F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("cos_mean"), F.lit(2)))
        stats = join_null_safe(each, whole, KEYS).groupBy(*KEYS, "n_pairs", "cos_mean").agg(spread.alias("m2")).collect()  # one row a matrix
        fine = by_range(counted)

    # Ranges by matrix and rank; two ranks a percentile, both in it or beside it.
    state = {}
    for r in stats:
        for k, p in enumerate(probs if np.isfinite(r.cos_mean) else ()):
            for rank in _ranks(r.n_pairs, p)[:2]:
                state[r.layer, r.pooling, rank] = narrowed(rank, *first[r.layer, r.pooling][k], fine.get((r.layer, r.pooling, k), []), r.n_pairs)
    n_pairs = {(r.layer, r.pooling): r.n_pairs for r in stats}

    def ranges_of(some: dict) -> dict:
        by: dict = {}
        for (layer, pooling, _), (lo, hi, _, _) in some.items():
            by.setdefault((layer, pooling), set()).add((lo, hi))
        return {k: sorted(v) for k, v in by.items()}

    while True:
        wide = {k: v for k, v in state.items() if v[3] > most and v[1] - v[0] > FINEST}
        if not wide:
            break
        ranges = ranges_of(wide)
        fine = by_range(counts_of(ranges, False))
        for (layer, pooling, rank), (lo, hi, _, _) in wide.items():
            k = ranges[layer, pooling].index((lo, hi))
            state[layer, pooling, rank] = narrowed(rank, lo, hi, fine[layer, pooling, k], n_pairs[layer, pooling])

    ranges = ranges_of(state)

    def values(some: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for t in some:
            own = [(k, lo, hi, []) for k, (lo, hi) in enumerate(ranges.get((t["layer"], t["pooling"]), ()))]

            def out(t: dict = t, own: list = own) -> Iterator[pa.RecordBatch]:
                for k, _, _, wait in own:
                    if wait:
                        x, n = np.unique(np.concatenate(wait), return_counts=True)
                        yield _keyed(t, len(x), k=pa.array([k] * len(x), pa.int32()), x=x, n=n)
                        wait.clear()

            waiting = 0
            for c in parts(t) if own else ():
                for _, lo, hi, wait in own:
                    at = np.flatnonzero((c >= lo) & (c < hi))
                    if len(at):
                        wait.append(c[at])
                        waiting += len(at)
                if waiting > STRIPE:
                    yield from out()
                    waiting = 0
            yield from out()

    seen = on_tiles(tiled, values, "layer int, pooling string, k int, x double, n long").groupBy(*KEYS, "k", "x").agg(F.sum("n").alias("n"))
    seen = seen.withColumn("upto", F.sum("n").over(Window.partitionBy(*KEYS, "k").orderBy("x")))
    asked = [(layer, pooling, rank, ranges[layer, pooling].index((lo, hi)), rank - below) for (layer, pooling, rank), (lo, hi, below, _) in state.items()]
    asked = spark.createDataFrame(asked, "layer int, pooling string, rank long, k int, place long")
    hit = join_null_safe(seen, F.broadcast(asked), [*KEYS, "k"], where=(F.col("upto") > F.col("place")) & (F.col("upto") - F.col("n") <= F.col("place")))  # a few rows a matrix
    found = {(r.layer, r.pooling, r.rank): r.x for r in hit.select(*KEYS, "rank", "x").collect()} if state else {}
    out = []
    for r in stats:
        ps = []
        for p in probs:
            lo, hi, at = _ranks(r.n_pairs, p)
            a, b = found.get((r.layer, r.pooling, lo), float("nan")), found.get((r.layer, r.pooling, hi), float("nan"))
            ps.append(a if lo == hi else (hi - at) * a + (at - lo) * b)
        out.append((r.layer, r.pooling, r.n_pairs, r.cos_mean, float(np.sqrt(r.m2 / r.n_pairs)), *map(float, ps)))
    return spark.createDataFrame(out, "layer int, pooling string, n_pairs long, cos_mean double, cos_std double, " + ", ".join(f"cos_p{round(100 * p):02d} double" for p in probs))


def _top(c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest of each row with their columns, ties by column; rows with fewer are filled up with -inf."""
    n, wide = c.shape
    least = np.partition(c, max(wide - k, 0), axis=1)[:, max(wide - k, 0)]
    i, j = np.nonzero(c >= least[:, None])
    x = c[i, j]
    o = np.lexsort((j, -x, i))
    place = np.arange(len(i)) - np.searchsorted(i[o], np.arange(n))[i[o]]
    o, place = o[place < k], place[place < k]
    best, at = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
    best[i[o], place], at[i[o], place] = x[o], j[o]
    return best, at


def nearest(m: DataFrame, id_col: str, k: int, vec: str = "vec", apart: str | None = None, rows: int | None = None) -> DataFrame:
    """(layer, pooling, id, rank, neighbour, cos): the k rows most like each row, ties at 12 decimals by id; a row with NaN has none.

    With ``apart``, a column of integers such as a fold, neighbours come from rows of another value only.
    """

    def best(some: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}  # a block's rows: cosines, places and ids of the best so far

        def out() -> Iterator[pa.RecordBatch]:
            for (layer, pooling, _), (ids, x, _, near) in held.items():
                i, r = np.nonzero(x > -np.inf)
                yield _keyed({"layer": layer, "pooling": pooling}, len(i), id=ids.take(pa.array(i)), neighbour=pa.array(near[i, r], ids.type), cos=x[i, r])
            held.clear()

        for t in some:
            key = (t["layer"], t["pooling"], t["lo"])
            if key not in held:
                if len(held) >= HELD:
                    yield from out()
                n = len(t["ids_a"])
                held[key] = [t["ids_a"], np.full((n, k), -np.inf), np.zeros((n, k), np.int64), np.empty((n, k), object)]
            _, x, place, near = held[key]
            ids_b, (ea, eb) = t["ids_b"].to_numpy(zero_copy_only=False), (t[f"extras_{s}"].to_numpy(zero_copy_only=False) for s in "ab")
            for at, c in stripes(t):
                c = np.where(np.isnan(c), -np.inf, np.round(c, 12) + 0.0)
                rows_ = slice(at, at + len(c))
                if apart:
                    c[ea[rows_, None] == eb[None]] = -np.inf
                if t["lo"] == t["hi"]:
                    c[np.arange(len(c)), np.arange(at, at + len(c))] = -np.inf
                x_new, j = _top(c, k)
                both = [np.concatenate(z, axis=1) for z in ((x[rows_], x_new), (place[rows_], (t["hi"] << 32) + j), (near[rows_], ids_b[j]))]
                o = np.argsort(both[1], axis=1, kind="stable")  # places are in the order of ids
                o = np.take_along_axis(o, np.argsort(-np.take_along_axis(both[0], o, axis=1), axis=1, kind="stable"), axis=1)[:, :k]
                x[rows_], place[rows_], near[rows_] = (np.take_along_axis(z, o, axis=1) for z in both)
        yield from out()

    kind = m.schema[id_col].dataType.simpleString()
    found = on_tiles(row_tiles(blocks(m, id_col, vec, apart, rows)), best, f"layer int, pooling string, id {kind}, neighbour {kind}, cos double")
    order = Window.partitionBy(*KEYS, "id").orderBy(F.desc("cos"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*KEYS, "id", "rank", "neighbour", "cos")


def class_distances(m: DataFrame, id_col: str, label: str, vec: str = "vec", rows: int | None = None) -> DataFrame:
    """(layer, pooling, id, label, total): the sum of each row's Euclidean distances to all rows of each class.

    ``label`` is a column of integers. A block's sums are added up over the tiles of its task, so what is shuffled is a
    row and class, never a pair.
    """

    def sums(some: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[pa.Array, dict]] = {}  # a block's rows: the sum by class

        def out() -> Iterator[pa.RecordBatch]:
            for (layer, pooling, _), (ids, by) in held.items():
                for c, total in by.items():
                    yield _keyed({"layer": layer, "pooling": pooling}, len(ids), id=ids, label=np.full(len(ids), c), total=total)
            held.clear()

        for t in some:
            key = (t["layer"], t["pooling"], t["lo"])
            if key not in held:
                if len(held) >= HELD:
                    yield from out()
                held[key] = (t["ids_a"], {})
            classes, code = np.unique(t["extras_b"].to_numpy(zero_copy_only=False), return_inverse=True)
            of_b, by = np.eye(len(classes))[code], held[key][1]
            for at, d in distances(t):
                for c, x in zip(classes, (d @ of_b).T):
                    by.setdefault(int(c), np.zeros(len(t["ids_a"])))[at : at + len(d)] += x
        yield from out()

    kind = m.schema[id_col].dataType.simpleString()
    found = on_tiles(row_tiles(blocks(m, id_col, vec, label, rows)), sums, f"layer int, pooling string, id {kind}, label long, total double")
    return found.groupBy(*KEYS, "id", "label").agg(F.sum("total").alias("total"))
