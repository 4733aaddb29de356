"""Tiled all-pairs cosine and exact selection against the pair join, numpy and ``percentile``."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import embeddings as E
from plumbline.operators import tiles
from plumbline.operators.labels import quantile_edges
from plumbline.operators.quantiles import exact_quantiles


def frame(spark, groups, kind="float"):
    rows = [(g[0], g[1], i, i % 3, v) for g, vs in groups.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, f"layer int, pooling string, figure_id long, fold int, vec array<{kind}>").repartition(5)


@pytest.fixture(scope="module")
def vecs():
    r = np.random.default_rng(0)
    a = r.normal(size=(130, 8)).astype(np.float32)
    a[7] = 0
    a[11:15] = a[10]
    return {(1, "cls"): a.tolist(), (1, "mean_patch"): r.normal(size=(41, 5)).astype(np.float32).tolist(), (2, "cls"): [[1.0, 2.0]]}


def unit(v):
    v = np.array(v, float)
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(n == 0, 1, n)


def test_tiles_make_every_pair_once(spark, vecs):
    m = frame(spark, vecs)
    got = tiles.all_pairs(m, "figure_id", rows=16).collect()
    want = {(*g, i, j): c for g, v in vecs.items() for i, row in enumerate(unit(v) @ unit(v).T) for j, c in enumerate(row) if i < j}
    assert len(got) == len(want) and all(abs(want[r.layer, r.pooling, r.i, r.j] - r.cos) < 1e-12 for r in got)
    joined = E.pairwise_cosine(m.withColumn("vec", F.col("vec").cast("array<double>")), "figure_id").collect()
    assert {tuple(r)[:4] for r in joined} == {tuple(r)[:4] for r in got}


def test_blocks_are_bounded(spark, vecs):
    for rows, most in ((16, 16), (4096, 130)):
        b = tiles.blocks(frame(spark, vecs), "figure_id", rows=rows).collect()
        assert max(len(r.ids) for r in b) <= most and sum(len(r.ids) for r in b) == 172
        for r in b:
            assert len(r.data) == len(r.ids) * r.dim * 4 and 0 <= r.block < r.n_blocks
        ids = [i for r in sorted(b, key=lambda r: r.block) if (r.layer, r.pooling) == (1, "cls") for i in r.ids]
        assert ids == list(range(130))
    with pytest.raises(Exception, match="different lengths"):
        tiles.blocks(frame(spark, {(1, "cls"): [[1.0], [1.0, 2.0]]}), "figure_id").collect()


@pytest.mark.parametrize("most", [10**9, 50, 1])
def test_summary_of_all_pairs(spark, vecs, most):
    got = {(r.layer, r.pooling): r for r in tiles.cosine_summary(frame(spark, vecs), "figure_id", rows=16, most=most).collect()}
    assert set(got) == {(1, "cls"), (1, "mean_patch")}
    for g, r in got.items():
        u = unit(vecs[g])
        c = (u @ u.T)[np.triu_indices(len(u), 1)]
        want = [len(c), c.mean(), c.std(), *np.percentile(c, [5, 50, 95])]
        assert np.allclose([r.n_pairs, r.cos_mean, r.cos_std, r.cos_p05, r.cos_p50, r.cos_p95], want, rtol=0, atol=1e-12)


def test_summary_with_ties_nan_and_without_rows(spark):
    same = {(1, "cls"): [[1.0, 1.0]] * 30 + [[1.0, -1.0]] * 3, (2, "cls"): [[float("nan"), 1.0], [1.0, 1.0]], (3, "cls"): [None, [], [1.0]]}
    got = {r.layer: r for r in tiles.cosine_summary(frame(spark, same, "double"), "figure_id", rows=4, most=10).collect()}
    assert set(got) == {1, 2} and got[1].n_pairs == 528 and abs(got[1].cos_p50 - 1) < 1e-12 and abs(got[1].cos_p05) < 1e-12 and np.isnan(got[2].cos_p50)
    assert tiles.cosine_summary(frame(spark, same).limit(0), "figure_id").count() == 0


@pytest.mark.parametrize("apart", [None, "fold"])
def test_nearest_rows(spark, vecs, apart):
    got = {}
    for r in tiles.nearest(frame(spark, vecs), "figure_id", 4, apart=apart, rows=16).collect():
        got.setdefault((r.layer, r.pooling, r.id), []).append((r.rank, r.neighbour, r.cos))
    for g, v in vecs.items():
        c = np.round(unit(v) @ unit(v).T, 12)
        for i in range(len(v)):
            order = sorted((j for j in range(len(v)) if j != i and not (apart and j % 3 == i % 3)), key=lambda j: (-c[i, j], j))[:4]
            assert [(k, j) for k, j, _ in sorted(got.get((*g, i), []))] == [(k + 1, j) for k, j in enumerate(order)]


CASES = {
    "smooth": [((i * 7919) % 10007) / 13 for i in range(4000)],
    "ties": [1.0] * 1500 + [2.0] * 1500 + [3.0],
    "tails": [10.0 ** (i % 300) * (-1) ** i for i in range(3000)],
    "one": [5.0],
    "two": [float("-inf"), 4.0],
}


@pytest.mark.parametrize("most", [1_000_000, 40, 1])
def test_exact_quantiles_are_those_of_percentile(spark, most):
    probs = [0.0, 0.05, 1 / 3, 0.5, 0.9, 0.999, 1.0]
    rows = [(k, None if i % 11 == 3 else x) for k, xs in CASES.items() for i, x in enumerate(xs)] + [("none", None), (None, 1.0), (None, 9.0), ("smooth", float("nan"))]
    df = spark.createDataFrame(rows, "x string, low double").repartition(4)
    got = {r.x: r for r in exact_quantiles(df, "low", probs, ["x"], most).collect()}
    clean = df.filter(~F.isnan("low") | F.col("low").isNull())
    want = {r.x: r for r in clean.groupBy("x").agg(F.percentile("low", probs).alias("q"), F.count("low").alias("n")).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k].n_valid == w.n and got[k].quantiles == w.q, k


def test_exact_quantiles_without_groups(spark):
    df = spark.createDataFrame([(float(i % 50),) for i in range(5000)], "v double")
    for most in (1_000_000, 30):
        r = exact_quantiles(df, "v", [0.25, 0.5], most=most).collect()
        assert [tuple(x) for x in r] == [(5000, [12.0, 24.5])]
    assert [tuple(x) for x in exact_quantiles(df.limit(0), "v", [0.5]).collect()] == [(0, None)]
    assert tuple(quantile_edges(df, "v", 2).first()) == ([0.0, 24.5, 49.0], 5000)
    with pytest.raises(ValueError, match="probabilities"):
        exact_quantiles(df, "v", [1.5])


def test_no_task_sorts_more_than_a_range(spark):
    """What is left of 100,000 values for three ranks when ranges of more than 2,000 rows are narrowed."""
    from plumbline.operators import quantiles as Q

    df = spark.range(100_000).select(((F.col("id") * 7919) % 100_003).cast("double").alias("v"))
    seen = []
    inside = Q._inside
    Q._inside = lambda rows, ranges, g, hint: seen.append(inside(rows, ranges, g, hint)) or seen[-1]
    try:
        got = exact_quantiles(df, "v", [0.05, 0.5, 0.95], most=2000).first()
    finally:
        Q._inside = inside
    v = np.arange(100_000) * 7919 % 100_003
    assert np.allclose(got.quantiles, np.percentile(v, [5, 50, 95]))
    assert seen[-1].groupBy("low", "high").count().agg(F.max("count")).first()[0] <= 2000
