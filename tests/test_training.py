"""The contrastive head: gradients against finite differences, frozen blocks, resumed runs, and the loss against the pair join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import pairs as P
from plumbline.operators import training as T


def head(dim=5, blocks=3, seed=1):
    r = np.random.default_rng(seed)
    return {k: v + 0.3 * r.normal(size=v.shape) for k, v in T.new_head(dim, blocks).items()}


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(2)
    made = [(i, i % 3, f"s{i % 4}", (r.normal(size=5) + 2 * np.eye(5)[i % 3]).tolist()) for i in range(107)]
    return spark.createDataFrame(made, "i long, y int, style string, v array<double>").repartition(4).cache()


def pairs_of(rows):
    def of(epoch):
        got = P.sampled_partner(rows, "i", "y", "style", 42, epoch)
        a = got.join(rows.select(F.col("i").alias("anchor"), F.col("v").alias("a")), "anchor")
        return a.join(rows.select(F.col("i").alias("partner"), F.col("v").alias("b")), "partner").select("anchor", "a", "b")

    return of


def test_gradient_against_finite_differences():
    r, params = np.random.default_rng(0), head()
    a, b = r.normal(size=(2, 6, 5))
    names = T.trainable(params, 3)
    loss, grad = T.loss_and_gradient(params, names, a, b, 0.2)
    for k in names:
        for at in np.ndindex(params[k].shape):
            near = []
            for step in (1e-6, -1e-6):
                moved = {n: v.copy() for n, v in params.items()}
                moved[k][at] += step
                near.append(T.loss_and_gradient(moved, [], a, b, 0.2)[0])
            assert grad[k][at] == pytest.approx((near[0] - near[1]) / 2e-6, rel=1e-4, abs=1e-6), (k, at)


def test_loss_is_that_of_the_pair_join(spark):
    r, params = np.random.default_rng(3), head()
    a, b = r.normal(size=(2, 7, 5))
    z = T.forward(params, np.concatenate([a, b]))[0]
    df = spark.createDataFrame([(0, i, z[i].tolist(), z[i + 7].tolist()) for i in range(7)], "batch int, p int, a array<double>, b array<double>")
    assert P.nt_xent(df, "batch", "a", "b", "p", 0.2).first().loss == pytest.approx(T.loss_and_gradient(params, [], a, b, 0.2)[0])


def test_trainable_parameters():
    params = head()
    assert T.trainable(params, 0) == ["norm.gain", "norm.shift"] and T.trainable(params, 1) == ["block2.b", "block2.v", "block2.w", "norm.gain", "norm.shift"]
    assert len(T.trainable(params, 3)) == 11
    for n in (4, -1):
        with pytest.raises(ValueError, match="the head has 3"):
            T.trainable(params, n)


def test_adamw_step_by_hand():
    opt, params = T.AdamW(rate=0.1, decay=0.5), {"x": np.array([2.0])}
    opt.step(params, {"x": np.array([4.0])})
    assert params["x"][0] == pytest.approx(2 * 0.95 - 0.1)  # the first step moves by the rate, whatever the gradient
    opt.step(params, {"x": np.array([0.0])})
    m, v = 0.9 * 0.4 / (1 - 0.81), 0.999 * 0.016 / (1 - 0.999**2)
    assert params["x"][0] == pytest.approx(1.8 * 0.95 - 0.1 * m / np.sqrt(v))


def test_batches_are_whole_seeded_and_other_each_epoch(spark, rows):
    of = pairs_of(rows)
    got = [[sorted(map(tuple, T.batches_of(of(1), 20, 7, e)[0].select("batch", "place").collect())) for _ in range(2)] for e in (1, 2)]
    assert all(x == y and len(x) == 100 for x, y in got)
    members = lambda e: {tuple(r.a): r.batch for r in T.batches_of(of(1), 20, 7, e)[0].collect()}
    assert members(1) == members(1) != members(2) and T.batches_of(of(1), 200, 7, 1)[1] == 0


def test_gradients_are_those_of_one_process(spark, rows):
    params, of = head(), pairs_of(rows)
    names = T.trainable(params, 2)
    b, n = T.batches_of(of(1), 3, 7, 1)
    b = b.cache()
    loss, k, flat = T.gradients(b, params, names, 0.2, 1, n)  # 34 batches: two levels of the tree
    want, total = np.zeros_like(flat), 0.0
    kept = sorted(b.collect(), key=lambda r: r.place)
    for i in range(1, n):
        part = [r for r in kept if r.batch == i]
        x, g = T.loss_and_gradient(params, names, np.array([r.a for r in part]), np.array([r.b for r in part]), 0.2)
        want, total = want + np.concatenate([g[m].ravel() for m in names]), total + x
    assert k == n - 1 == 34 and loss == pytest.approx(total) and np.allclose(flat, want)
    again = T.gradients(b.repartition(7), params, names, 0.2, 1, n)
    assert again[0] == loss and (again[2] == flat).all()


def test_training_freezes_resumes_and_learns(spark, rows, tmp_path):
    start, of = T.new_head(5, 2), pairs_of(rows)
    how = {"last_blocks": 1, "batch_size": 20, "batches_per_step": 2, "temperature": 0.2, "rate": 0.05}
    whole, history = T.train(spark, of, start, 4, checkpoints=str(tmp_path / "a"), **how)
    assert [h["epoch"] for h in history] == [1, 2, 3, 4] and {h["n_batches"] for h in history} == {5} and history[-1]["avg_loss"] < history[0]["avg_loss"]
    assert all((whole[k] == start[k]).all() for k in start if k.startswith("block0")) and all((whole[k] != start[k]).any() for k in T.trainable(start, 1))
    T.train(spark, of, start, 2, checkpoints=str(tmp_path / "b"), **how)  # stopped after two epochs
    assert (tmp_path / "b" / "epoch_002.npz").exists() and not (tmp_path / "b" / "epoch_003.npz").exists()
    resumed, again = T.train(spark, of, start, 4, checkpoints=str(tmp_path / "b"), **how)
    assert again == history and all((resumed[k] == whole[k]).all() for k in whole)
    with pytest.raises(ValueError, match="made with"):
        T.train(spark, of, start, 5, checkpoints=str(tmp_path / "b"), **(how | {"rate": 0.1}))
    z = T.projected(rows.select("i", "v"), "v", whole).collect()
    assert len(z) == 107 and all(np.allclose(r.z, T.forward(whole, np.array([r.v]))[0][0]) for r in z)


def test_too_few_pairs_make_no_step(spark, rows):
    params, history = T.train(spark, pairs_of(rows), T.new_head(5, 1), 1, last_blocks=1, batch_size=500)
    assert np.isnan(history[0]["avg_loss"]) and history[0]["n_batches"] == 0 and all((params[k] == v).all() for k, v in T.new_head(5, 1).items())


def test_a_step_opens_its_own_folder_alone(spark):
    """rows written by step are read by partition, so a step's cost doesn't grow with the epoch's files."""
    from plumbline.session import written

    rows = spark.range(60).selectExpr("id", "cast(id div 20 AS int) AS step")
    with written(rows, "step") as w:
        one = w.filter("step = 1")
        assert sorted(r.id for r in one.collect()) == list(range(20, 40))
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(step" in plan
