"""Structure and probe operators against numpy statements of the same measures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import probes, ranks, resampling, structure


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(1)
    centre = r.normal(0, 4, (3, 8))
    y = np.repeat([0, 1, 2], 40)
    return centre[y] + r.normal(0, 1, (120, 8)), y


@pytest.fixture(scope="module")
def frame(spark, points):
    x, y = points
    return spark.createDataFrame([(i, int(c), [float(e) for e in v]) for i, (v, c) in enumerate(zip(x, y))], "i long, y int, v array<double>").repartition(5)


def test_pca_and_first_component(frame, points):
    x, _ = points
    c = x - x.mean(axis=0)
    e = np.linalg.svd(c, compute_uv=False) ** 2
    got = [r.explained for r in structure.pca_variance(frame, "v", 8).orderBy("pc").collect()]
    assert got == pytest.approx((e / e.sum()).tolist())
    assert structure.dims_for(structure.pca_variance(frame, "v", 8), 0.9).first()[0] == int(np.argmax(np.cumsum(e / e.sum()) >= 0.9)) + 1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    e = np.linalg.svd(u - u.mean(axis=0), compute_uv=False) ** 2
    at_two, at_three = (probes.first_component_gate(frame, "v", least=k).first() for k in (2.0, 3.0))
    assert at_two.real == pytest.approx(e[0] / e.sum()) and at_two.ratio == pytest.approx(at_two.real / at_two.random)
    assert at_two.passed == (at_two.ratio >= 2) and at_three.passed == (at_three.ratio >= 3)


def test_kmeans_finds_the_classes(frame):
    got = structure.kmeans_best(frame, "v", 3, n_init=5).select("i", "y", "cluster").collect()
    assert len(got) == 120 and probes.adjusted_rand(np.array([r.y for r in got]), np.array([r.cluster for r in got])) > 0.95
    assert structure.kmeans_best(frame.limit(0), "v", 3).count() == 0


def test_ward_against_every_merge(points):
    x, _ = points
    x = x[::6]
    groups = [[i] for i in range(len(x))]
    while len(groups) > 4:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    want = np.zeros(len(x), int)
    for k, g in enumerate(groups):
        want[g] = k
    assert probes.adjusted_rand(probes.ward_labels(x, 4), want) == 1.0


def test_ward_clusters_and_bounds(frame):
    got = probes.ward_clusters(frame, "i", "y", "v", k=3, n_pca=8).join(frame.select("i", "y"), "i").collect()
    assert probes.adjusted_rand(np.array([r.y for r in got]), np.array([r.cluster for r in got])) > 0.9
    with pytest.raises(Exception, match="at most"):
        probes.ward_clusters(frame, "i", "y", "v", max_rows=10).collect()


def test_ridge_is_the_closed_form(frame, points):
    x, y = points
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(8), z.T @ (y - y.mean()))
    r2 = 1 - ((y - y.mean() - z @ w) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert structure.ridge_probe(frame, "y", "v").first().r2 == pytest.approx(r2, abs=1e-9)


def test_permutations_against_pairs(frame, points):
    x, y = points
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, up = 1 - u @ u.T, np.triu_indices(len(u), 1)
    ratio = lambda c: (lambda s: d[up][~s].mean() / d[up][s].mean())((c[:, None] == c[None])[up])
    places = resampling.permuted(np.arange(120), 120, np.arange(1, 101), 42).T
    assert all(sorted(p) == list(range(120)) for p in places)
    null = [ratio(y[p]) for p in places]
    got = probes.permutation_separation(frame, "i", "y", "v", n_perm=100).first()
    assert got.observed == pytest.approx(ratio(y)) and got.null_mean == pytest.approx(np.mean(null))
    assert got.z_score == pytest.approx((ratio(y) - np.mean(null)) / np.std(null)) and got.p_value == pytest.approx(1 / 101)


def test_probes_tell_signal_from_noise(spark, frame):
    knn, lin = probes.knn_probe(frame, "i", "y", "v").first(), probes.logistic_probe(frame, "i", "y", "v", n_perm=20).first()
    assert knn.accuracy > 0.95 and knn.macro_f1 > 0.95 and knn.n == 120
    assert lin.auc > 0.95 and lin.accuracy > 0.9 and lin.p_value == pytest.approx(1 / 21) and lin.chance == pytest.approx(1 / 3)
    noise = frame.withColumn("y", (F.crc32(F.col("i").cast("string")) % 2).cast("int"))
    assert abs(probes.logistic_probe(noise, "i", "y", "v", n_perm=20).first().auc - 0.5) < 0.2
    assert probes.auc(np.array([0, 0, 1, 1]), np.array([1.0, 2.0, 2.0, 3.0])) == 0.875


def test_stability_silhouette_and_report(spark, frame):
    s = probes.bootstrap_stability(frame, "i", "y", "v", k=3, n_boot=12, n_pca=8).first()
    assert s.n_boot == 12 and s.ari_mean > 0.9
    m = frame.withColumns({"layer": F.lit(1), "pooling": F.lit("cls")}).unionByName(frame.withColumns({"layer": F.lit(2), "pooling": F.lit("cls")}))
    got = probes.structure_report(m, "i", "y", "v", n_perm_sep=50, n_perm_probe=4).orderBy("layer").collect()
    assert [(r.layer, r.pooling) for r in got] == [(1, "cls"), (2, "cls")] and all(r.sep_ratio > 1 and r.p_sep < 0.05 and r.silhouette > 0.1 for r in got)
    best = probes.best_row(spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7), (4, None)], "k int, auc double"), "auc", ["k"]).first()
    assert (best.k, best.auc) == (2, 0.7)


def test_confounds(spark, frame):
    meta = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "patent_id string, extra string")
    labels = spark.createDataFrame([("a", "2011-03-04", "Bell Helicopter"), ("b", "1999", "ACME"), ("b", "1999", "ACME")], "patent_id string, priority_date string, assignee string")
    got = {r.patent_id: (r.filing_year, r.is_bell) for r in probes.derive_confounds(meta, labels).collect()}
    assert got == {"a": (2011, 1), "b": (1999, 0), "c": (None, None)}
    rows = frame.withColumns({"one": (F.col("y") == 1).cast("int"), "size": F.col("y") * 1.5})
    out = {r.confound: r for r in probes.confound_decodability(rows, "i", "v", ["one"], ["size"], n_perm=4).collect()}
    assert out["one"].measure == "auc" and out["one"].value > 0.9 and out["size"].value > 0.7


def test_gates_and_signal(spark):
    df = spark.createDataFrame([("spearman", -0.4, 0.0), ("auc", 0.75, 0.5), ("accuracy", 0.5, 0.75)], "k string, v double, c double")
    assert [r[0] for r in df.select(probes.signal(F.col("k"), F.col("v"), F.col("c"))).collect()] == [0.4, 0.5, 0.0]
    assert [r[0] for r in spark.createDataFrame([(3.0,), (2.9,), (None,)], "x double").select(probes.gate("pc1_ratio", F.col("x"))).collect()] == [True, False, False]


def test_permutations_and_weights():
    for n in (1, 2, 5, 64, 65, 1000):
        p = resampling.permuted(np.arange(n), n, np.arange(1, 40), 7)
        assert (np.sort(p, axis=0) == np.arange(n)[:, None]).all()
    assert abs(np.corrcoef(np.arange(1000), resampling.permuted(np.arange(1000), 1000, np.array([3]), 7)[:, 0])[0, 1]) < 0.1
    w = resampling.poisson_weights(np.arange(5000).astype(np.uint64) * np.uint64(977), 40, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(w.T) - np.eye(40)).max() < 0.06 and (w == resampling.poisson_weights(np.arange(5000).astype(np.uint64) * np.uint64(977), 40, 1)).all()


def test_logistic_fits_against_newton(spark, frame):
    """Real and permuted labels against a plain Newton fit of each fold, class and permutation."""
    y, x, fold = folds_of(frame, 5)
    r = np.random.default_rng(0)
    y = np.where(r.random(120) < 0.4, r.integers(0, 3, 120), y)
    order = np.argsort(y, kind="stable")  # permutations label places by class sizes
    sizes = np.bincount(y).tolist()
    rows = spark.createDataFrame([(int(i), int(y[i]), int(fold[i]), x[i].tolist(), 0.0) for i in order], "at long, code int, fold int, x array<double>, t double").repartition(4)
    fits = resampling.Logistic(rows, probes.fold_sums(rows), sizes, 3, 42)
    w = fits.fit(rounds=200, close=1e-9)
    place = resampling.permuted(np.arange(120), 120, np.arange(1, 4), 42)
    labels = np.concatenate([y[:, None], np.searchsorted(np.cumsum(sizes), place, side="right")], axis=1)
    scores = np.zeros((4, 120, 3))
    for f in range(5):
        a = fold != f
        z = np.c_[(x - x[a].mean(axis=0)) / x[a].std(axis=0), np.ones(120)]
        for p in range(4):
            for c in range(3):
                v, t, ridge = np.zeros(z.shape[1]), (labels[a, p] == c).astype(float), np.diag([1.0] * x.shape[1] + [1e-9])
                for _ in range(30):
                    s = 1 / (1 + np.exp(-z[a] @ v))
                    v += np.linalg.solve((z[a] * (s * (1 - s))[:, None]).T @ z[a] + ridge, z[a].T @ (t - s) - ridge @ v)
                assert w[f, p, c] == pytest.approx(v, abs=1e-5)
                scores[p, ~a, c] = z[~a] @ v
    got = {r.c: r.area for r in probes.areas(fits.scored(w), 120).collect()}
    assert got == pytest.approx({c: probes.auc((y == c).astype(int), scores[0, :, c]) for c in range(3)})
    for p, area in enumerate(fits.null_areas(w), 1):
        assert area == pytest.approx(np.mean([probes.auc((labels[:, p] == c).astype(int), scores[p, :, c]) for c in range(3)]), abs=2e-3)


def test_resampled_kmeans_is_weighted_kmeans(spark, frame, points):
    x, _ = points
    rows = frame.select(F.xxhash64("i").alias("key"), F.col("v").alias("x"))
    keys = np.array([r.key for r in frame.select("i", F.xxhash64("i").alias("key")).orderBy("i").collect()])
    starts = np.stack([x[[1, 50, 100]], x[[2, 3, 4]], x[[7, 60, 90]], x[[5, 6, 110]]])
    centres, cost = resampling.weighted_kmeans(rows, starts, 2, 2, 9)
    w = resampling.poisson_weights(keys.view(np.uint64), 2, 9)
    for s in range(4):
        c, u = starts[s].copy(), w[:, s // 2]
        for _ in range(50):
            d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
            at, total = d.argmin(axis=1), (u * d.min(axis=1)).sum()
            new = np.stack([(u[at == j, None] * x[at == j]).sum(axis=0) / u[at == j].sum() if u[at == j].sum() else c[j] for j in range(3)])
            if np.allclose(new, c, atol=1e-6):
                c = new
                break
            c = new
        assert centres[s] == pytest.approx(c) and cost[s] == pytest.approx(total)
    t = resampling.cluster_tables(rows, centres[0], centres[1:])
    near = lambda c: ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    for s in range(3):
        want = np.zeros((3, 3))
        np.add.at(want, (near(centres[0]), near(centres[s + 1])), 1)
        assert (t[s] == want).all() and probes.rand_of(t[s]) == probes.adjusted_rand(near(centres[0]), near(centres[s + 1]))


def test_probes_without_rows_or_classes(spark, frame):
    none, one = frame.limit(0), frame.filter("y = 1")
    assert tuple(probes.logistic_probe(none, "i", "y", "v", n_perm=3).first()) == (None, None, None, None, 1.0, None)
    assert tuple(probes.logistic_probe(one, "i", "y", "v", n_perm=3).first()) == (None, None, None, None, 1.0, 1.0)
    assert tuple(probes.bootstrap_stability(none, "i", "y", "v").first()) == (None, None, 0)
    assert set(probes.permutation_separation(one, "i", "y", "v", n_perm=3).first()) == {None} == set(probes.permutation_separation(none, "i", "y", "v", n_perm=3).first())


def folds_of(frame, n, **how):
    rows = probes.reduced(frame, "i", "y", "v", **how)
    got = probes.stratified_fold(rows, n, 42).orderBy("i").collect()
    return np.array([r.y for r in got]), np.array([r.x for r in got]), np.array([r.fold for r in got])


def test_folds_share_every_class(frame):
    y, _, fold = folds_of(frame, 5)
    for c in (0, 1, 2):
        n = np.bincount(fold[y == c], minlength=5)
        assert n.sum() == 40 and n.max() - n.min() <= 1


def test_knn_probe_against_brute_force(spark, frame):
    noisy = frame.withColumn("y", F.when(F.pmod(F.xxhash64("i"), F.lit(4)) == 0, (F.col("y") + 1) % 3).otherwise(F.col("y")))
    y, x, fold = folds_of(noisy, 5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    s[fold[:, None] == fold[None]] = -np.inf
    p = np.array([np.bincount(y[np.argsort(-r, kind="stable")[:5]], minlength=3).argmax() for r in s])
    got = probes.knn_probe(noisy, "i", "y", "v").first()
    assert got.n == 120 and got.accuracy == pytest.approx(np.mean([(p == y)[fold == f].mean() for f in range(5)]))
    assert got.macro_f1 == pytest.approx(np.mean([probes.macro_f1(y[fold == f], p[fold == f]) for f in range(5)]))
    assert tuple(probes.knn_probe(frame.limit(0), "i", "y", "v").first()) == (None, None, None)


def test_ridge_out_of_fold_against_numpy(spark, frame):
    r = np.random.default_rng(5)
    target = {i: float(c + t) for i, c, t in zip(range(120), np.repeat([0, 1, 2], 40), r.normal(size=120))}
    df = frame.drop("y").join(spark.createDataFrame(list(target.items()), "i long, y double"), "i")
    rows = probes.reduced(df, "i", "y", "v").withColumns({"t": F.col("y"), "y": F.lit(0)})
    got = probes.stratified_fold(rows, 5, 42).orderBy("i").collect()
    x, t, fold = np.array([g.x for g in got]), np.array([g.t for g in got]), np.array([g.fold for g in got])
    pred = np.zeros(120)
    for f in range(5):
        a = fold != f
        z = lambda v: (v - x[a].mean(axis=0)) / x[a].std(axis=0)  # noqa: B023, E731
        w = np.linalg.solve(z(x[a]).T @ z(x[a]) + 10 * np.eye(x.shape[1]), z(x[a]).T @ (t[a] - t[a].mean()))
        pred[~a] = z(x[~a]) @ w + t[a].mean()
    rank = lambda v: np.argsort(np.argsort(v))
    one = probes.ridge_cv(df, "i", "y", "v").first()
    assert one.n == 120 and one.r2 == pytest.approx(1 - ((t - pred) ** 2).sum() / ((t - t.mean()) ** 2).sum()) and one.r2 > 0.2
    assert one.spearman == pytest.approx(np.corrcoef(rank(t), rank(pred))[0, 1])
    assert tuple(probes.ridge_cv(df.limit(0), "i", "y", "v").first()) == (None, None, 0)


def test_ranks_and_running_totals(spark):
    values = [3.0, 1.0, None, 3.0, 2.0, 3.0, -1.0, 1.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").repartition(5)
    got = {r.i: r.r for r in ranks.average_rank(df, "v", "r").collect()}
    assert got == {0: 6.0, 1: 2.5, 2: None, 3: 6.0, 4: 4.0, 5: 6.0, 6: 1.0, 7: 2.5}
    big = spark.range(5000).withColumn("a", F.col("id") % 7).repartition(9)
    total = np.cumsum(np.arange(5000) % 7)
    assert all(r.t == total[r.id] for r in ranks.running_total(big, ["id"], "a", "t").collect())
    assert ranks.running_total(big.limit(0), ["id"], "a", "t").count() == 0


def test_euclidean_silhouette_against_numpy(spark, frame, points):
    x, y = points
    rows = frame.withColumn("y", F.when(F.col("i") == 5, 9).otherwise(F.col("y")).cast("string"))  # one alone in its class
    c = np.where(np.arange(120) == 5, 9, y)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for i in range(120):
        own = (c == c[i]) & (np.arange(120) != i)
        b = min(d[i, c == k].mean() for k in set(c) - {c[i]})
        want.append((b - d[i, own].mean()) / max(b, d[i, own].mean()) if own.any() else 0.0)
    got = {r.i: r.silhouette for r in probes.euclidean_silhouette(rows, "i", "y", "v").collect()}
    assert [got[i] for i in range(120)] == pytest.approx(want)
    assert {r.silhouette for r in probes.euclidean_silhouette(frame.filter("y = 0"), "i", "y", "v").collect()} == {0.0}
    assert probes.euclidean_silhouette(frame.limit(0), "i", "y", "v").count() == 0
