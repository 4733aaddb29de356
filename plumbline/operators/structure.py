"""Structure analytics of the archived tier: agreement, separation, clustering, spectra (X-series); probes.py has the rest.

Wherever a pairwise quantity is linear in unit vectors it is computed from group sums, never from
pairs: mean cosine distance to a group is 1 - u . mean(unit vectors of the group).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.session import cut


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.dropna(subset=[a, b]).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """Adjusted Rand index, normalised mutual information (arithmetic mean), purity and its baseline."""
    t = contingency(df, truth, cluster)
    c2 = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    rows, cols = t.groupBy("a").agg(F.sum("n").alias("na")), t.groupBy("b").agg(F.sum("n").alias("nb"), F.max("n").alias("mx"))
    total = t.agg(F.sum("n").alias("total"), F.sum(c2("n")).alias("s"))
    ra = rows.agg(F.sum(c2("na")).alias("sa"), F.max("na").alias("top"), F.collect_list("na").alias("la"))
    cb = cols.agg(F.sum(c2("nb")).alias("sb"), F.sum("mx").alias("hit"), F.collect_list("nb").alias("lb"))
    one = total.join(ra, F.lit(True)).join(cb, F.lit(True))
    mi = (
        t.join(rows, "a").join(cols, "b").join(F.broadcast(total.select("total")), F.lit(True))  # one row
        .agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))
    )
    h = lambda l: -F.aggregate(l, F.lit(0.0), lambda s, x: s + x / F.col("total") * F.log(x / F.col("total")))  # noqa: E731, E741
    exp = F.col("sa") * F.col("sb") / (F.col("total") * (F.col("total") - 1) / 2.0)
    mean = (F.col("sa") + F.col("sb")) / 2
    return one.join(mi, F.lit(True)).select(
        F.when(mean == exp, 1.0).otherwise((F.col("s") - exp) / (mean - exp)).alias("ari"),
        F.when(h("la") + h("lb") == 0, 1.0).otherwise(2 * F.col("mi") / (h("la") + h("lb"))).alias("nmi"),
        (F.col("hit") / F.col("total")).alias("purity"),
        (F.col("top") / F.col("total")).alias("purity_baseline"),
    )


def fisher_enrichment(df: DataFrame, group: str, flag: str) -> DataFrame:
    """Two-sided Fisher exact p of each group against the rest, from ratios of neighbouring hypergeometric terms."""
    g = df.dropna(subset=[group, flag]).groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("long")).alias("k"))
    tot = g.agg(F.sum("n").alias("total"), F.sum("k").alias("hits"))
    x = g.join(F.broadcast(tot), F.lit(True))  # one row
    lo, hi = F.greatest(F.lit(0), F.col("n") + F.col("hits") - F.col("total")), F.least("n", "hits")
    x = x.select(group, "n", "k", "total", "hits", F.explode(F.sequence(lo, hi)).alias("i"))
    # ln C(n,i) C(N-n,K-i) relative to the lowest i, by the ratio of neighbours, summed along i
    ratio = F.log((F.col("n") - F.col("i") + 1) * (F.col("hits") - F.col("i") + 1) / (F.col("i") * (F.col("total") - F.col("n") - F.col("hits") + F.col("i"))))
    w = Window.partitionBy(group).orderBy("i")
    x = x.withColumn("step", F.when(F.lag("i").over(w).isNull(), 0.0).otherwise(ratio)).withColumn("lw", F.sum("step").over(w))
    x = x.withColumn("mx", F.max("lw").over(Window.partitionBy(group))).withColumn("p", F.exp(F.col("lw") - F.col("mx")))
    obs = F.max(F.when(F.col("i") == F.col("k"), F.col("p"))).over(Window.partitionBy(group))
    x = x.withColumn("po", obs)
    return x.groupBy(group).agg(
        F.first("n").alias("n"), F.first("k").alias("k"), (F.sum(F.when(F.col("p") <= F.col("po") * (1 + 1e-7), F.col("p")).otherwise(0.0)) / F.sum("p")).alias("p_value")
    )


def unit_sums(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Per label: rows and the sum of its unit vectors, as an array."""
    cells = df.select(F.col(label).alias("g"), F.posexplode(V.l2_zero_safe(F.col(vec))).alias("pos", "x"))
    per = cells.groupBy("g", "pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return per.groupBy("g").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda e: e["s"]).alias("s"))


def separation_ratio(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Mean between-class over mean within-class cosine distance, over all pairs, from class sums."""
    u = df.filter(F.col(label).isNotNull())
    g = unit_sums(u, label, vec)
    own = u.select(V.l2_zero_safe(F.col(vec)).alias("u")).agg(F.sum(V.dot(F.col("u"), F.col("u"))).alias("q"))
    allsum = (
        g.select("n", F.posexplode("s").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("tt"))
    )
    agg = g.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pin"), F.sum("n").alias("total"), F.sum(V.dot(F.col("s"), F.col("s"))).alias("ss"))
    r = agg.join(own, F.lit(True)).join(allsum, F.lit(True))
    pout = F.col("total") * (F.col("total") - 1) / 2 - F.col("pin")
    intra, inter = 1 - (F.col("ss") - F.col("q")) / 2 / F.col("pin"), 1 - (F.col("tt") - F.col("ss")) / 2 / pout
    return r.select(intra.alias("intra"), inter.alias("inter"), (inter / intra).alias("sep_ratio"))


def cosine_silhouette(df: DataFrame, idx: str, label: str, vec: str) -> DataFrame:
    """X9 under cosine distance, exact: each row meets the k class sums, not the other rows."""
    g = unit_sums(df, label, vec)
    x = df.select(idx, F.col(label).alias("own"), V.l2_zero_safe(F.col(vec)).alias("u"))
    d = x.join(g, F.lit(True)).withColumn("d", V.dot(F.col("u"), F.col("s")))  # k rows each
    same = F.col("own") == F.col("g")
    self_ = V.dot(F.col("u"), F.col("u"))
    a = F.when(same & (F.col("n") > 1), 1 - (F.col("d") - self_) / (F.col("n") - 1))
    s = d.groupBy(idx).agg(F.max(a).alias("a"), F.min(F.when(~same, 1 - F.col("d") / F.col("n"))).alias("b"))
    return s.select(idx, F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def cluster_indices(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin (Euclidean), from class means; rows meet their own class's mean only."""
    rows = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("g"), V.as_double(F.col(vec)).alias("x"))
    mean = vector_to_array(Summarizer.mean(F.col("v"))).alias("c")
    vecs = rows.select("g", array_to_vector("x").alias("v"))
    cen = vecs.groupBy("g").agg(mean, F.count("*").alias("n"))
    centre = vecs.agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("m"))
    d2 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    dist = rows.join(cen, "g").select("g", d2(F.col("x"), F.col("c")).alias("d2"))
    scat = dist.groupBy("g").agg(F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("w"), F.count("*").alias("n"))
    between = cen.join(centre, F.lit(True)).agg(F.sum(F.col("n") * d2(F.col("c"), F.col("m"))).alias("bt"))
    spread = cen.select("g", "c").join(scat.select("g", "s"), "g")
    a, b = (spread.select(F.col("g").alias(f"g{k}"), F.col("c").alias(f"c{k}"), F.col("s").alias(f"s{k}")) for k in "ab")  # a row a class
    pairs = a.join(b, F.col("ga") != F.col("gb")).withColumn("r", (F.col("sa") + F.col("sb")) / F.sqrt(d2(F.col("ca"), F.col("cb"))))
    db = pairs.groupBy("ga").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    tot = scat.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("k"))
    return tot.join(between, F.lit(True)).join(db, F.lit(True)).select(
        ((F.col("bt") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"), "davies_bouldin"
    )


def pca_variance(df: DataFrame, vec: str, k: int) -> DataFrame:
    """Explained and cumulative variance ratio of each component."""
    model = PCA(k=k, inputCol="v", outputCol="p").fit(df.select(array_to_vector(V.as_double(F.col(vec))).alias("v")))
    rows = [(i + 1, float(x)) for i, x in enumerate(model.explainedVariance)]
    w = Window.orderBy("pc").rowsBetween(Window.unboundedPreceding, 0)
    return df.sparkSession.createDataFrame(rows, "pc int, explained double").withColumn("cumulative", F.sum("explained").over(w))


def dims_for(variance: DataFrame, share: float = 0.9) -> DataFrame:
    return variance.filter(F.col("cumulative") >= share).agg(F.min("pc").alias("n_dims"))


def random_baseline(df: DataFrame, vec: str, seed: int = 42) -> DataFrame:
    """A Gaussian matrix of the same shape."""
    return df.select(F.transform(V.as_double(F.col(vec)), lambda x: x).alias(vec)).withColumn(vec, F.transform(F.col(vec), lambda x, i: F.randn(seed)))


def stated_baseline(df: DataFrame, idx: str, vec: str, seed: int = 42) -> DataFrame:
    """Gaussian numbers in the shape of ``vec`` that any engine can state: Box-Muller of two uniforms from the md5 of id, place and seed."""
    mark = lambda p: F.md5(F.concat_ws(":", F.col(idx).cast("string"), p.cast("string"), F.lit(str(seed))))
    part = lambda h, at: (F.conv(F.substring(h, at, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    draw = lambda h: F.sqrt(-2 * F.log(part(h, 1))) * F.cos(2 * math.pi * part(h, 9))
    marks = F.transform(F.sequence(F.lit(1), F.size(vec)), lambda p: mark(p))  # a list of its own, so that a digest is made once
    return df.withColumn(vec, F.transform(marks, lambda h: draw(h)))


def kmeans_best(df: DataFrame, vec: str, k: int, n_init: int = 20, seed: int = 42, rounds: int = 50, seed_rows: int = 2000) -> DataFrame:
    """The restart with the least cost over all rows; adds ``cluster``.

    All restarts move together: a round is one job that sums each restart's clusters, partly in the tasks, so
    the driver sees n_init x k sums. Seeds are chosen by k-means++ among about ``seed_rows`` rows.
    """
    rows = cut(df.select(V.as_double(F.col(vec)).alias("v")))  # every round reads it
    n = rows.count()
    if not n:
        return df.withColumn("cluster", F.lit(None).cast("int"))
    some = rows.filter(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, seed_rows / n) * (1 << 30))).orderBy("v").collect() or rows.limit(k).collect()
    x = np.array([r.v for r in some])
    centres = np.stack([spread_seeds(x, k, np.random.default_rng([seed, i])) for i in range(n_init)])
    cost = np.full(n_init, np.inf)
    for _ in range(rounds):
        here = centres

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, size, cost = np.zeros_like(here), np.zeros(here.shape[:2]), np.zeros(here.shape[:2])  # noqa: B023
            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
                for i, c in enumerate(here):  # noqa: B023
                    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
                    at = d.argmin(axis=1)
                    np.add.at(sums[i], at, x)
                    size[i] += np.bincount(at, minlength=k)
                    cost[i] += np.bincount(at, weights=d.min(axis=1), minlength=k)
            r, j = np.indices(size.shape)
            yield pa.RecordBatch.from_arrays([pa.array(r.ravel()), pa.array(j.ravel()), pa.array(size.ravel()), pa.array(cost.ravel()), pa.array(list(sums.reshape(size.size, -1)), pa.list_(pa.float64()))], names=["r", "j", "n", "cost", "s"])

        got = rows.mapInArrow(summed, "r long, j long, n double, cost double, s array<double>").groupBy("r", "j").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).collect()
        cost, centres = np.zeros(n_init), here.copy()
        for g in got:
            cost[g.r] += g.cost
            if g.n:
                centres[g.r, g.j] = np.array(g.s) / g.n
        if np.allclose(centres, here, atol=1e-6):
            break
    best = centres[int(cost.argmin())]
    far = [F.aggregate(F.zip_with(V.as_double(F.col(vec)), F.array(*[F.lit(float(e)) for e in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e) for c in best]
    d = F.array(*far)
    return df.withColumn("_d", d).withColumn("cluster", (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d")


def spread_seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each further centre is drawn by squared distance to the nearest so far."""
    c = x[[rng.integers(len(x))]]
    while len(c) < k:
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1)
        c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
    return c


def cluster_mix(df: DataFrame, cluster: str, label: str, dominant: float = 0.8) -> DataFrame:
    """Size, dominant label and share of each cluster; under the share it is mixed."""
    t = contingency(df, label, cluster)
    g = t.groupBy("b").agg(F.sum("n").alias("size"), F.max("n").alias("top"), F.max_by("a", F.struct("n", "a")).alias("label"))
    frac = F.col("top") / F.col("size")
    return g.select(F.col("b").alias("cluster"), "size", frac.alias("dominant_fraction"), F.when(frac >= dominant, F.col("label").cast("string")).otherwise("mixed").alias("composition"))


def ridge_probe(df: DataFrame, target: str, vec: str, alpha: float = 10.0) -> DataFrame:
    """Ridge on standardised features; R2 and Spearman of the fit.

    The library scales its penalty by the target's deviation over n, hence regParam below.
    """
    y = F.col(target).cast("double")
    x = df.filter(y.isNotNull()).select(y.alias("y"), array_to_vector(V.as_double(F.col(vec))).alias("v"))
    n, sd = x.agg(F.count("*"), F.stddev_pop("y")).first()
    x = StandardScaler(withMean=True, withStd=True, inputCol="v", outputCol="sample").fit(x).transform(x)
    grow = float(((n - 1) / n) ** -0.5) if n > 1 else 1.0  # the scaler divides by the sample deviation, the definition by the population's
    x = x.withColumn("features", array_to_vector(F.transform(vector_to_array("sample"), lambda e: e * grow)))
    pred = LinearRegression(labelCol="y", solver="normal", elasticNetParam=0.0, standardization=False, regParam=alpha * sd / n).fit(x).transform(x)
    rk = lambda c: (F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0)
    res = pred.select("y", "prediction", rk("y").alias("ry"), rk("prediction").alias("rp"))
    mean = x.agg(F.avg("y")).first()[0]
    return res.agg((1 - F.sum((F.col("y") - F.col("prediction")) ** 2) / F.sum((F.col("y") - mean) ** 2)).alias("r2"), F.corr("ry", "rp").alias("spearman"))
