"""Evaluation of labelled vectors: probes, stability, hierarchical clustering, confounds and gates (X-series).

All of it but Ward linkage works on tables of any size: neighbours and distances by tiles, ridge from fold sums, and
what repeats a fit hundreds of times (logistic probe, bootstrap, permutations) with all repetitions moving together,
a pass over the rows a round. Rows never reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import resampling, tiles
from plumbline.operators.ranks import running_total, spearman
from plumbline.operators.structure import cosine_silhouette, pca_variance, random_baseline, separation_ratio, spread_seeds, stated_baseline
from plumbline.session import cut, spread

#: Rows from which a table is dealt over all cores before it is read round by round.
SPREAD_FROM = 10_000


def binary_labels(df: DataFrame, category: str = "shrouded_open", out: str = "y") -> DataFrame:
    """1 for SHR, 0 for OPN, null for anything else."""
    c = F.col(category)
    return df.withColumn(out, F.when(c == "SHR", 1).when(c == "OPN", 0).cast("int"))


def reduced(df: DataFrame, idx: str, label: str, vec: str, n_pca: int = 50) -> DataFrame:
    """(i, y, x): unit vectors, centred and projected on the first principal components."""
    rows = df.filter(F.col(label).isNotNull()).select(F.col(idx).alias("i"), F.col(label).alias("y"), array_to_vector(V.l2_zero_safe(F.col(vec))).alias("u"))
    n, dim = rows.agg(F.count("*"), F.max(F.size(vector_to_array("u")))).first()
    if not n:
        return df.sparkSession.createDataFrame([], f"i {dict(rows.dtypes)['i']}, y {dict(rows.dtypes)['y']}, x array<double>")
    centred = StandardScaler(withMean=True, withStd=False, inputCol="u", outputCol="c").fit(rows).transform(rows)
    k = max(1, min(n_pca, n - 1, dim))
    out = PCA(k=k, inputCol="c", outputCol="p").fit(centred).transform(centred)
    return out.select("i", "y", vector_to_array("p").alias("x"))


def stratified_fold(rows: DataFrame, folds: int, seed: int) -> DataFrame:
    """Adds ``fold``: rows by class and in seeded order are dealt to the folds in turn, so a class's shares differ by one row at most."""
    one = rows.withColumns({"_h": F.xxhash64("i", F.lit(seed)), "_one": F.lit(1)})
    return running_total(one, ["y", "_h", "i"], "_one", "_at").withColumn("fold", ((F.col("_at") - 1) % folds).cast("int")).drop("_h", "_one", "_at")


def fold_count(rows: DataFrame, folds: int) -> int:
    """As many folds as the smallest class has rows, two at least."""
    least = rows.groupBy("y").count().agg(F.min("count")).first()[0]
    return max(2, min(folds, least or 0))


def macro_f1(y: np.ndarray, p: np.ndarray) -> float:
    out = []
    for c in np.unique(np.concatenate([y, p])):
        hit = ((y == c) & (p == c)).sum()
        out.append(2 * hit / max(1, (y == c).sum() + (p == c).sum()))
    return float(np.mean(out))


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """Share of (1, 0) pairs in order, ties a half."""
    rank = pd.Series(score).rank().to_numpy()
    pos, neg = int((y == 1).sum()), int((y == 0).sum())
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)) if pos and neg else float("nan")


def knn_probe(df: DataFrame, idx: str, label: str, vec: str, k: int = 5, n_pca: int = 50, folds: int = 5, seed: int = 42) -> DataFrame:
    """Cosine k-nearest vote on PCA features out of stratified folds: accuracy and macro-F1, averaged over folds.

    Ties of the vote go to the lesser class, ties of distance (at 12 decimals) to the lesser id. Neighbours are
    found by tiles over all rows; no task or driver holds the set.
    """
    rows = cut(reduced(df, idx, label, vec, n_pca))
    rows = cut(stratified_fold(rows, fold_count(rows, folds), seed))
    near = tiles.nearest(rows.withColumns({"layer": F.lit(0), "pooling": F.lit("probe")}), "i", k, vec="x", apart="fold")
    votes = near.join(rows.select(F.col("i").alias("neighbour"), F.col("y").alias("p")), "neighbour").groupBy("id", "p").agg(F.count("*").alias("n"))
    first = votes.withColumn("_o", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "p"))).filter("_o = 1")  # k rows a window at most
    guess = rows.select(F.col("i").alias("id"), "y", "fold").join(first.select("id", "p"), "id")
    return fold_scores(guess)


def fold_scores(guess: DataFrame) -> DataFrame:
    """(accuracy, macro_f1, n) of ``guess(fold, y, p)``, averaged over folds; macro over the classes that a fold has or guesses."""
    cells = cut(guess.groupBy("fold", "y", "p").agg(F.count("*").alias("n")))
    right = cells.groupBy("fold").agg((F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))
    side = lambda c: cells.select("fold", F.col(c).alias("c"), "n", F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    per = side("y").unionByName(side("p")).groupBy("fold", "c").agg((F.sum("hit") / F.sum("n")).alias("f1"))  # both sides' hits over both sides' rows
    f1 = per.groupBy("fold").agg(F.avg("f1").alias("f1"))
    return right.join(f1, "fold").agg(F.avg("accuracy").alias("accuracy"), F.avg("f1").alias("macro_f1"), F.sum("n").alias("n"))


def areas(scored: DataFrame, n: int) -> DataFrame:
    """(c, area) from ``scored(code, s array)`` of n rows: the share of (class c, other) pairs in order by the c-th score, ties a half."""
    each = scored.select("code", F.posexplode("s").alias("c", "v"))
    values = each.groupBy("c", "v").agg(F.count("*").alias("n"), F.count_if(F.col("code") == F.col("c")).alias("pos"))
    ranked = running_total(values, ["c", "v"], "n", "upto").withColumn("rank", F.col("upto") - F.col("c") * n - (F.col("n") - 1) / 2.0)
    pos = F.sum("pos")
    return ranked.groupBy("c").agg(((F.sum(F.col("pos") * F.col("rank")) - pos * (pos + 1) / 2.0) / (pos * (F.lit(n) - pos))).alias("area"))


def logistic_probe(df: DataFrame, idx: str, label: str, vec: str, n_pca: int = 50, folds: int = 5, n_perm: int = 200, min_per_class: int = 2, seed: int = 42) -> DataFrame:
    """One row of accuracy, balanced accuracy, macro-F1, AUC (mean over classes) and permutation p of the AUC.

    Two classes or more, one against the rest; classes under ``min_per_class`` rows are left out. All permutations of
    the labels move together (``resampling.Logistic``), so a round is one pass over the rows, however many there are.
    The permutations' AUCs are counted in 1,024 ranges of the score, the real one exactly.
    """
    spark = df.sparkSession
    rows = reduced(df, idx, label, vec, n_pca)
    classes = rows.groupBy("y").agg(F.count("*").alias("n"), F.lit(1).alias("_one")).filter(F.col("n") >= min_per_class)
    classes = cut(running_total(classes, ["y"], "_one", "_c").select("y", "n", (F.col("_c") - 1).cast("int").alias("code")))
    sizes = [r.n for r in classes.orderBy("code").collect()]  # one row a class
    n = sum(sizes)
    schema = "accuracy double, balanced_acc double, macro_f1 double, auc double, p_value double, chance double"
    if len(sizes) < 2:
        return spark.createDataFrame([(None, None, None, None, 1.0, 1.0 if n else None)], schema)
    rows = stratified_fold(cut(rows.join(classes.select("y", "code"), "y")), max(2, min([folds, *sizes])), seed)
    rows = running_total(rows.withColumn("_one", F.lit(1)), ["i"], "_one", "_at").select((F.col("_at") - 1).cast("long").alias("at"), "code", "fold", "x")
    rows = cut(rows)
    fits = resampling.Logistic(rows, fold_sums(rows.withColumn("t", F.lit(0.0))), sizes, n_perm, seed)
    w = fits.fit()
    scored = cut(fits.scored(w))
    guess = scored.select(F.lit(0).alias("fold"), F.col("code").alias("y"), (F.array_position("s", F.array_max("s")) - 1).cast("int").alias("p"))
    one = fold_scores(guess).first()
    balanced = guess.groupBy("y").agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("r")).agg(F.avg("r")).first()[0]
    area = areas(scored, n).agg(F.avg("area")).first()[0]
    beaten = int((fits.null_areas(w) >= area).sum()) if n_perm else 0
    return spark.createDataFrame([(one.accuracy, balanced, one.macro_f1, area, (beaten + 1) / (n_perm + 1), max(sizes) / n)], schema)


def fold_sums(rows: DataFrame) -> dict[int, np.ndarray]:
    """By fold, the sum of z z^T over its rows, with z the features, the target and 1: all that a ridge needs. ``rows(fold, x, t)``.

    What reaches the driver grows with the folds and the square of the dimension, not with the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            fold, t = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            z = np.concatenate([x, t[:, None], np.ones((len(t), 1))], axis=1)
            for f in np.unique(fold):
                held[int(f)] = z[fold == f].T @ z[fold == f] + held.get(int(f), 0)
        for f, s in held.items():
            i, j = np.indices(s.shape, np.int32).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), f, np.int32)), pa.array(i), pa.array(j), pa.array(s.ravel())], names=["fold", "i", "j", "v"])

    cells = rows.select("fold", "x", "t").mapInArrow(run, "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).collect()
    d = 1 + max((c.i for c in cells), default=0)
    out: dict[int, np.ndarray] = {}
    for c in cells:
        out.setdefault(c.fold, np.zeros((d, d)))[c.i, c.j] = c.v
    return out


def _ridge_of(s: np.ndarray, alpha: float) -> np.ndarray:
    """Weights and bias, on the raw features, of the ridge on features standardised by the population deviation."""
    n, k = s[-1, -1], len(s) - 2
    mean, m = s[:k, -1] / n, s[k, -1] / n
    cov, cross = s[:k, :k] / n - np.outer(mean, mean), s[:k, k] / n - mean * m
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    w = np.linalg.solve(n * cov / np.outer(sd, sd) + alpha * np.eye(k), n * cross / sd) / sd
    return np.append(w, m - mean @ w)


def ridge_cv(df: DataFrame, idx: str, target: str, vec: str, n_pca: int = 50, alpha: float = 10.0, folds: int = 5, seed: int = 42) -> DataFrame:
    """X19 out of fold: ridge on features standardised (population deviation) by the other folds; R2, Spearman and rows.

    One pass adds each fold's products; a fold's model comes from the sums of the others, and rows are predicted
    where they are. Without rows, or with a constant target, R2 is null.
    """
    rows = cut(reduced(df, idx, target, vec, n_pca).withColumns({"t": F.col("y").cast("double"), "y": F.lit(0)}))
    rows = cut(stratified_fold(rows, fold_count(rows, folds), seed))
    sums = fold_sums(rows)
    if not sums:
        return df.sparkSession.createDataFrame([(None, None, 0)], "r2 double, spearman double, n long")
    models = {f: _ridge_of(sum(s for g, s in sums.items() if g != f), alpha) if len(sums) > 1 else np.zeros(len(s) - 1) for f, s in sums.items()}
    weights = F.create_map(*[e for f, w in models.items() for e in (F.lit(f), F.array(*[F.lit(float(x)) for x in w]))])[F.col("fold")]
    guess = F.aggregate(F.zip_with(F.concat("x", F.array(F.lit(1.0))), weights, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
    pred = cut(rows.select("t", guess.alias("p")))
    fit = pred.agg(F.sum((F.col("t") - F.col("p")) ** 2).alias("rest"), (F.var_pop("t") * F.count("*")).alias("all_"), F.count("*").alias("n"))
    fit = fit.select(F.when(F.col("all_") > 0, 1 - F.col("rest") / F.col("all_")).alias("r2"), "n")
    return fit.join(spearman(pred, "t", "p"), F.lit(True)).select("r2", "spearman", "n")


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    return rand_of(pd.crosstab(a, b).to_numpy().astype(float))


def rand_of(t: np.ndarray) -> float:
    """The adjusted Rand index of a table of counts."""
    two = lambda n: (n * (n - 1) / 2).sum()
    s, sa, sb, all_ = two(t), two(t.sum(axis=1)), two(t.sum(axis=0)), two(np.array([t.sum()]))
    expected, top = sa * sb / all_ if all_ else 0.0, (sa + sb) / 2
    return 1.0 if top == expected else float((s - expected) / (top - expected))


def ward_labels(x: np.ndarray, k: int) -> np.ndarray:
    """Ward linkage by nearest-neighbour chains (Lance-Williams), cut to k clusters; labels by first member."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, bool), [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        row = np.where(alive, d[a], np.inf)
        b = int(row.argmin())
        if len(chain) > 1 and row[chain[-2]] <= row[b]:
            b = chain[-2]
            chain = chain[:-2]
            merges.append((row[b], a, b))
            total = size[a] + size[b] + size
            new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / total
            alive[b] = False
            size[a] += size[b]
            d[a], d[:, a] = new, new
            d[a, a] = np.inf
        else:
            chain.append(b)
    root = np.arange(n)
    for _, a, b in sorted(merges, key=lambda m: m[0])[: max(0, n - k)]:
        ra, rb = root[a], root[b]
        root[root == max(ra, rb)] = min(ra, rb)
    return np.unique(root, return_inverse=True)[1]


def ward_clusters(df: DataFrame, idx: str, label: str, vec: str, k: int = 4, n_pca: int = 39, max_rows: int = 4000) -> DataFrame:
    """(i, cluster) of an evaluation set. The linkage needs all pairs in one place, so over ``max_rows`` it raises."""
    rows = reduced(df, idx, label, vec, n_pca)
    kind = dict(rows.dtypes)["i"]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        if len(f) > max_rows:
            raise ValueError(f"{len(f)} rows; Ward linkage takes at most {max_rows}: sample first")
        f = f.sort_values("i", ignore_index=True)
        return pd.DataFrame({"i": f["i"], "cluster": ward_labels(np.array(f["x"].tolist(), float), k)})

    return rows.withColumn("all_", F.lit(1)).groupBy("all_").applyInPandas(run, f"i {kind}, cluster int")


def bootstrap_stability(df: DataFrame, idx: str, label: str, vec: str, k: int = 4, n_boot: int = 200, n_pca: int = 39, n_init: int = 20, boot_init: int = 10, seed: int = 42, seed_rows: int = 2000) -> DataFrame:
    """X11: mean and deviation of the ARI between a reference k-means and those of resampled rows, predicted on all rows.

    A resampling draws each row a Poisson(1) number of times, which the row states by itself; all resamplings and
    restarts move together, a round a pass. Restarts begin at k-means++ seeds among about ``seed_rows`` rows.
    """
    rows = cut(reduced(df, idx, label, vec, n_pca).select(F.xxhash64("i").alias("key"), "x"))
    n = rows.count()
    if n > SPREAD_FROM:  # each task sends all sums, so few rows stay in few tasks
        rows = cut(spread(rows, "key"))
    schema = "ari_mean double, ari_std double, n_boot long"
    if n < k:
        return df.sparkSession.createDataFrame([(None, None, 0)], schema)
    some = rows.filter(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, seed_rows / n) * (1 << 30))).orderBy("key").collect() or rows.limit(k).collect()
    x = np.array([r.x for r in some])
    starts = lambda m, tag: np.stack([spread_seeds(x, k, np.random.default_rng([seed, tag, i])) for i in range(m)])
    centres, cost = resampling.weighted_kmeans(rows, starts(n_init, 0), 1, 0, seed)
    reference = centres[cost.argmin()]
    centres, cost = resampling.weighted_kmeans(rows, starts(n_boot * boot_init, 1), boot_init, n_boot, seed)
    best = cost.reshape(n_boot, boot_init).argmin(axis=1)
    tables = resampling.cluster_tables(rows, reference, centres.reshape(n_boot, boot_init, k, -1)[np.arange(n_boot), best])
    ari = np.array([rand_of(t) for t in tables])
    return df.sparkSession.createDataFrame([(float(ari.mean()), float(ari.std()), n_boot)], schema)


def euclidean_silhouette(df: DataFrame, idx: str, label: str, vec: str) -> DataFrame:
    """X9 as the reference measures it: mean Euclidean distance to the own class (without oneself) against the nearest other.

    Tiles add each row's distances by class, so rows meet in blocks and no pair is kept; with one class, or alone in
    it, a row's silhouette is 0.
    """
    rows = df.filter(F.col(label).isNotNull()).select(F.col(idx).alias("i"), F.col(label).alias("y"), V.as_double(F.col(vec)).alias("x"))
    sizes = running_total(rows.groupBy("y").agg(F.count("*").alias("n"), F.lit(1).alias("_one")), ["y"], "_one", "code").drop("_one")
    coded = cut(rows.join(sizes, "y").select("i", "x", "code", F.lit(0).alias("layer"), F.lit("all").alias("pooling")))
    total = tiles.class_distances(coded, "i", "code", "x").select(F.col("id").alias("i"), F.col("label").alias("g"), "total")
    each = total.join(coded.select("i", F.col("code").alias("own")), "i").join(sizes.select(F.col("code").alias("g"), "n"), "g")
    inside = F.when((F.col("g") == F.col("own")) & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))
    s = each.groupBy("i").agg(F.max(inside).alias("a"), F.min(F.when(F.col("g") != F.col("own"), F.col("total") / F.col("n"))).alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300)))
    return s.select(F.col("i").alias(idx), value.alias("silhouette"))


def permutation_separation(df: DataFrame, idx: str, label: str, vec: str, n_perm: int = 2000, seed: int = 42, numbers: int = 1 << 22) -> DataFrame:
    """Null distribution of the separation ratio under seeded relabelling.

    The ratio needs only the classes' sums of unit vectors. A row states its label under each permutation by itself
    (``resampling.permuted`` of its number), a task adds its rows' vectors by permutation and class, and the tasks'
    sums meet. A pass takes as many permutations as ``numbers`` sums allow. Without two classes, or a class of two,
    every figure is null.
    """
    base = df.filter(F.col(label).isNotNull()).select(F.col(idx).alias("i"), F.col(label).alias("y"), F.col(vec).alias("v"))
    sizes = [r["count"] for r in base.groupBy("y").count().orderBy("y").collect()]  # one row a class
    n, k, inside = sum(sizes), len(sizes), sum(c * (c - 1) / 2 for c in sizes)
    between = n * (n - 1) / 2 - inside
    schema = "observed double, null_mean double, z_score double, p_value double, effect_size double"
    if not inside or not between:
        return df.sparkSession.createDataFrame([(None,) * 5], schema)
    units = running_total(base.select("i", V.l2_zero_safe(F.col("v")).alias("x"), F.lit(1).alias("_one")), ["i"], "_one", "_at")
    units = cut(units.select((F.col("_at") - 1).cast("long").alias("at"), "x"))
    d = units.select(F.size("x")).first()[0]
    q = units.agg(F.sum(V.dot(F.col("x"), F.col("x")))).first()[0]
    edges, squares = np.cumsum(sizes), []
    step = max(1, numbers // (k * d))
    for first in range(1, n_perm + 1, step):
        which = np.arange(first, min(first + step, n_perm + 1))

        def sums(b: pa.RecordBatch) -> np.ndarray:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y = np.searchsorted(edges, resampling.permuted(b.column(0).to_numpy(), n, which, seed), side="right")  # noqa: B023
            return np.stack([(y == c).T.astype(float) @ x for c in range(k)], axis=1).ravel()

        got = resampling.summed(units, ["at", "x"], sums, len(which) * k * d).reshape(len(which), k, d)
        squares.append((got**2).sum(axis=(1, 2)))
        whole = (got[0].sum(axis=0) ** 2).sum()  # the sum over all rows, under any permutation
    ss = np.concatenate(squares)
    null = (1 - (whole - ss) / 2 / between) / (1 - (ss - q) / 2 / inside)
    o = separation_ratio(base, "y", "v").first().sep_ratio
    z = float((o - null.mean()) / null.std()) if null.std() > 0 else None
    return df.sparkSession.createDataFrame([(o, float(null.mean()), z, float(((null >= o).sum() + 1) / (n_perm + 1)), float(o - null.mean()))], schema)


def derive_confounds(metadata: DataFrame, labels: DataFrame, key: str = "patent_id", date: str = "priority_date", assignee: str = "assignee", pattern: str = "(?i)bell|textron") -> DataFrame:
    """Metadata with filing_year and is_bell; rows without labels get nulls."""
    year = F.coalesce(F.year(F.col(date).try_cast("date")), F.col(date).cast("string").try_cast("int"))
    facts = labels.groupBy(key).agg(F.min_by(F.struct(F.col(date), F.col(assignee)), F.struct(F.col(date).cast("string"), F.col(assignee))).alias("_f"))
    facts = facts.select(key, F.col("_f")[date].alias(date), F.col("_f")[assignee].alias(assignee))
    return metadata.drop(date, assignee).join(facts, key, "left").withColumns({"filing_year": year.cast("int"), "is_bell": F.col(assignee).rlike(pattern).cast("int")})


def confound_presence(df: DataFrame, label: str, confounds: list[str]) -> DataFrame:
    """By confound and class, the rows that have it and its mean: is it skewed by the label?"""
    cells = F.array(*[F.struct(F.lit(c).alias("confound"), F.col(c).cast("double").alias("v")) for c in confounds])
    return df.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.explode(cells).alias("e")).groupBy("e.confound", "label").agg(F.count("e.v").alias("n"), F.avg("e.v").alias("mean"))


def confound_decodability(df: DataFrame, idx: str, vec: str, binary: list[str], continuous: list[str], n_perm: int = 200, seed: int = 42) -> DataFrame:
    """(confound, measure, value): AUC of a logistic probe, Spearman of a ridge probe."""
    out = None
    for c in [*binary, *continuous]:
        got = logistic_probe(df, idx, c, vec, n_perm=n_perm, seed=seed).select(F.col("auc").alias("value")) if c in binary else ridge_cv(df, idx, c, vec, seed=seed).select(F.col("spearman").alias("value"))
        got = got.select(F.lit(c).alias("confound"), F.lit("auc" if c in binary else "spearman").alias("measure"), "value")
        out = got if out is None else out.unionByName(got)
    return out


def structure_report(matrices: DataFrame, idx: str, label: str, vec: str = "vec", n_perm_sep: int = 2000, n_perm_probe: int = 200, seed: int = 42) -> DataFrame:
    """sep_ratio, p_sep, probe_auc and mean silhouette of each (layer, pooling)."""
    out = None
    for layer, pooling in [tuple(r) for r in matrices.select("layer", "pooling").distinct().orderBy("layer", "pooling").collect()]:  # the matrices' names
        m = matrices.filter((F.col("layer") == layer) & (F.col("pooling") == pooling))
        sep = permutation_separation(m, idx, label, vec, n_perm_sep, seed).select(F.col("observed").alias("sep_ratio"), F.col("p_value").alias("p_sep"))
        row = sep.join(logistic_probe(m, idx, label, vec, n_perm=n_perm_probe, seed=seed).select(F.col("auc").alias("probe_auc")), F.lit(True))
        row = row.join(cosine_silhouette(m.filter(F.col(label).isNotNull()), idx, label, vec).agg(F.avg("silhouette").alias("silhouette")), F.lit(True))
        row = row.select(F.lit(layer).alias("layer"), F.lit(pooling).alias("pooling"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def distance_against_random(df: DataFrame, vec: str, seed: int = 42, idx: str | None = None) -> DataFrame:
    """Mean cosine distance over all pairs, of the rows and of a Gaussian matrix of the same shape, from sums.

    With ``idx`` the matrix is the one of ``stated_baseline``, the same for each id wherever the rows lie.
    """

    def mean_distance(rows: DataFrame, out: str) -> DataFrame:
        v, zero = V.as_double(F.col("v")), F.lit(0.0)
        size = F.sqrt(F.aggregate(v, zero, lambda s, x: s + x * x))
        u = rows.select(v.alias("v"), F.when(size == 0, 1.0).otherwise(size).alias("size"))  # a column, so that it is found once a row
        cells = u.select(F.posexplode("v").alias("d", "x"), "size").select("d", (F.col("x") / F.col("size")).alias("x"))
        whole = cells.groupBy("d").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("q"))
        whole = whole.agg(F.sum(F.col("x") * F.col("x")).alias("tt"), F.sum("q").alias("q"))
        return whole.join(rows.agg(F.count("*").alias("n")), F.lit(True)).select((1 - (F.col("tt") - F.col("q")) / (F.col("n") * (F.col("n") - 1))).alias(out))

    if idx:
        df = spread(df.select(idx, vec), idx)
    chance = stated_baseline(df, idx, vec, seed) if idx else random_baseline(df, vec, seed)
    return mean_distance(df.select(F.col(vec).alias("v")), "real_mean").join(mean_distance(chance.select(F.col(vec).alias("v")), "random_mean"), F.lit(True))


def first_component_gate(df: DataFrame, vec: str, seed: int = 42, least: float = 3.0) -> DataFrame:
    """Variance share of the first component against a random matrix's; passes from ``least`` times."""
    unit = df.select(V.l2_zero_safe(F.col(vec)).alias(vec))
    rand = random_baseline(df, vec, seed).select(V.l2_zero_safe(F.col(vec)).alias(vec))
    real, chance = (pca_variance(x, vec, 1).select(F.col("explained").alias(c)) for x, c in ((unit, "real"), (rand, "random")))
    return real.join(chance, F.lit(True)).withColumn("ratio", F.col("real") / F.col("random")).withColumn("passed", F.col("ratio") >= least)


def best_row(df: DataFrame, by: str, ties: list[str], group: list[str] | None = None) -> DataFrame:
    """The row (of each group) with the greatest ``by``; among equals the least by ``ties``."""
    others = [c for c in df.columns if c not in (group or [])]
    least = F.struct((-F.col(by)).alias("_b"), *[F.col(c) for c in ties], *[F.col(c).alias(f"_{i}") for i, c in enumerate(others)])
    got = df.filter(F.col(by).isNotNull()).groupBy(*(group or [])).agg(F.min(least).alias("r")).filter("r is not null")
    return got.select(*(group or []), *[F.col(f"r._{i}").alias(c) for i, c in enumerate(others)])


# The measures that the verdicts test, with their limits.
GATES = {
    "pc1_ratio": (">=", 3.0), "silhouette_found": (">", 0.10), "bootstrap_ari": (">", 0.60), "dominant_share": ("<=", 0.90), "silhouette": (">", 0.15),
    "davies_bouldin": ("<", 2.0), "stability_ari": (">", 0.60), "sep_ratio": (">", 1.0), "p_sep": ("<", 0.05), "probe_auc": (">", 0.65),
    "ari": (">", 0.10), "nmi": (">", 0.10), "p_enrich": ("<", 0.05), "design_signal": (">", 0.2), "invisible_signal": ("<", 0.2),
}


def gate(measure: str, value: Column) -> Column:
    """Whether ``value`` passes the gate of its measure; null doesn't."""
    sign, limit = GATES[measure]
    test = {">": value > limit, ">=": value >= limit, "<": value < limit, "<=": value <= limit}[sign]
    return F.coalesce(test & ~F.isnan(value.cast("double")), F.lit(False))


def gates(measured: DataFrame) -> DataFrame:
    """(measure, value, sign, limit, passed) of (measure, value); unknown measures raise nothing and don't pass."""
    table = measured.sparkSession.createDataFrame([(m, s, x) for m, (s, x) in GATES.items()], "measure string, sign string, `limit` double")
    v, x = F.col("value").cast("double"), F.col("limit")
    test = F.when(F.col("sign") == ">", v > x).when(F.col("sign") == ">=", v >= x).when(F.col("sign") == "<", v < x).otherwise(v <= x)
    return measured.join(F.broadcast(table), "measure", "left").select("measure", "value", "sign", "limit", F.coalesce(test & ~F.isnan(v), F.lit(False)).alias("passed"))  # a row a gate


def signal(kind: Column, value: Column, chance: Column) -> Column:
    """Decodability above chance between 0 and 1: |rho|, AUC or accuracy."""
    return F.when(kind == "spearman", F.abs(value)).when(kind == "auc", F.greatest(F.lit(0.0), (value - 0.5) / 0.5)).otherwise(F.greatest(F.lit(0.0), (value - chance) / (1 - chance)))
