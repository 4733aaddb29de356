"""Embedding matrices: integrity, variance, cosine statistics, aggregation and the QC gate.

A matrix is a long frame with ``layer``, ``pooling`` and one ARRAY per row, so every report is
grouped by (layer, pooling) in one job, whatever the number of matrices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators.quantiles import exact_quantiles
from plumbline.session import cut

KEYS = ["layer", "pooling"]
POOLINGS = ("cls", "mean_patch")


def validate_layers(layers: list[int], poolings: list[str], num_hidden_layers: int) -> None:
    """P22."""
    if not layers or not poolings:
        raise ValueError("layers and poolings must not be empty")
    if bad := [x for x in layers if not 0 <= x <= num_hidden_layers]:
        raise ValueError(f"layers {bad} lie outside 0..{num_hidden_layers}")
    if bad := [p for p in poolings if p not in POOLINGS]:
        raise ValueError(f"unknown poolings {bad}")


def integrity(m: DataFrame, vec: str = "vec") -> DataFrame:
    """A12/A13. NaN rows are never equal to one another; 0.0 and -0.0 are."""
    v = F.col(vec)
    bad = F.exists(v, lambda x: F.isnan(x))
    plus = F.transform(V.as_double(v), lambda x: x + F.lit(0.0))
    return m.groupBy(*KEYS).agg(
        F.max(F.size(v)).alias("emb_dim"),
        F.sum(V.nan_cells(v)).alias("nan_count"),
        F.sum(V.inf_cells(v)).alias("inf_count"),
        F.count_if(V.all_zero(v)).alias("all_zero_count"),
        (F.count("*") - F.count_if(bad) - F.count_distinct(F.when(~bad, plus))).alias("exact_duplicate_count"),
    )


def dimension_variance(m: DataFrame, vec: str = "vec", dead: float = 1e-8) -> DataFrame:
    """Population variance of each dimension, then its mean, least and greatest."""
    cells = m.select(*KEYS, F.posexplode(V.as_double(F.col(vec))).alias("pos", "x"))
    return cells.groupBy(*KEYS, "pos").agg(F.var_pop("x").alias("v")).groupBy(*KEYS).agg(
        F.avg("v").alias("dim_var_mean"), F.min("v").alias("dim_var_min"), F.max("v").alias("dim_var_max"), F.count_if(F.col("v") < dead).alias("near_dead_dims")
    )


def seeded_order(id_col: str, seed: int) -> Column:
    """An order that any engine reproduces: md5 of id and seed."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """Without replacement, min(n, size) rows of each group; the same rows at every run."""
    order = [seeded_order(id_col, seed), F.col(id_col)]
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def pairwise_cosine(sample: DataFrame, id_col: str, vec: str = "vec") -> DataFrame:
    """i<j pairs within each matrix, one matrix product per group; for bounded samples (the report's is 512 rows)."""
    rows = sample.select(*KEYS, F.col(id_col).alias("i"), V.as_double(F.col(vec)).alias("v"))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        m = np.array(pdf["v"].tolist(), dtype=np.float64)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        u = m / np.where(norm == 0, 1.0, norm)
        a, b = np.triu_indices(len(u), 1)
        ids = pdf["i"].to_numpy()
        return pd.DataFrame({"layer": pdf["layer"].iloc[0], "pooling": pdf["pooling"].iloc[0], "i": ids[a], "j": ids[b], "cos": (u @ u.T)[a, b]})

    kind = dict(rows.dtypes)["i"]
    return rows.groupBy(*KEYS).applyInPandas(product, f"layer int, pooling string, i {kind}, j {kind}, cos double")


def cosine_stats(pairs: DataFrame) -> DataFrame:
    """Population deviation, interpolated percentiles."""
    p = F.percentile("cos", [0.05, 0.5, 0.95])
    return pairs.groupBy(*KEYS).agg(F.avg("cos").alias("cos_mean"), F.stddev_pop("cos").alias("cos_std"), p.alias("p")).select(
        *KEYS, "cos_mean", "cos_std", F.col("p")[0].alias("cos_p05"), F.col("p")[1].alias("cos_p50"), F.col("p")[2].alias("cos_p95")
    )


def figures_per_patent(m: DataFrame) -> DataFrame:
    """Counts per patent; null patents are left out of them."""
    per = cut(m.groupBy(*KEYS, "patent_id").count())
    named = F.when(F.col("patent_id").isNotNull(), F.col("count"))
    counts = per.groupBy(*KEYS).agg(
        F.sum("count").alias("n_figures"), F.count("patent_id").alias("n_patents"), F.min(named).alias("fig_per_patent_min"), F.max(named).alias("fig_per_patent_max")
    )
    middle = exact_quantiles(per.select(*KEYS, named.alias("n")), "n", [0.5], KEYS).select(*KEYS, F.col("quantiles")[0].alias("fig_per_patent_median"))
    return counts.join(middle, KEYS).select(*KEYS, "n_figures", "n_patents", "fig_per_patent_min", "fig_per_patent_median", "fig_per_patent_max")


def qc_report(m: DataFrame, info: dict | None = None, sample_size: int = 512, seed: int = 42, id_col: str = "figure_id") -> DataFrame:
    """T14, 26 columns, one row per matrix, sorted. Four aggregations of one scan joined on the matrix key."""
    info = info or {}
    sample = seeded_sample(m, id_col, sample_size, seed, KEYS)
    out = integrity(m).join(figures_per_patent(m), KEYS).join(dimension_variance(m), KEYS, "left").join(cosine_stats(pairwise_cosine(sample, id_col)), KEYS, "left")
    const = {"variant": "string", "num_hidden_layers": "int", "hidden_dim": "int", "num_register_tokens": "int", "n_prefix": "int"}
    out = out.withColumns({("n_layers" if k == "num_hidden_layers" else k): F.lit(info.get(k)).cast(t) for k, t in const.items()})
    return out.select(
        *KEYS, "variant", "n_layers", "hidden_dim", "num_register_tokens", "n_prefix", "emb_dim", "n_figures", "n_patents", "fig_per_patent_min",
        "fig_per_patent_median", "fig_per_patent_max", "nan_count", "inf_count", "all_zero_count", "exact_duplicate_count", "dim_var_mean", "dim_var_min",
        "dim_var_max", "near_dead_dims", "cos_mean", "cos_std", "cos_p05", "cos_p50", "cos_p95",
    ).orderBy(*KEYS)


BAD_ROW = "nan_count > 0 or inf_count > 0 or all_zero_count > 0"


def qc_gate(report: DataFrame) -> DataFrame:
    """One row, whether every matrix is free of NaN, Inf and zero rows. An empty report passes."""
    return report.agg(F.coalesce(F.bool_and(~F.expr(BAD_ROW)), F.lit(True)).alias("passed"), F.count_if(F.expr(BAD_ROW)).alias("n_bad"))


def vector_mean(df: DataFrame, key: str, vec: str = "vec", method: str = "mean") -> DataFrame:
    """A10: mean per dimension and key, then unit length (zero stays zero); null keys dropped; sorted."""
    if method in ("canonical", "per_figure_type"):
        raise NotImplementedError(f"aggregation {method!r} is not defined")
    if method != "mean":
        raise ValueError(f"unknown aggregation {method!r}")
    cells = df.filter(F.col(key).isNotNull()).select(key, F.posexplode(V.as_double(F.col(vec))).alias("pos", "x"))
    means = cells.groupBy(key, "pos").agg(F.avg("x").alias("m"))
    packed = means.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("s"))
    return packed.select(key, V.l2_zero_safe(F.transform("s", lambda e: e["m"])).alias("vec")).orderBy(key)


def zip_rows(matrix: DataFrame, metadata: DataFrame) -> DataFrame:
    """Positional join on row_idx; unequal row counts raise."""
    a, b = matrix.count(), metadata.count()
    if a != b:
        raise ValueError(f"{a} vectors but {b} metadata rows")
    return metadata.join(matrix, "row_idx")


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int = 60) -> DataFrame:
    """Equal-width counts; the top edge belongs to the last bin."""
    b = F.least(F.floor((F.col(col) - low) / ((high - low) / bins)), F.lit(bins - 1))
    return df.filter(F.col(col).between(low, high)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))
