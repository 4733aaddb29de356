"""Figure catalogue: file listings and processing manifests to figure rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators.lineage import dedupe_to_roots
from plumbline.schemas import require_columns

# Which target column each scope reads.
SCOPES = {"all": "dst_all", "main": "dst_main"}


def figures_by_name(paths: DataFrame) -> DataFrame:
    """T5 from ``paths(path)``: image files only, fields parsed from the file name, sorted by path."""
    s = X.stem(F.col("path"))
    return (
        paths.filter(F.col("path").rlike(X.IMAGE_NAME))
        .select(X.basename(F.col("path")).alias("figure_id"), *[c.alias(n) for n, c in X.figure_name_fields(s).items()], "path")
        .orderBy("path")
    )


def figures_by_manifest(manifest: DataFrame, scope: str = "all", existing_paths: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """Processed rows with a target in ``scope``; unknown scopes raise. ``roots`` drops non-root patents."""
    dst = SCOPES[scope]
    require_columns(manifest, ["src_path", "processed", dst, "base_patent_id"], "processing manifest")
    opt = lambda c, t="string": (F.col(c) if c in manifest.columns else F.lit(None)).cast(t)
    main = F.coalesce(opt("is_main", "boolean"), F.lit(True))
    out = manifest.filter(F.col("processed") & F.col(dst).isNotNull()).select(
        X.basename(F.col(dst)).alias("figure_id"), F.col("base_patent_id").alias("patent_id"),
        F.when(main, "main").otherwise("other").alias("figure_type"), F.col(dst).alias("path"), opt("arch").alias("arch"),
        main.alias("is_main"), *[opt(c).alias(c) for c in ("bg_sty", "bg_col", "ac_sty", "ac_col")],
    )
    if existing_paths is not None:
        out = out.join(existing_paths.select("path").distinct(), "path", "left_semi")
    return dedupe_to_roots(out, roots, "patent_id") if roots is not None else out


def dropped(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row, how many figures and patents a step (missing files, duplicate patents) has taken away."""
    n = lambda df, s: df.agg(F.count("*").alias(f"f{s}"), F.count_distinct("patent_id").alias(f"p{s}"))
    return n(before, 0).join(n(after, 1), F.lit(True)).select((F.col("f0") - F.col("f1")).alias("n_dropped_figures"), (F.col("p0") - F.col("p1")).alias("n_dropped_patents"))


def with_row_index(df: DataFrame, order: str, out: str = "row_idx") -> DataFrame:
    """Rows numbered from 0 without gaps in ``order``: sorted by range, numbered within parts, moved by the parts' sizes."""
    parts = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    kept = parts.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else parts.persist()
    sizes = sorted(tuple(r) for r in kept.groupBy("_p").count().collect())  # one row a part
    start, at = [], 0
    for p, n in sizes:
        start.append((p, at))
        at += n
    first = F.create_map(*[F.lit(x) for pair in start for x in pair]) if start else F.create_map(F.lit(0), F.lit(0))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return kept.withColumn(out, (local + first[F.col("_p")]).cast("long")).drop("_p")


def catalogue_counts(figures: DataFrame) -> DataFrame:
    """Figures, patents, unparsed names."""
    cat = F.col("shrouded_open") if "shrouded_open" in figures.columns else F.col("figure_type")
    return figures.agg(F.count("*").alias("n_figures"), F.count_distinct("patent_id").alias("n_patents"), F.count_if(cat.isNull()).alias("n_unparsed"))


def label_coverage(figures: DataFrame, labels: DataFrame, key: str = "patent_id") -> DataFrame:
    """Figures whose key the labels hold, against all."""
    hit = figures.join(labels.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_covered"))
    return hit.join(figures.agg(F.count("*").alias("n_figures")), F.lit(True))
