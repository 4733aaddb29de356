"""Writers (K1-K6) and reuse of written results."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.labels import column_dictionary
from plumbline.sources.npy import matrix_name
from plumbline.sources.readers import register


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Spark's file systems, so that any store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def save_matrix(matrix: DataFrame, folder: str, info: dict) -> None:
    """K1: vectors partitioned by layer and pooling (so loads prune), and the model's facts."""
    matrix.write.mode("overwrite").partitionBy("layer", "pooling").parquet(f"{folder}/vectors")
    write_text(matrix.sparkSession, f"{folder}/model_info.json", json.dumps(info, indent=1))


def export_npy(matrix: DataFrame, folder: str) -> list[str]:
    """K1: one ``emb_layer<L>_<pooling>.npy`` per matrix and metadata.parquet, in order of row_idx.

    Each task writes its slice of rows, so no matrix is ever in one place. Rows must be numbered 0..n-1 within each
    matrix and have one length; anything else, or a failed task, leaves no file.
    """
    register(matrix.sparkSession)
    size = F.size("vec")
    facts = matrix.groupBy("layer", "pooling").agg(F.count("*").alias("n"), F.count("vec").alias("given"), F.min("row_idx").alias("first"), F.max("row_idx").alias("last"), F.min(size).alias("short"), F.max(size).alias("long"))
    shapes = {}
    for r in sorted(facts.collect(), key=lambda r: (r.layer, r.pooling)):  # one row a matrix
        if (r.first, r.last) != (0, r.n - 1) or r.short != r.long or r.given < r.n:
            raise ValueError(f"layer {r.layer}, {r.pooling}: rows {r.first}..{r.last} for {r.n} vectors of length {r.short}..{r.long}")
        shapes[matrix_name(r.layer, r.pooling)] = (r.n, r.short)
    order = ["layer", "pooling", "row_idx"]
    rows = matrix.select(*order, F.col("vec").cast("array<float>").alias("vec")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.format("npy").mode("append").option("path", folder).option("shapes", json.dumps(shapes)).save()
    meta = [c for c in matrix.columns if c not in ("layer", "pooling", "vec")]
    matrix.select(*meta).dropDuplicates(["row_idx"]).write.mode("overwrite").parquet(os.path.join(folder, "metadata.parquet"))
    return list(shapes)


def append_loss(spark: SparkSession, path: str, epoch: int, losses: list[float]) -> None:
    """K8: one epoch's batch losses to the history that ``pairs.epoch_loss`` reads; an epoch written again replaces itself."""
    rows = spark.createDataFrame([(epoch, i, float(x)) for i, x in enumerate(losses)], "epoch int, batch int, loss double")
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/epoch_{epoch:03d}")


def loss_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("epoch int, batch int, loss double").option("header", True).csv(f"{path}/epoch_*")


def save_masks(masks: DataFrame, folder: str) -> None:
    """K9: mask records as JSON lines, a row an image."""
    masks.write.mode("overwrite").json(folder)


def load_matrix(spark: SparkSession, folder: str, layers: list[int], poolings: list[str]) -> DataFrame:
    df = spark.read.parquet(f"{folder}/vectors")
    return df.filter(df.layer.isin(layers) & df.pooling.isin(poolings))


def save_canonical(canon: DataFrame, folder: str) -> None:
    """K2-K4: parquet and CSV of the canonical table and its column dictionary."""
    canon.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    done = canon.sparkSession.read.parquet(f"{folder}/labels.parquet")
    done.write.mode("overwrite").option("header", True).csv(f"{folder}/labels.csv")
    save_report(column_dictionary(done), f"{folder}/dictionary.csv")


def save_report(report: DataFrame, path: str) -> None:
    """K6: a report is small; one file."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_pipeline(matrix: DataFrame, folder: str, info: dict, settings: dict, commit: str | None = None) -> None:
    """The matrix and a manifest of how it was made."""
    save_matrix(matrix, folder, info)
    doc = {**settings, "git_commit": commit, "created": datetime.now(UTC).isoformat(), "model_info": info}
    write_text(matrix.sparkSession, f"{folder}/manifest.json", json.dumps(doc, indent=1, default=str))


def reuse_or_build(spark: SparkSession, folder: str, digest: str, build: Callable[[], DataFrame]) -> DataFrame:
    """S16 without staleness: the folder is named by the digest of the configuration."""
    path = f"{folder}/{digest}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
