"""The three end-to-end plans: label export and audit, frozen extraction with QC, pair preparation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import catalog, embeddings, encode, labels, lineage, pairs
from plumbline.session import cut
from plumbline.sources import ledger, readers


def label_export(spark: SparkSession, reviews: str, metadata: str, *, ingest_date: str, manifest: str | None = None, image_dir: str | None = None, year_bins: int = 3) -> dict[str, DataFrame]:
    """Entry A. The pooled long frame is read once and persisted."""
    long = labels.pool_long([readers.review_long(spark, reviews)]).persist()
    cols = ["Record Number", "Assignee", "Assignee Country", "Priority Year", "Publication/Issue Date", "CPC Main Group (CPCG)"]
    meta = readers.sheet(spark, metadata, cols)
    seen = readers.image_paths(spark, image_dir).select("path") if image_dir else None
    man = readers.processing_manifest(spark, manifest, soft=True) if manifest else None
    canon, images = labels.build_canonical(long, meta, man, seen, ingest_date=ingest_date, year_bins=year_bins)
    return {
        "triples": labels.triple_counts(long), "overlaps": labels.overlap_between_files(long), "canonical": canon, "images": images,
        "coverage": labels.coverage_table(canon, only_with_image=True), "issues": labels.validate_canonical(canon),
        "counts": labels.metadata_counts(canon), "image_counts": labels.image_counts(images), "batches": labels.batch_summary(long), "duplicate_types": labels.duplicate_type_counts(long),
    }


def frozen_extraction(spark: SparkSession, manifest: str, make: Callable[[], encode.Encoder], layers: list[int], poolings: list[str], *, reviews: str | None = None, scope: str = "all", seed: int = 42) -> dict[str, DataFrame]:
    """Entry B: figures, their vectors and the gated report; missing files (S17) and duplicates leave with a count.

    ``reviews`` switches the dedupe to roots on.
    """
    roots = None
    man = readers.processing_manifest(spark, manifest)
    if reviews:
        long = readers.review_long(spark, reviews)
        roots = lineage.duplicate_roots(long.select(F.col("Patent_ID").alias("id")), lineage.duplicate_edges(long))
    listed = catalog.figures_by_manifest(man, scope)
    folders = [r.f for r in listed.select(F.regexp_replace("path", "/[^/]*$", "").alias("f")).distinct().collect()]  # the folders' names only
    seen = None
    for f in folders:
        if readers.matching_files(spark, f):
            here = readers.image_paths(spark, f).select("path")
            seen = here if seen is None else seen.unionByName(here)
    found = listed.join(seen.distinct(), "path", "left_semi") if seen is not None else listed.limit(0)
    figures = lineage.dedupe_to_roots(found, roots, "patent_id") if roots is not None else found
    ranked = catalog.with_row_index(figures, "path")
    content = spark.read.format("binaryFile").load(folders).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    matrix = encode.encode_images(ranked.join(content, "path"), make, layers, poolings)
    report = embeddings.qc_report(matrix, make().info, seed=seed)
    return {
        "figures": figures, "matrix": matrix, "report": report, "gate": embeddings.qc_gate(report),
        "missing": catalog.dropped(listed, found), "duplicates": catalog.dropped(found, figures),
    }


def refreshed_extraction(spark: SparkSession, images: str, store: str, make: Callable[..., encode.Encoder], layers: list[int], poolings: list[str], settings: str = "") -> DataFrame:
    """Entry B over a folder, again and again: (path, layer, pooling, vec ...) of the files that are there now, encoding new and changed ones alone.

    Results are kept in ``store`` for one model, layers and poolings; another ``settings``, layer or pooling starts anew.
    """
    digest = hashlib.sha256(repr((sorted(layers), sorted(poolings), settings)).encode()).hexdigest()[:16]
    name = F.regexp_replace("path", "^.*/", "")

    def build(files: DataFrame) -> DataFrame:
        rows = cut(files.select("path").withColumn("row_idx", F.monotonically_increasing_id()))
        figures = readers.with_content(rows).withColumns({"figure_id": name, "patent_id": F.lit(None).cast("string"), "figure_type": F.lit("main")})
        return encode.encode_images(figures, make, layers, poolings).join(rows, "row_idx").drop("row_idx")

    return ledger.refresh(spark, store, digest, readers.image_paths(spark, images), build)


def pair_preparation(canon: DataFrame, class_col: str, style_cols: list[str], *, seed: int = 42, epoch: int = 0, min_count: int = 2) -> dict[str, DataFrame]:
    """Entry C up to the gradient step: eligible rows and this epoch's partner of each."""
    table = pairs.pair_table(canon, class_col, style_cols, min_count)
    return {"pair_table": table, "pairs": pairs.sampled_partner(table, "path", class_col, "style_key", seed, epoch)}
