"""Explicit schemas and the column checks every entry point uses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**cols) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


LONG_COLUMNS = ["Patent_ID", "Section", "Sub_Dimension", "Field", "Value", "Source", "Image_Path"]
REQUIRED_LONG = ["Patent_ID", "Section", "Field", "Value", "Image_Path"]
REVIEW_LONG = T.StructType([T.StructField(c, S) for c in [*LONG_COLUMNS, "_source_file"]] + [T.StructField("row_ord", L)])
PROCESSING_MANIFEST = _struct(
    src_path=S, dst_main=S, dst_all=S, processed=B, base_patent_id=S, arch=S, is_main=B, bg_sty=S, bg_col=S, ac_sty=S, ac_col=S
)
EMBEDDING_MATRIX = T.StructType(
    [T.StructField("row_idx", L), T.StructField("figure_id", S), T.StructField("patent_id", S), T.StructField("figure_type", S)]
    + [T.StructField("layer", I), T.StructField("pooling", S), T.StructField("vec", T.ArrayType(T.FloatType()))]
)
MODEL_INFO = _struct(model_name=S, variant=S, num_hidden_layers=I, hidden_dim=I, num_register_tokens=I, n_prefix=I, device=S)
MASK_RECORD = T.ArrayType(
    T.StructType(
        [
            T.StructField("bbox", T.ArrayType(D)),
            T.StructField("area", L),
            T.StructField("predicted_iou", D),
            T.StructField("stability_score", D),
        ]
    )
)


def require_columns(df: DataFrame, cols: Iterable[str], what: str = "input") -> DataFrame:
    """``df`` itself, or a ValueError naming what is missing."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: missing columns {missing}; it has {df.columns}")
    return df


def project_or_null(df: DataFrame, cols: Iterable[str], placeholder: str = "EDIT-ME") -> DataFrame:
    """Configured columns in order; absent ones become NULL, placeholder names are skipped."""
    wanted = [c for c in cols if c and placeholder not in c]
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in wanted])
