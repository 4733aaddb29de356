"""Running totals and ranks over a whole table, without a window that has all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut


def running_total(df: DataFrame, order: list[str], amount: str, out: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows up to this one in ``order``, which must tell rows apart.

    Rows are sorted by range and summed within their part; the parts' totals, a number each, are added before.
    """
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    at, start = 0, {}
    for p, n in sorted(tuple(r) for r in parts.groupBy("_part").agg(F.sum(amount)).collect()):  # one row a part
        start[p], at = at, at + (n or 0)
    before = F.create_map(*[F.lit(x) for pair in start.items() for x in pair])[F.col("_part")] if start else F.lit(0)
    return parts.withColumn(out, F.sum(amount).over(Window.partitionBy("_part").orderBy(*order)) + before).drop("_part")


def average_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """Ranks from 1 of the values of ``col``, ties sharing their mean; null has none."""
    values = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_value")).agg(F.count("*").alias("_n"))
    upto = running_total(values, ["_value"], "_n", "_upto").select("_value", (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(upto, df[col] == F.col("_value"), "left").drop("_value")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, ``spearman``: the correlation of tie-averaged ranks of the rows that have both."""
    both = cut(df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna())
    return average_rank(average_rank(both, "a", "ra"), "b", "rb").agg(F.corr("ra", "rb").alias("spearman"))
