"""Extension: label batches arriving as files re-pivot incrementally (the reference only polls a glob)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def keep_last_stream(stream: DataFrame, key: str, field: str, value: str, order: str) -> DataFrame:
    """Latest value of each (key, field): the streaming form of the keep-last pivot, before the pivot."""
    return stream.groupBy(key, field).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def start_repivot(stream: DataFrame, key: str, field: str, value: str, order: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the wide table anew after each micro-batch, from the state's latest values."""
    from plumbline.operators.labels import pivot_keep_last

    def sink(batch: DataFrame, epoch: int) -> None:
        pivot_keep_last(batch, [key], field, value, order).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    latest = keep_last_stream(stream, key, field, value, order)
    return latest.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(spark: SparkSession, folder: str, schema: str, ts: str, by: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts with a watermark over a file stream."""
    s = spark.readStream.schema(schema).parquet(folder)
    return s.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"))
