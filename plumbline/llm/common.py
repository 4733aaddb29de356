"""What the operators share: input columns, scratch tables in the shared folder, Arrow mapping, seeded buckets."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Ids up to this many may be broadcast (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 2_000_000
#: Most rows and bytes of an Arrow batch: what a Python worker holds at once, whatever the texts' lengths.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the id's text, modulo: the folds of the contracts."""
    return F.crc32(F.col(doc_id).cast("string")) % mod


def docs_view(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, under fixed names, so that other columns can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def id_kind(df: DataFrame, id_col: str = "doc_id") -> str:
    """The id column's type, which results keep."""
    return df.schema[id_col].dataType.simpleString()


class Scratch:
    """Tables in the folder that spark.checkpoint.dir names, which driver and executors share.

    Lineage ends at each table, so a lost executor costs one task's re-read. Where the setting is absent
    (a local session, as in tests) a folder of this machine is used; on a cluster its absence is an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="plumbline-")
            spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        self.spark, self.path = spark, f"{base.rstrip('/')}/plumbline-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._leave)

    def keep(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Writes ``df`` and reads it again; an empty frame keeps its schema. ``options`` are the writer's."""
        to = f"{self.path}/{name}"
        df.write.option("compression", "zstd").options(**options).mode("overwrite").parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def keep_with(self, df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict]:
        """``keep``, with aggregates of the rows that are taken while they are written, so without another job."""
        seen = Observation()
        return self.keep(df.observe(seen, *measures), name), seen.get

    def drop(self, name: str = "") -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _leave(self) -> None:
        with contextlib.suppress(Exception):
            self.drop()


def arrow(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> Callable[[DataFrame], DataFrame]:
    """``mapInArrow`` for ``transform``, under batches of at most BATCH; the session's own limits stay where they are lower."""

    def mapped(df: DataFrame) -> DataFrame:
        conf = df.sparkSession.conf
        for key, most in BATCH.items():
            own = re.fullmatch(r"(\d+)b?", conf.get(key))
            if not own or not 0 < int(own[1]) <= most:
                conf.set(key, str(most))
        return df.mapInArrow(f, schema)

    return mapped


def dealt(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Rows of bucket 0 to n - 1 in a task of their own for each bucket, sorted by bucket and ``order``."""
    return df.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", *order)


def rows_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def only(df: DataFrame, ids: DataFrame, key: str, n_ids: int) -> DataFrame:
    """Rows of ``df`` whose key is among ``ids``: broadcast while the counted ids are few, else a shuffled semi-join."""
    ids = ids.select(key).distinct()
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, key, "left_semi")
