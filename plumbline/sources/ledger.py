"""Results that notice changed inputs (S16): a ledger of inputs beside them, and work on what is new alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import cut

LEDGER = "path string, bytes long, modified timestamp, generation int"


def _entries(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the generations whose ledger is complete."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger/generation=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, modified, generation) of the inputs whose results are current; empty before the first build."""
    done = _entries(spark, folder)
    if not done:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{folder}/ledger/generation={done[-1]}")


def changes(inputs: DataFrame, known: DataFrame) -> DataFrame:
    """Inputs that are new, or whose length or time of change differ from the ledger's."""
    return inputs.join(known, ["path", "bytes", "modified"], "left_anti")


def refresh(spark: SparkSession, folder: str, digest: str, inputs: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of ``build`` for exactly the present ``inputs(path, bytes, modified)``, built only for new and changed ones.

    ``build`` gets the changed inputs and returns rows with their ``path``. Each refresh with changes writes a
    generation of rows and then a ledger that says which generation each input's rows are in. The ledger comes last,
    so a run that fails leaves the former state; rows of inputs that are gone or changed are no longer read. The
    folder is named by the digest of the configuration: another configuration starts anew.
    """
    base = f"{folder.rstrip('/')}/{digest}"
    inputs, known = cut(inputs.select("path", "bytes", "modified")), ledger(spark, base)  # listed once: what changes later differs from the ledger
    new = changes(inputs, known)
    gone = known.join(inputs, "path", "left_anti")
    done = _entries(spark, base)
    if not done or new.limit(1).count() or gone.limit(1).count():
        g = (done[-1] if done else 0) + 1
        build(new).write.mode("overwrite").parquet(f"{base}/rows/generation={g}")
        same = known.join(inputs, ["path", "bytes", "modified"], "left_semi")
        now = same.unionByName(new.withColumn("generation", F.lit(g)))
        now.select("path", "bytes", "modified", "generation").write.mode("overwrite").parquet(f"{base}/ledger/generation={g}")
        known = ledger(spark, base)
    rows = spark.read.option("basePath", f"{base}/rows").parquet(f"{base}/rows/generation=*")
    return rows.join(known.select("path", "generation"), ["path", "generation"], "left_semi").drop("generation")
