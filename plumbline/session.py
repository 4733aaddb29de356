"""Session construction and cuts of lineage."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "plumbline", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE on and UTC pinned; cluster settings are left to spark-submit."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def table(spark: SparkSession, base: str, name: str):
    """One of the driver's tables; ``base`` may be any path Spark can read."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def placed(df: DataFrame, name: str) -> DataFrame:
    """A table that was read and not yet changed, with each row's place in its files: the files in order of name, then the row in its file."""
    # Spark lists a local file as file:///x and names it file:/x beside its rows.
    files = sorted(re.sub(r"^([\w+.-]+:)//(?=/)", r"\1", f) for f in df.inputFiles())
    own = df.select("*", F.col("_metadata.row_index").alias(name), F.col("_metadata.file_path").alias("_file"))
    if len(files) < 2:
        return own.drop("_file")
    ranks = F.broadcast(df.sparkSession.createDataFrame(list(zip(files, range(len(files)))), "_file string, _rank long"))
    rank = F.coalesce("_rank", F.raise_error(F.concat(F.lit("not among the files that were listed: "), "_file")).cast("long"))
    return own.join(ranks, "_file", "left").withColumn(name, rank * (1 << 40) + F.col(name)).drop("_file", "_rank")


def spread(df: DataFrame, by: str) -> DataFrame:
    """The rows dealt by a column over two tasks a core: a file's rows lie in as few tasks as it has row groups, often one."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, by)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session without the setting gets one of its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="plumbline-cut-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, so that lineage ends there and a lost executor costs a re-read."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def written(df: DataFrame, *folders: str) -> Iterator[DataFrame]:
    """The rows as Parquet in the shared folder while the block lasts: filters on the order they were written in skip files.

    With ``folders`` each value of those columns has a folder, so that a filter on them opens no other file at all.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    try:
        (df.write.partitionBy(*folders) if folders else df.write).parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def join_null_safe(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner", where: Column | None = None) -> DataFrame:
    """``a`` joined with ``b`` on columns of one name, null meeting null, and on ``where``; both may come from one written table."""
    right = b.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in b.columns])
    cond = where if where is not None else F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return a.join(right, cond, how).drop(*[f"_on_{c}" for c in on])
