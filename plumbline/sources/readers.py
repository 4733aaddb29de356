"""Readers for what the reference reads: CSV and parquet globs, image folders, and Python data sources for
xlsx sheets, npy matrices and plain file listings (S1-S12, S15-S17).

The Python data sources open files by path, so they read from folders every executor can see.
"""

from __future__ import annotations

import glob
import json
import os
import re
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StructField, StructType

from plumbline.functions.text import IMAGE_NAME, SAMPLE_NAME
from plumbline.schemas import PROCESSING_MANIFEST, REVIEW_LONG
from plumbline.sources.npy import NpySource
from plumbline.sources.pushdown import FILTERED, Pushed

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class _File(InputPartition):
    def __init__(self, rank: int, path: str):
        self.rank, self.path = rank, path


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _sheets(z: zipfile.ZipFile) -> list:
    return list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"))


def sheet_names(path: str) -> list[str]:
    with zipfile.ZipFile(path) as z:
        return [s.get("name") for s in _sheets(z)]


def sheet_rows(path: str, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Rows of one sheet (the first by default) as text; gaps are None. Standard library only."""
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), rels[s.get(f"{_REL}id")]) for s in _sheets(z)]
        target = next((t for n, t in sheets if sheet in (None, n)), None)
        if target is None:
            raise ValueError(f"{path}: no sheet {sheet!r}; it has {[n for n, _ in sheets]}")
        with z.open("xl/" + target.lstrip("/").removeprefix("xl/")) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                out: list[str | None] = []
                for c in row:
                    at = _column(c.get("r")) if c.get("r") else len(out)
                    out += [None] * (at - len(out))
                    kind, v = c.get("t"), c.find(f"{_NS}v")
                    if kind == "inlineStr":
                        out.append("".join(t.text or "" for t in c.iter(f"{_NS}t")))
                    elif v is None or v.text is None:
                        out.append(None)
                    elif kind == "s":
                        out.append(shared[int(v.text)])
                    else:
                        out.append({"0": "False", "1": "True"}[v.text] if kind == "b" else v.text)
                yield out
                row.clear()


class _XlsxReader(DataSourceReader):
    """Filters on _source_file choose files, those on _sheet choose sheets, those on cells are applied before a row leaves Python.

    Files and sheets that are not chosen are not opened.
    """

    def __init__(self, schema, options):
        self.names, self.options, self.pushed = [f.name for f in schema.fields], options, Pushed()
        self.cells = [f.name for f in schema.fields if f.dataType.simpleString() == "string"]

    def partitions(self):
        files = sorted(glob.glob(self.options["path"]))
        if not files:
            raise FileNotFoundError(self.options["path"])
        return [_File(i, p) for i, p in enumerate(files) if self.pushed.passes(_source_file=os.path.basename(p))] or [_File(0, "")]

    def read(self, part):
        if not part.path:
            return
        one = self.options.get("sheet")
        chosen = [one] if one or "_sheet" not in self.names else [s for s in sheet_names(part.path) if self.pushed.passes(_sheet=s)]
        for s, name in enumerate(chosen):
            rows = sheet_rows(part.path, name)
            at = {n: i for i, n in enumerate(next(rows, []))}
            for k, r in enumerate(rows):
                own = {"_source_file": os.path.basename(part.path), "_sheet": name, "row_ord": part.rank * (1 << 40) + s * (1 << 32) + k}
                row = {n: own[n] if n in own else r[at[n]] if n in at and at[n] < len(r) else None for n in self.names}
                if self.pushed.passes(**{n: row[n] for n in self.pushed.by}):
                    yield tuple(row.values())


class _FilteredXlsxReader(_XlsxReader):
    def pushFilters(self, filters):
        yield from self.pushed.take(filters, self.cells)


class XlsxSource(DataSource):
    """Options: path (glob), sheet (the first by default). Only the columns of the given schema are built.

    It emits _source_file and row_ord; with a column _sheet in the schema and no option, every sheet's rows with their sheet's name.
    """

    @classmethod
    def name(cls):
        return "xlsx"

    def schema(self):
        return REVIEW_LONG

    def reader(self, schema):
        return (_FilteredXlsxReader if FILTERED in self.options else _XlsxReader)(schema, dict(self.options))


class _Listing(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _ListingReader(DataSourceReader):
    """Filters on the path are applied to names, before a file's size is asked for; folders that a prefix rules out are not read."""

    def __init__(self, options):
        self.options, self.pushed = options, Pushed()

    def _may_hold(self, folder: str) -> bool:
        return all(f"{folder}/".startswith(p) or p.startswith(f"{folder}/") for p in self.pushed.prefixes("path"))

    def partitions(self):
        base = self.options["path"].rstrip("/")
        if not os.path.isdir(base):
            raise FileNotFoundError(base)
        subs = sorted(e.path for e in os.scandir(base) if e.is_dir()) if self.options.get("recursive", "true") == "true" else []
        return [_Listing(base, False), *[_Listing(s, True) for s in subs if self._may_hold(s)]]

    def read(self, part):
        for d, dirs, files in os.walk(part.path) if part.deep else [(part.path, [], [e.name for e in os.scandir(part.path) if e.is_file()])]:
            dirs[:] = [x for x in dirs if self._may_hold(os.path.join(d, x))]
            for f in files:
                p = os.path.join(d, f)
                if self.pushed.passes(path=p):
                    s = os.stat(p)
                    yield p, s.st_size, datetime.fromtimestamp(s.st_mtime, UTC)


class _FilteredListingReader(_ListingReader):
    def pushFilters(self, filters):
        yield from self.pushed.take(filters, ("path",))


class ListingSource(DataSource):
    """Every file with its size and time of change, empty ones included. Options: path, recursive. One partition per subfolder."""

    @classmethod
    def name(cls):
        return "listing"

    def schema(self):
        return "path string, bytes long, modified timestamp"

    def reader(self, schema):
        return (_FilteredListingReader if FILTERED in self.options else _ListingReader)(dict(self.options))


def register(spark: SparkSession) -> None:
    for s in (XlsxSource, NpySource, ListingSource):
        spark.dataSource.register(s)


def scan(spark: SparkSession, source: str, where: Column | str | None = None, schema: str | StructType | None = None, **options: str) -> DataFrame:
    """Rows of a Python data source that meet ``where``, whose conditions the reader takes before it opens anything.

    A relation of Spark 4.1 keeps the filters of its last query and applies them to the next one, whatever that asks
    for. So filters are offered only here, to a relation that nothing reaches but through ``where``, and what a caller
    filters further stays in Spark.
    """
    register(spark)
    reader = spark.read.format(source).options(**options, **({} if where is None else {FILTERED: "true"}))
    df = (reader.schema(schema) if schema else reader).load()
    if where is None:
        return df
    df, key = df.filter(where), "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set(key, before)
    return df


def review_long(spark: SparkSession, pattern: str, sheet: str = "Review", where: Column | str | None = None) -> DataFrame:
    """Every Review sheet of the glob in file order. Legacy single files are a glob of one.

    ``where`` chooses files (by _source_file) and rows while they are read.
    """
    return scan(spark, "xlsx", where, REVIEW_LONG, path=pattern, sheet=sheet)


def sheet(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Chosen columns of a workbook's first sheet, or all of them, as text, with row_ord."""
    columns = sheet_columns(path) if columns is None else columns
    fields = ", ".join(f"`{c}` string" for c in columns)
    return scan(spark, "xlsx", where, f"{fields}, row_ord long", path=path)


def matching_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, in order, in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(s.getPath().toString() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or [])


def csv_by_header(spark: SparkSession, pattern: str) -> DataFrame:
    """A CSV glob in file order, each file's columns found by its own header; what a file lacks is null there. All text."""
    files = matching_files(spark, pattern)
    if not files:
        raise FileNotFoundError(pattern)
    out = None
    for i, f in enumerate(files):
        df = spark.read.option("header", True).csv(f).withColumn("row_ord", F.struct(F.lit(i).alias("file"), F.monotonically_increasing_id().alias("row")))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def processing_manifest(spark: SparkSession, pattern: str, soft: bool = False) -> DataFrame | None:
    """Manifests of a glob by their headers, columns in any order, the optional ones absent or not.

    ``soft`` returns None where no file matches. Truth is what a typed CSV column holds: true or 1.
    """
    if soft and not matching_files(spark, pattern):
        return None
    df = csv_by_header(spark, pattern)
    truth = lambda c: F.lower(F.col(c)).isin("true", "1", "1.0")
    kinds = {f.name: f.dataType.simpleString() for f in PROCESSING_MANIFEST.fields}
    have = [truth(c).alias(c) if t == "boolean" else F.col(c) for c, t in kinds.items() if c in df.columns]
    lack = [F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c not in df.columns]
    return df.select(*have, *lack, "row_ord")


def stage_result(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A report that a stage wrote as CSV, with the types of ``schema`` or those found in it."""
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def configured_reviews(cfg: dict) -> str:
    """The glob of review sheets, or where it isn't set the single file of the older configuration."""
    taxonomy = cfg.get("taxonomy") or {}
    found = taxonomy.get("wizard_excel_glob") or taxonomy.get("wizard_excel")
    if not found:
        raise ValueError("neither taxonomy.wizard_excel_glob nor taxonomy.wizard_excel is set")
    return str(found)


def sheet_columns(path: str, sheet_name: str | None = None) -> list[str]:
    """The header of a workbook's sheet, for a scan of all of it."""
    return [c for c in next(sheet_rows(path, sheet_name), []) if c is not None]


def image_paths(spark: SparkSession, folder: str, recursive: bool = True, where: Column | str | None = None) -> DataFrame:
    """Image files of a folder and below, empty ones too, sorted by path. A prefix in ``where`` spares folders."""
    df = scan(spark, "listing", where, path=folder, recursive=str(recursive).lower())
    return df.filter(F.col("path").rlike(IMAGE_NAME)).orderBy("path")


def sample_images(spark: SparkSession, folder: str) -> DataFrame:
    """Png and jpeg files of a folder itself, sorted by path; none is an error."""
    df = image_paths(spark, folder, recursive=False).filter(F.col("path").rlike(SAMPLE_NAME))
    if not df.limit(1).count():
        raise FileNotFoundError(f"no png or jpeg files in {folder}")
    return df


def image_bytes(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Path and content; the decode itself belongs to the model."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    return df.select("path", "content").filter(F.col("path").rlike(IMAGE_NAME))


def with_content(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with the content of each, read by the task that has the row; a file that is gone by then has null.

    For some files of a large folder, of which ``binaryFile`` would read every one.
    """
    fields = StructType([*files.schema.fields, StructField("content", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                try:
                    with open(one.column(b.schema.get_field_index(path))[0].as_py().removeprefix("file:"), "rb") as f:
                        data = f.read()
                except FileNotFoundError:
                    data = None
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([data], pa.binary())], names=[*b.schema.names, "content"])

    return files.mapInArrow(run, fields)


def embedding_bundle(spark: SparkSession, folder: str, layers: list[int], poolings: list[str]) -> DataFrame:
    """Npy matrices zipped with metadata.parquet on row_idx. Files of other matrices are not opened."""
    m = scan(spark, "npy", F.col("layer").isin(layers) & F.col("pooling").isin(poolings), path=folder)
    return spark.read.parquet(os.path.join(folder, "metadata.parquet")).join(m, "row_idx")


def model_info(spark: SparkSession, folder: str) -> dict:
    """The facts beside a bundle's matrices; {} where there are none."""
    files = matching_files(spark, f"{folder}/model_info.json")
    return json.loads("\n".join(r.value for r in spark.read.text(files[0], wholetext=True).collect())) if files else {}
