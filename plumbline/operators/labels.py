"""Entity-attribute-value label engine: pivots, joins, binning and audit over the long frame.

Every function takes and returns DataFrames. Physical row order of the inputs is explicit in
``row_ord`` (file rank, then row), so first/last are ``min_by``/``max_by`` on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators.quantiles import exact_quantiles
from plumbline.schemas import REQUIRED_LONG, require_columns

# Sections, fields and names the label format defines.
DESIGN_SECTIONS = ("G1", "M1", "M2", "M3")
DROP_FIELDS = ("dinoUnderstanding", "footAmbiguous")
DROP_PATTERN = r"(?i)(quickOverride|humanUncertain|quickCount|Notes?$|_notes$|otherNote)"
STYLE_FIELDS = ("per", "acSty", "acCol", "bgSty", "bgCol", "parts", "acState", "qualityFlag")
NON_ATTRIBUTES = (
    "Patent_ID", "base_patent_id", "arch_index", "n_architectures", "multi_arch", "assignee", "assignee_country", "priority_year", "year_bin",
    "cpc_first", "cpc_subclass", "any_uncertain", "image_path", "figure_id", "figure_type", "path", "patent_id", "perspective", "acSty", "acCol",
    "bgSty", "bgCol", "parts", "acState", "qualityFlag", "label_source_file", "ingest_date", "Publication/Issue Date",
)


#: Source files that are numbered in an aggregate; names of more are aggregated as they are.
FILES = 1000


def pool_long(frames: list[DataFrame]) -> DataFrame:
    """Union by name in file order; mandatory columns checked; null ids rejected."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return require_columns(out, REQUIRED_LONG, "long label frame").filter(F.col("Patent_ID").isNotNull())


def overlap_between_files(long: DataFrame, file: str = "_source_file", key: str = "Patent_ID") -> DataFrame:
    """For each pair of files, how many distinct keys both hold, and the five smallest."""
    d = long.select(F.col(file).alias("f"), F.col(key).alias("k")).dropna().distinct()
    a, b = d.alias("a"), d.alias("b")
    hit = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.f") < F.col("b.f"))).select(
        F.col("a.f").alias("file_a"), F.col("b.f").alias("file_b"), F.col("a.k").alias("k")
    )
    w = Window.partitionBy("file_a", "file_b").orderBy("k")
    return (
        hit.withColumn("rn", F.row_number().over(w))
        .groupBy("file_a", "file_b")
        .agg(F.count("*").alias("n_shared"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("rn") <= 5, F.col("k").cast("string")))), ",").alias("sample"))
    )


def triple_counts(long: DataFrame) -> DataFrame:
    """A1/O1: rows per (Section, Sub_Dimension, Field); null keys dropped; sorted."""
    keys = ["Section", "Sub_Dimension", "Field"]
    return long.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n_rows")).orderBy(*keys)


def pivot_first_non_null(df: DataFrame, keys: list[str], field: str, value: str, order: str, fields: list | None = None) -> DataFrame:
    """A2: first non-null value per key and field; keys with only nulls disappear."""
    return _pivot(df.filter(F.col(value).isNotNull()), keys, field, value, order, fields, F.min_by)


def pivot_keep_last(df: DataFrame, keys: list[str], field: str, value: str, order: str, fields: list | None = None) -> DataFrame:
    """The last row wins even when its value is null; keys with only nulls remain."""
    return _pivot(df, keys, field, value, order, fields, F.max_by)


def _pivot(df: DataFrame, keys: list[str], field: str, value: str, order: str, fields: list | None, pick, flags: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """All fields of a key in one aggregate; a null field is the column ``null``.

    ``flags`` names further columns, each a field and an expression of the value. Spark aggregates numbers and booleans
    by hashing, but sorts all rows for a single text; so who needs only the flags of a field should read those.
    """
    if fields is None:
        fields = [r[0] for r in df.groupBy(field).count().orderBy(field).collect()]  # the columns to be
    of = lambda f: F.when(F.col(field).eqNullSafe(F.lit(f)) & F.col(order).isNotNull(), F.col(order))
    cells = [pick(F.col(value), of(f)).alias("null" if f is None else str(f)) for f in fields]
    cells += [pick(c, of(f)).alias(name) for name, (f, c) in (flags or {}).items()]
    return df.groupBy(*keys).agg(*cells) if cells else df.select(*keys).distinct()


def surplus_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that keep-last discards, as one count."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_surplus"))


def design_rows(long: DataFrame, drop_fields: tuple[str, ...] = DROP_FIELDS) -> DataFrame:
    """Attribute rows; a null field is kept, as its text form ``nan``."""
    f = F.coalesce(F.col("Field"), F.lit("nan"))
    return long.filter(F.col("Section").isin(*DESIGN_SECTIONS) & ~f.isin(*drop_fields) & ~f.rlike(DROP_PATTERN))


def with_distinct_count(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Distinct values per group on every row, by a grouped count joined back (no distinct window)."""
    return df.join(df.groupBy(*keys).agg(F.count_distinct(value).alias(out)), keys, "left")


def build_wide(long: DataFrame, drop_fields: tuple[str, ...] = DROP_FIELDS) -> DataFrame:
    rows = design_rows(long, drop_fields).withColumn("_col", F.concat_ws("_", F.coalesce("Section", F.lit("nan")), F.coalesce("Field", F.lit("nan"))))
    wide = pivot_keep_last(rows, ["Patent_ID"], "_col", "Value", "row_ord")
    wide = wide.withColumns({"base_patent_id": X.arch_base(F.col("Patent_ID")), "arch_index": X.arch_number(F.col("Patent_ID"))})
    wide = with_distinct_count(wide, ["base_patent_id"], "arch_index", "n_architectures")
    return wide.withColumn("n_architectures", F.col("n_architectures").cast("int")).withColumn("multi_arch", F.col("n_architectures") > 1)


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the first by ``order`` (nulls last), combined before the shuffle."""
    cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
    rank = F.struct(F.col(f"`{order}`").isNull().alias("none"), F.col(f"`{order}`").alias("o"))
    got = df.groupBy(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*cols), rank).alias("r"))
    return got.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(df.columns)])


def uncertain_flag(df: DataFrame, unsure: DataFrame, key: str = "Patent_ID", out: str = "any_uncertain") -> DataFrame:
    """Whether the row's key is among ``unsure``."""
    hit = unsure.select(key).distinct().withColumn("_u", F.lit(True))
    return df.join(hit, key, "left").withColumn(out, F.coalesce("_u", F.lit(False))).drop("_u")


def first_source(long: DataFrame, key: str = "Patent_ID", source: str = "_source_file", order: str = "row_ord", out: str = "label_source_file") -> DataFrame:
    """The file that a key is first seen in. Up to FILES files are numbered, so that rows are aggregated by hashing."""
    files = [r[0] for r in long.select(source).distinct().limit(FILES + 1).collect()]
    if len(files) > FILES:
        return long.groupBy(key).agg(F.min_by(source, order).alias(out))
    number = F.coalesce(F.create_map(*[F.lit(x) for i, f in enumerate(files) if f is not None for x in (f, i)])[F.col(source)], F.lit(-1)) if any(f is not None for f in files) else F.lit(-1)
    first = long.groupBy(key).agg(F.min_by(number, order).alias("_n"))
    return first.select(key, F.get(F.array(*[F.lit(f).cast("string") for f in files]), F.when(F.col("_n") >= 0, F.col("_n"))).alias(out) if files else F.lit(None).cast("string").alias(out))


def join_metadata(wide: DataFrame, meta: DataFrame, id_col: str = "Record Number", bins: int = 3, order: str = "row_ord") -> DataFrame:
    """N:1 left join; CPC list reduced to its head and subclass; year quantile-binned after the join."""
    require_columns(meta, [id_col], "metadata")
    names = {"Assignee": "assignee", "Assignee Country": "assignee_country", "Priority Year": "priority_year", "CPC Main Group (CPCG)": "_cpc"}
    have = [c for c in [*names, "Publication/Issue Date"] if c in meta.columns]
    m = keep_first(meta, [id_col], order).select(F.col(f"`{id_col}`").alias("base_patent_id"), *[F.col(f"`{c}`").alias(names.get(c, c)) for c in have])
    for c in [*names.values(), "Publication/Issue Date"]:
        if c not in m.columns:
            m = m.withColumn(c, F.lit(None).cast("string"))
    m = m.withColumn("cpc_first", X.first_listed(F.col("_cpc"))).withColumn("cpc_subclass", F.substring("cpc_first", 1, 4)).drop("_cpc")
    m = m.withColumn("priority_year", F.col("priority_year").try_cast("double"))
    return add_quantile_bin(wide.join(m, "base_patent_id", "left"), "priority_year", "year_bin", bins)


def quantile_edges(df: DataFrame, col: str, q: int) -> DataFrame:
    """One row: the distinct exact percentile edges and the number of values, by distributed selection."""
    got = exact_quantiles(df, col, [i / q for i in range(q + 1)])
    return got.select(F.array_distinct("quantiles").alias("edges"), "n_valid")


def bin_index(value: Column, edges: Column) -> Column:
    """Right-closed bins, the lowest edge included; null outside or with fewer than two edges."""
    below = F.size(F.filter(edges, lambda e: e < value))
    return F.when(value.isNotNull() & (F.size(edges) > 1), F.greatest(below, F.lit(1)).cast("int"))


def _edge_text(e: float) -> str:
    r = round(e, 3)
    return repr(float(r))


def add_quantile_bin(df: DataFrame, col: str, out: str, q: int) -> DataFrame:
    """Interval labels such as ``(2008.999, 2011.333]``; all null with under q values or one edge."""
    row = quantile_edges(df, col, q).first()  # q + 1 numbers
    edges = row["edges"] or []
    if row["n_valid"] < q or len(edges) < 2:
        return df.withColumn(out, F.lit(None).cast("string"))
    shown = [_edge_text(edges[0] - 1e-3), *[_edge_text(e) for e in edges[1:]]]
    labels = F.array(*[F.lit(f"({a}, {b}]") for a, b in zip(shown, shown[1:])])
    return df.withColumn(out, F.get(labels, bin_index(F.col(col).cast("double"), F.array(*[F.lit(e) for e in edges])) - 1))


def image_table(long: DataFrame, existing_paths: DataFrame | None = None) -> DataFrame:
    """A2 on the image section, with index and flags; ``existing_paths(path)`` drives image_exists."""
    rows = long.filter((F.col("Section") == "T2") & F.col("Image_Path").isNotNull())
    value = F.col("Value")
    flags = {"is_main": ("isMain", X.truthy(value, ("main",))), "approved": ("status", F.lower(value) == "approved")}
    img = _pivot(rows.filter(value.isNotNull()), ["Patent_ID", "Image_Path"], "Field", "Value", "row_ord", None, F.min_by, flags)
    for c in ("isMain", "status", "arch"):
        if c not in img.columns:
            img = img.withColumn(c, F.lit(None).cast("string"))
    pid = F.col("Patent_ID")
    img = img.withColumns(
        {
            "base_patent_id": X.arch_base(pid),
            "arch_index": X.arch_index(F.col("arch"), pid),
            "is_main": F.coalesce("is_main", F.lit(False)),
            "approved": F.coalesce("approved", F.lit(False)),
        }
    )
    if existing_paths is None:
        return img.withColumn("image_exists", F.lit(True))
    seen = existing_paths.select(F.col("path").alias("Image_Path")).distinct().withColumn("_e", F.lit(True))
    return img.join(seen, "Image_Path", "left").withColumn("image_exists", F.coalesce("_e", F.lit(False))).drop("_e")


def select_main_images(images: DataFrame) -> DataFrame:
    """First approved, existing main image of each architecture."""
    ok = images.filter("is_main and approved and image_exists")
    rank = F.struct("Image_Path", "Patent_ID")  # tells images apart, so the columns come from one row, and those nobody reads are not carried
    keep = [F.min_by(c, rank).alias("perspective" if c == "per" else c) for c in STYLE_FIELDS if c in images.columns]
    return ok.groupBy("base_patent_id", "arch_index").agg(F.min("Image_Path").alias("image_path"), *keep)


def metadata_counts(canon: DataFrame) -> DataFrame:
    """A20 of the label export: architectures, patents, rows without metadata, without an image, and unsure ones."""
    return canon.agg(
        F.count("*").alias("n_rows"), F.count_distinct("base_patent_id").alias("n_patents"), F.count_if(F.col("assignee").isNull()).alias("n_unmatched"),
        F.count_if(F.col("image_path").isNotNull()).alias("n_with_image"), F.count_if(F.col("any_uncertain")).alias("n_uncertain"), F.count_if(F.col("multi_arch")).alias("n_multi_arch"),
    )


def image_counts(images: DataFrame) -> DataFrame:
    """How many images, mains, and mains lost for want of a file."""
    return images.agg(
        F.count("*").alias("n_images"),
        F.count_if(F.expr("is_main and approved")).alias("n_main"),
        F.count_if(F.expr("is_main and approved and not image_exists")).alias("n_main_missing"),
    )


def remap_paths(sel: DataFrame, manifest: DataFrame | None, path: str = "image_path", order: str = "row_ord") -> DataFrame:
    """Processed path per source path, the last row winning; unknown or null targets keep the raw path."""
    if manifest is None:
        return sel
    m = manifest.filter(F.col("processed")).groupBy("src_path").agg(F.max_by(F.coalesce("dst_main", "dst_all"), order).alias("_dst"))
    return sel.join(m, sel[path] == m["src_path"], "left").withColumn(path, F.coalesce("_dst", path)).drop("_dst", "src_path")


def build_canonical(
    long: DataFrame, meta: DataFrame, manifest: DataFrame | None = None, existing_paths: DataFrame | None = None, *,
    ingest_date: str, year_bins: int = 3, drop_fields: tuple[str, ...] = DROP_FIELDS, exclude_uncertain: bool = False,
    main_arch_only: bool = False, id_col: str = "Record Number",
) -> tuple[DataFrame, DataFrame]:
    """Entry A: (canonical, images). J2, J4, J5 and F13 (date injected) on top of the parts above."""
    wide = join_metadata(build_wide(long, drop_fields), meta, id_col, year_bins)
    unsure = long.filter(F.lower("Field").contains("humanuncertain") & X.truthy(F.col("Value")))
    images = image_table(long, existing_paths)
    mains = remap_paths(select_main_images(images), manifest)
    canon = (
        uncertain_flag(wide, unsure).join(mains, ["base_patent_id", "arch_index"], "left")
        .join(first_source(long), "Patent_ID", "left")
        .withColumn("ingest_date", F.lit(ingest_date))
    )
    if exclude_uncertain:
        canon = canon.filter(~F.col("any_uncertain"))
    if main_arch_only:
        canon = canon.filter("arch_index = 1")
    return canon, images


def attribute_columns(df: DataFrame) -> list[str]:
    """Every column that isn't bookkeeping."""
    return [c for c in df.columns if c not in NON_ATTRIBUTES]


def melt(df: DataFrame, cols: list[str], name: str = "attribute", value: str = "class") -> DataFrame:
    """One pass over all columns, as (name, value) rows; no column gives no rows."""
    if not cols:
        return df.sparkSession.createDataFrame([], f"{name} string, `{value}` string")
    pairs = F.array(*[F.struct(F.lit(c).alias("n"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols])
    return df.select(F.explode(pairs).alias("p")).select(F.col("p.n").alias(name), F.col("p.v").alias(value))


def coverage_table(canon: DataFrame, cols: list[str] | None = None, min_class_count: int = 15, only_with_image: bool = False) -> DataFrame:
    """Class counts of each attribute, its null share, and which classes are too small."""
    df = canon.filter(F.col("image_path").isNotNull()) if only_with_image else canon
    long = melt(df, attribute_columns(df) if cols is None else cols)
    per = long.groupBy("attribute", "class").agg(F.count("*").alias("n"))
    share = per.groupBy("attribute").agg((F.sum(F.when(F.col("class").isNull(), F.col("n")).otherwise(0)) * 100.0 / F.sum("n")).alias("p"))
    return (
        per.filter(F.col("class").isNotNull()).join(share, "attribute")
        .select("attribute", "class", "n", F.bround("p", 1).alias("null_pct"), (F.col("n") < min_class_count).alias("below_min"))
        .orderBy(F.asc("attribute"), F.desc("n"), F.asc("class"))
    )


def column_dictionary(df: DataFrame, cols: list[str] | None = None, top: int = 25) -> DataFrame:
    """Type, null share, distinct count and the first sorted values of each column."""
    cols = df.columns if cols is None else cols
    kinds = dict(df.dtypes)
    per = melt(df, cols, "column", "v").groupBy("column", "v").agg(F.count("*").alias("n"))
    parts = 64  # each part of a column keeps its own least values, so that no task sorts a whole column
    w = Window.partitionBy("column", "part").orderBy(F.col("v").asc_nulls_last())
    types = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(kinds[c]))])
    return (
        per.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts))).withColumn("rn", F.row_number().over(w)).groupBy("column")
        .agg(
            F.bround(F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)) * 100.0 / F.sum("n"), 1).alias("null_pct"),
            F.count("v").alias("n_unique"),
            F.array_join(F.slice(F.array_sort(F.collect_list(F.when(F.col("rn") <= top, F.col("v")))), 1, top), "; ").alias("observed_values"),
        )
        .withColumn("dtype", types[F.col("column")])
    )


def validate_canonical(canon: DataFrame, order: str = "Patent_ID") -> DataFrame:
    """Issues found, each with a count and the first ten ids. No issue gives no rows."""
    w = Window.partitionBy("base_patent_id", "arch_index").orderBy(order)
    kinds = [
        ("duplicate (base_patent_id, arch_index)", F.col("_rn") > 1, F.col("Patent_ID")),
        ("architecture without approved main image", F.col("image_path").isNull(), F.col("Patent_ID")),
        ("no PatSeer metadata match", F.col("assignee").isNull(), F.col("base_patent_id")),
    ]
    issue = F.array(*[F.when(c, F.struct(F.lit(i).alias("k"), F.lit(n).alias("issue"), d.cast("string").alias("id"))) for i, (n, c, d) in enumerate(kinds)])
    flat = canon.withColumn("_rn", F.row_number().over(w)).select(F.col(order).alias("_o"), F.explode(F.filter(issue, lambda x: x.isNotNull())).alias("x"))
    shown = flat.groupBy("x.k", "x.issue", "x.id").agg(F.count("*").alias("n"), F.min("_o").alias("_o"))
    top = Window.partitionBy("k", "part").orderBy("_o", "id")
    return (
        shown.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("rn", F.row_number().over(top)).groupBy("k", "issue")
        .agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.collect_list(F.when(F.col("rn") <= 10, F.struct("_o", "id")))), 1, 10).alias("d"))
        .orderBy("k").select("issue", "n", F.array_join(F.transform("d", lambda e: e["id"]), ", ").alias("detail"))
    )


def batch_summary(long: DataFrame) -> DataFrame:
    """Reviewed ids and approvals per file; unresolved can be negative."""
    t1 = long.filter(F.col("Section") == "T1")
    v = F.lower(F.col("Value"))
    is_flag = F.col("Field") == "isApproved"
    return (
        t1.groupBy(F.col("_source_file").alias("batch"))
        .agg(F.count_distinct("Patent_ID").alias("n_reviewed"), F.count_if(is_flag & (v == "true")).alias("n_approved"), F.count_if(is_flag & (v == "false")).alias("n_disapproved"))
        .withColumn("n_unresolved", F.col("n_reviewed") - F.col("n_approved") - F.col("n_disapproved"))
    )


def duplicate_type_counts(long: DataFrame) -> DataFrame:
    """By file and value, whatever the section."""
    return long.filter("Field = 'duplicateType'").dropna(subset=["_source_file", "Value"]).groupBy("_source_file", "Value").agg(F.count("*").alias("n")).orderBy("_source_file", "Value")


def value_counts(df: DataFrame, cols: list[str], top: int = 20) -> DataFrame:
    """The most frequent combinations, null rows dropped, ties by value."""
    return df.dropna(subset=cols).groupBy(*cols).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *cols).limit(top)
