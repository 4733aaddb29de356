"""The reference's operators on crafted rows, and every query with SQL against DuckDB."""

import zipfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import catalog, embeddings, encode, labels, lineage, pairs
from plumbline.queries import ORACLES, QUERIES
from plumbline.sources import readers

LONG = "Patent_ID string, Section string, Field string, Value string, Image_Path string, _source_file string, row_ord long"


def test_figure_names(spark):
    names = ["US2022267016A1_SHR_B64C2720_p003_c01", "US1_SHR_OPN_B64_p001_c01", "us1_shr_b64c_p003_c01", "some_random_filename"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in X.figure_name_fields(F.col("s")).items()]).collect()]
    assert got == [("US2022267016A1", "SHR", "B64C2720", "p003_c01"), ("US1_SHR", "OPN", "B64", "p001_c01"), ("us1", "SHR", "B64C", "p003_c01"), ("some_random_filename", None, None, None)]


def test_arch_parse(spark):
    df = spark.createDataFrame([("US1", None), ("US1_arch2", "x"), ("X_arch2_arch3", None), ("Y", " 3 "), ("Y", "2.7")], "p string, a string")
    got = df.select(X.arch_base(F.col("p")), X.arch_index(F.col("a"), F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("US1", 1), ("US1", 2), ("X_arch2", 3), ("Y", 3), ("Y", 2)]


def test_pivots_differ_on_nulls(spark):
    df = spark.createDataFrame([("a", "f", None, 1), ("a", "f", "v2", 2), ("b", "f", None, 3), ("c", "f", "x", 4), ("c", "f", None, 5)], "k string, f string, v string, o int")
    assert {r.k: r.f for r in labels.pivot_first_non_null(df, ["k"], "f", "v", "o").collect()} == {"a": "v2", "c": "x"}
    assert {r.k: r.f for r in labels.pivot_keep_last(df, ["k"], "f", "v", "o").collect()} == {"a": "v2", "b": None, "c": None}


@pytest.mark.parametrize("years,want", [
    ([2009, 2010, 2012, 2015, 2019, 2021], ["(2008.999, 2011.333]"] * 2 + ["(2011.333, 2016.333]"] * 2 + ["(2016.333, 2021.0]"] * 2),
    ([5, 5, 5, 5, 7, 9], ["(4.999, 5.667]"] * 4 + ["(5.667, 9.0]"] * 2), ([5, 5, 5], [None] * 3), ([1, 2], [None] * 2),
])
def test_quantile_labels(spark, years, want):
    df = spark.createDataFrame([(i, float(y)) for i, y in enumerate(years)], "i int, y double")
    assert [r.b for r in labels.add_quantile_bin(df, "y", "b", 3).orderBy("i").collect()] == want


def test_duplicate_roots_with_cycles(spark):
    e = [("A", "B"), ("B", "C"), ("P", "Q"), ("Q", "P"), ("T", "P"), ("S", "S"), ("D", "gone"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("t1", "t2"), ("t2", "c2")]
    ids = sorted({x for x, _ in e} | {"C", "free"})
    got = dict(lineage.duplicate_roots(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(e, "src string, dst string")).collect())
    assert got == {"A": "C", "B": "C", "C": "C", "P": "P", "Q": "Q", "T": "P", "S": "S", "D": "gone", "c1": "c1", "c2": "c2", "c3": "c3", "t1": "c2", "t2": "c2", "free": "free"}


def test_canonical_end_to_end(spark):
    rows = [
        ("U1", "G1", "type", "quad", None, "a", 1), ("U1", "G1", "type", "hex", None, "a", 2), ("U1_arch2", "M1", "n", "4", None, "b", 3), ("U1", "G1", "Notes", "skip", None, "a", 4),
        ("U1", "T2", "isMain", "True", "p1", "a", 5), ("U1", "T2", "status", "approved", "p1", "a", 6), ("U1", "T2", "per", "side", "p1", "a", 7), ("U1", "G1", "xhumanUncertain", "yes", None, "a", 8),
    ]
    meta = spark.createDataFrame([("U1", "ACME", "US", "2010", "B64C 1/00; B64D", 1)], "`Record Number` string, Assignee string, `Assignee Country` string, `Priority Year` string, `CPC Main Group (CPCG)` string, row_ord int")
    man = spark.createDataFrame([("p1", None, "old", True, 1), ("p1", None, "new", True, 2)], "src_path string, dst_main string, dst_all string, processed boolean, row_ord int")
    canon, _ = labels.build_canonical(spark.createDataFrame(rows, LONG), meta, man, ingest_date="2026-01-01")
    got = {r.Patent_ID: r.asDict() for r in canon.collect()}
    one, two = got["U1"], got["U1_arch2"]
    assert (one["G1_type"], one["n_architectures"], one["image_path"], one["perspective"], one["any_uncertain"], one["cpc_subclass"]) == ("hex", 2, "new", "side", True, "B64C")
    assert (two["M1_n"], two["arch_index"], two["image_path"], two["assignee"], two["any_uncertain"]) == ("4", 2, None, "ACME", False)
    assert "G1_Notes" not in canon.columns and labels.attribute_columns(canon) == ["G1_type", "M1_n"]
    assert [(r.issue[:5], r.n) for r in labels.validate_canonical(canon).collect()] == [("archi", 1)]


def test_manifest_rules(spark):
    m = spark.createDataFrame([("s1", "m1/x.png", None, True, "P", False), ("s2", None, "a/y.png", True, "Q", None), ("s3", "z", "z", None, "R", True)], "src_path string, dst_main string, dst_all string, processed boolean, base_patent_id string, is_main boolean")
    assert [(r.figure_id, r.figure_type, r.bg_sty) for r in catalog.figures_by_manifest(m).collect()] == [("y.png", "main", None)]
    assert [r.path for r in catalog.figures_by_manifest(m, "main").collect()] == ["m1/x.png"]
    with pytest.raises(KeyError):
        catalog.figures_by_manifest(m, "other")


def test_integrity_counts(spark):
    nan = float("nan")
    rows = [("a", [nan, 0.0]), ("b", [0.0, -0.0]), ("c", [-0.0, 0.0]), ("d", [nan, 0.0]), ("e", [float("inf"), 1.0])]
    m = spark.createDataFrame([(*r, 1, "cls") for r in rows], "figure_id string, vec array<float>, layer int, pooling string")
    r = embeddings.integrity(m).first()
    assert (r.nan_count, r.inf_count, r.all_zero_count, r.exact_duplicate_count) == (2, 1, 2, 1)
    with pytest.raises(ValueError):
        embeddings.validate_layers([25], ["cls"], 24)


def test_partners_differ_in_style(spark):
    df = spark.createDataFrame([(i, "c%d" % (i % 2), "s%d" % (i % 5 // 2)) for i in range(40)] + [(99, "alone", "s"), (98, None, "s")], "i int, c string, s string")
    row = {r.i: (r.c, r.s) for r in df.collect()}
    for got in (pairs.sampled_partner(df, "i", "c", "s").collect(), pairs.least_partner(df, "i", "c", "s").collect()):
        assert len(got) == 40 and all(row[r.anchor][0] == row[r.partner][0] and row[r.anchor][1] != row[r.partner][1] for r in got)
    one = spark.createDataFrame([(0, 0, [1.0, 2.0], [2.0, 1.0])], "b int, p int, x array<double>, y array<double>")
    assert pairs.nt_xent(one, "b", "x", "y", "p").first().loss == pytest.approx(0)


def test_encoder_is_deterministic_and_ordered(spark):
    df = spark.createDataFrame([(i, str(i), "p", "main", bytes([i])) for i in range(5)], "row_idx long, figure_id string, patent_id string, figure_type string, content binary")
    run = lambda: sorted(map(tuple, encode.encode_images(df, lambda: encode.HashEncoder(dim=3, layers=2), [1], ["cls", "mean_patch"]).select("row_idx", "pooling", "vec").collect()))
    assert run() == run() and len(run()) == 10


def test_xlsx_and_npy_sources(spark, tmp_path):
    head = ["Patent_ID", "Section", "Field", "Value", "Image_Path"]
    cells = lambda i, row: "".join(f'<c r="{"ABCDE"[k]}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(row) if v is not None)
    body = "".join(f"<row>{cells(i + 1, r)}</row>" for i, r in enumerate([head, ["U1", "T1", "isApproved", "True", None]]))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b1.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Review" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    r = readers.review_long(spark, str(tmp_path / "*.xlsx")).collect()
    assert [(x.Patent_ID, x.Value, x.Image_Path, x._source_file, x.row_ord) for x in r] == [("U1", "True", None, "b1.xlsx", 0)]
    np.save(tmp_path / "emb_layer3_cls.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    spark.createDataFrame([(i, f"f{i}") for i in range(3)], "row_idx long, figure_id string").write.parquet(str(tmp_path / "metadata.parquet"))
    got = readers.embedding_bundle(spark, str(tmp_path), [3, 9], ["cls"]).orderBy("row_idx").collect()
    assert [(x.figure_id, x.layer, list(x.vec)) for x in got] == [("f0", 3, [0, 1]), ("f1", 3, [2, 3]), ("f2", 3, [4, 5])]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, small, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings labels benchmark".split():
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    a, b = QUERIES[name](spark, small).toPandas(), con.sql(ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    text = lambda v: "" if pd.isna(v) else f"{float(v):.5f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
    rows = lambda d: sorted(tuple(text(v) for v in r) for r in d[cols].astype(object).itertuples(index=False))
    assert rows(a) == rows(b)
