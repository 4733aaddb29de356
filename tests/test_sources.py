"""Readers, sinks, configuration, entry points and the stream on small files."""

import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import encode, pairs
from plumbline.plans import entrypoints
from plumbline.sources import config, readers, sinks
from plumbline.streaming import arrivals


def book(path, sheets):
    """A workbook of text cells: {sheet name: rows}."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for i, rows in enumerate(sheets.values()):
            cells = lambda k, row: "".join(f'<c r="{chr(65 + j)}{k}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(row) if v is not None)  # noqa: B023, E731
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{''.join(f'<row>{cells(k + 1, r)}</row>' for k, r in enumerate(rows))}</sheetData></worksheet>")


def test_manifests_are_read_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("src_path,dst_main,dst_all,processed,base_patent_id,is_main\ns1,m1,a1,True,P1,False\ns2,,a2,False,P2,\n")
    (tmp_path / "b.csv").write_text("processed,base_patent_id,dst_all,extra,src_path\n1,P3,a3,x,s1\n,P4,a4,y,s4\n")
    got = readers.processing_manifest(spark, str(tmp_path / "*.csv")).orderBy("row_ord").collect()
    assert [(r.src_path, r.dst_main, r.dst_all, r.processed, r.base_patent_id, r.is_main, r.bg_sty) for r in got] == [
        ("s1", "m1", "a1", True, "P1", False, None), ("s2", None, "a2", False, "P2", None, None), ("s1", None, "a3", True, "P3", None, None), ("s4", None, "a4", None, "P4", None, None),
    ]
    assert readers.processing_manifest(spark, str(tmp_path / "none*.csv"), soft=True) is None
    with pytest.raises(FileNotFoundError):
        readers.processing_manifest(spark, str(tmp_path / "none*.csv"))


def test_listings_and_samples(spark, tmp_path):
    for n in ("b.PNG", "a.jpg", "c.bmp", "note.txt", "sub/d.tif", "sub/e.webp"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"" if n == "a.jpg" else b"x")
    name = lambda df: [os.path.basename(r.path) for r in df.collect()]
    assert name(readers.image_paths(spark, str(tmp_path))) == ["a.jpg", "b.PNG", "c.bmp", "d.tif", "e.webp"]
    assert name(readers.sample_images(spark, str(tmp_path))) == ["a.jpg", "b.PNG"]
    assert "e.webp" in name(readers.image_bytes(spark, str(tmp_path)))
    with pytest.raises(FileNotFoundError):
        readers.sample_images(spark, str(tmp_path / "sub"))
    with pytest.raises(Exception, match="nowhere"):
        readers.image_paths(spark, str(tmp_path / "nowhere")).collect()


def test_bundles_round_trip(spark, tmp_path):
    rows = [(i, f"f{i}", "p", "main", layer, "cls", [float(i), float(layer)]) for i in range(5) for layer in (1, 2)]
    m = spark.createDataFrame(rows, encode.MATRIX).repartition(3)
    names = sinks.export_npy(m, str(tmp_path / "npy"))
    assert names == ["emb_layer1_cls.npy", "emb_layer2_cls.npy"] and np.load(tmp_path / "npy" / names[1]).tolist() == [[i, 2] for i in range(5)]
    back = readers.embedding_bundle(spark, str(tmp_path / "npy"), [1, 2], ["cls"])
    assert sorted((r.row_idx, r.layer, tuple(r.vec)) for r in back.collect()) == sorted((r[0], r[4], tuple(r[6])) for r in rows)
    sinks.save_pipeline(m, str(tmp_path / "pipe"), {"hidden_dim": 2}, {"lr": 1})
    assert sinks.load_matrix(spark, str(tmp_path / "pipe"), [2], ["cls"]).count() == 5
    assert readers.model_info(spark, str(tmp_path / "pipe")) == {"hidden_dim": 2} and readers.model_info(spark, str(tmp_path)) == {}
    assert json.loads((tmp_path / "pipe" / "manifest.json").read_text())["lr"] == 1


def test_loss_history_masks_and_reports(spark, tmp_path):
    for epoch, losses in ((1, [2.0, 4.0]), (2, [1.0]), (2, [1.5])):
        sinks.append_loss(spark, str(tmp_path / "loss"), epoch, losses)
    assert {r.epoch: r.avg_loss for r in pairs.epoch_loss(sinks.loss_history(spark, str(tmp_path / "loss"))).collect()} == {1: 3.0, 2: 1.5}
    images = spark.createDataFrame([("a", b"123456")], "path string, content binary")
    masks = encode.mask_images(images, lambda: lambda b: [{"bbox": [0.0], "area": k, "predicted_iou": 1.0, "stability_score": 1.0} for k in (1, len(b))])
    sinks.save_masks(masks, str(tmp_path / "masks"))
    assert [m.area for m in spark.read.json(str(tmp_path / "masks")).first().masks] == [6, 1]
    sinks.save_report(spark.range(3), str(tmp_path / "r.csv"))
    assert readers.stage_result(spark, str(tmp_path / "r.csv")).dtypes == [("id", "int")] and readers.stage_result(spark, str(tmp_path / "r.csv"), "id long").count() == 3
    made = []
    build = lambda: made.append(1) or spark.range(2)
    assert sinks.reuse_or_build(spark, str(tmp_path), "x", build).count() == sinks.reuse_or_build(spark, str(tmp_path), "x", build).count() == 2 and len(made) == 1


def test_configuration(tmp_path, monkeypatch):
    monkeypatch.setenv("BASE_DIR", "/data")
    (tmp_path / ".env").write_text("# note\nBASE_DIR=/ignored\nOTHER_DIR='/other'\n")
    (tmp_path / "c.yaml").write_text("paths:\n  a: $BASE_DIR/x\n  b: rel/y\n  c: EDIT-ME\n  d: $OTHER_DIR\ntaxonomy:\n  wizard_excel: one.xlsx\n")
    cfg = config.load_config(tmp_path / "c.yaml")
    assert cfg["paths"] == {"a": "/data/x", "b": str(tmp_path / "rel/y"), "c": None, "d": "/other"}
    assert readers.configured_reviews(cfg) == "one.xlsx" and readers.configured_reviews({"taxonomy": {"wizard_excel_glob": "*.xlsx", "wizard_excel": "one"}}) == "*.xlsx"
    with pytest.raises(ValueError):
        readers.configured_reviews({})
    assert config.config_digest(cfg) != config.config_digest({})


def test_entry_points(spark, tmp_path):
    head = ["Patent_ID", "Section", "Field", "Value", "Image_Path"]
    files = [tmp_path / "img" / n for n in ("a.png", "b.png", "c.png")]
    (tmp_path / "img").mkdir()
    for f in files[:2]:
        f.write_bytes(f.name.encode())
    rows = [["U1", "G1", "type", "quad"], ["U2", "G1", "type", "hex"], ["U1", "T2", "isMain", "True", str(files[0])], ["U1", "T2", "status", "approved", str(files[0])], ["U2", "META", "duplicateId", "U1"], ["U1", "T1", "isApproved", "True"]]
    book(tmp_path / "r1.xlsx", {"Other": [["x"]], "Review": [head, *rows]})
    book(tmp_path / "meta.xlsx", {"S": [["Record Number", "Assignee", "Unused"], ["U1", "ACME", "z"]]})
    assert readers.sheet(spark, str(tmp_path / "meta.xlsx")).columns == ["Record Number", "Assignee", "Unused", "row_ord"]
    out = entrypoints.label_export(spark, str(tmp_path / "r*.xlsx"), str(tmp_path / "meta.xlsx"), ingest_date="2026-01-01", image_dir=str(tmp_path / "img"))
    got = {r.Patent_ID: r for r in out["canonical"].collect()}
    assert got["U1"].image_path.endswith("a.png") and got["U1"].assignee == "ACME" and got["U2"].image_path is None
    assert out["counts"].first().n_unmatched == 1 and out["image_counts"].first().n_main == 1 and out["batches"].first().n_approved == 1
    sinks.save_canonical(out["canonical"], str(tmp_path / "canon"))
    assert spark.read.parquet(str(tmp_path / "canon/labels.parquet")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "canon/dictionary.csv")).count() > 5
    (tmp_path / "m.csv").write_text("src_path,dst_all,processed,base_patent_id\n" + "".join(f"s{i},{f},True,U{i + 1}\n" for i, f in enumerate(files)))
    made = entrypoints.frozen_extraction(spark, str(tmp_path / "m.csv"), lambda: encode.HashEncoder(dim=4, layers=2), [1, 2], ["cls"], reviews=str(tmp_path / "r*.xlsx"))
    assert [r.figure_id for r in made["figures"].collect()] == ["a.png"] and made["missing"].first().n_dropped_figures == 1 and made["duplicates"].first().n_dropped_patents == 1
    assert made["matrix"].count() == 2 and made["gate"].first().passed
    canon = spark.createDataFrame([(f"b{i}", 1, f"p{i}", "c", f"s{i % 2}") for i in range(6)], "base_patent_id string, arch_index int, image_path string, k string, st string")
    assert entrypoints.pair_preparation(canon, "k", ["st"])["pairs"].count() == 6


def test_stream_repivots(spark, tmp_path):
    schema = "k string, f string, v string, o long"
    for i, rows in enumerate([[("a", "x", "1", 1), ("a", "y", "2", 2)], [("a", "x", "9", 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = arrivals.start_repivot(stream, "k", "f", "v", "o", str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True)
        q.awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "out" / sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("epoch="))[-1]))
    assert last.select("k", "x", "y").first() == ("a", "9", "2")
    ev = spark.range(10).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), F.lit("u").alias("who"))
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    w = arrivals.windowed_counts(spark, str(tmp_path / "ev"), "ts timestamp, who string", "ts", "who")
    q = w.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("windows").collect()) == [5, 5]


def pushed(df):
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return next(line for line in plan.splitlines() if line.startswith("PushedFilters"))


def matrix_rows(spark, n=300, dim=6):
    r = np.random.default_rng(2)
    data = {(layer, how): r.normal(size=(n + layer, dim + layer)).astype(np.float32) for layer in (1, 2) for how in ("cls", "mean_patch")}
    rows = [(i, f"f{i}", layer, how, v.tolist()) for (layer, how), a in data.items() for i, v in enumerate(a)]
    return data, spark.createDataFrame(rows, "row_idx long, figure_id string, layer int, pooling string, vec array<float>").repartition(7)


def test_npy_files_are_numpys_own(spark, tmp_path):
    data, m = matrix_rows(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several tasks a file
    try:
        names = sinks.export_npy(m, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(names) == sorted(f for f in os.listdir(tmp_path) if "npy" in f) and len(names) == 4
    for (layer, how), a in data.items():
        np.save(tmp_path / "want", a)
        assert (tmp_path / f"emb_layer{layer}_{how}.npy").read_bytes() == (tmp_path / "want.npy").read_bytes()
    assert spark.read.parquet(str(tmp_path / "metadata.parquet")).count() == 302


def test_a_failed_export_leaves_no_file(spark, tmp_path):
    _, m = matrix_rows(spark)

    def breaks(batches):
        for b in batches:
            if any(i >= 290 for i in b["row_idx"]):
                raise RuntimeError("executor is gone")
            yield b

    shapes = json.dumps({f"emb_layer{layer}_{how}.npy": [300 + layer, 6 + layer] for layer in (1, 2) for how in ("cls", "mean_patch")})
    rows = m.select("layer", "pooling", "row_idx", "vec").repartitionByRange(4, "layer", "pooling", "row_idx").sortWithinPartitions("layer", "pooling", "row_idx")
    readers.register(spark)
    write = lambda df: df.write.format("npy").mode("append").option("path", str(tmp_path)).option("shapes", shapes).save()
    with pytest.raises(Exception, match="executor is gone"):
        write(rows.mapInPandas(breaks, rows.schema))
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="rows came"):
        write(rows.filter("row_idx <> 5"))
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="twice or out of order"):
        write(rows.union(rows.filter("row_idx = 5")).repartition(1).sortWithinPartitions("layer", "pooling", "row_idx"))
    assert os.listdir(tmp_path) == []
    for bad in (m.filter("row_idx <> 0"), m.withColumn("vec", F.expr("if(row_idx = 3, array(float(1)), vec)")), m.withColumn("vec", F.expr("if(row_idx = 3, null, vec)"))):
        with pytest.raises(ValueError, match="vectors of length"):
            sinks.export_npy(bad, str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_npy_filters_choose_files_and_rows(spark, tmp_path):
    data, m = matrix_rows(spark)
    sinks.export_npy(m, str(tmp_path))
    (tmp_path / "emb_layer9_cls.npy").write_bytes(b"not an array")
    npy = lambda where: readers.scan(spark, "npy", where, path=str(tmp_path), rows="50")
    one = npy("layer = 1 and pooling in ('cls', 'max') and row_idx >= 120 and row_idx < 260")
    got = one.orderBy("row_idx").collect()  # the broken file is not opened
    assert [r.row_idx for r in got] == list(range(120, 260)) and np.array_equal([r.vec for r in got], data[1, "cls"][120:260])
    assert one.rdd.getNumPartitions() == 3
    assert "EqualTo(layer,1)" in pushed(one) and "In(pooling" in pushed(one)
    assert npy("layer > 2 and layer < 9").count() == 0 and npy("layer <> 9 and pooling like 'mean%'").count() == 603
    with pytest.raises(Exception, match="magic|pickle|Cannot load"):
        npy(None).collect()
    assert readers.embedding_bundle(spark, str(tmp_path), [1, 2], ["cls"]).count() == 603


def test_pushed_filters_stay_with_their_scan(spark, tmp_path):
    """Further filters, and queries without them, see the scan's rows and no others."""
    for n in "abc":
        (tmp_path / f"{n}.png").write_bytes(n.encode())
    name = lambda d: sorted(os.path.basename(r.path) for r in d.collect())
    ab = readers.scan(spark, "listing", ~F.col("path").endswith("c.png"), path=str(tmp_path))
    a, b = (ab.filter(F.col("path").endswith(f"{n}.png")) for n in "ab")
    assert name(a) == ["a.png"] and name(ab) == ["a.png", "b.png"] and name(b) == ["b.png"] and ab.count() == 2
    assert name(a.union(ab).union(b)) == ["a.png", "a.png", "b.png", "b.png"]
    every = readers.scan(spark, "listing", path=str(tmp_path))
    assert name(every.filter(F.col("path").endswith("a.png"))) == ["a.png"] and every.count() == 3


def test_listing_filters_skip_folders(spark, tmp_path):
    for n in ("a/one.png", "a/deep/two.png", "ab/three.png", "b/four.png", "five.png"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x" * len(n))
    scan = lambda where: readers.scan(spark, "listing", where, path=str(tmp_path))
    under = scan(F.col("path").startswith(f"{tmp_path}/a/"))
    name = lambda d: sorted(os.path.relpath(r.path, tmp_path) for r in d.collect())
    assert name(under) == ["a/deep/two.png", "a/one.png"] and under.rdd.getNumPartitions() == 2  # the folder itself and a
    assert "StringStartsWith(path" in pushed(under)
    assert name(scan(F.col("path").contains("t") & ~F.col("path").endswith("three.png") & (F.col("bytes") > 10))) == ["a/deep/two.png"]
    assert name(scan(F.col("path") == f"{tmp_path}/b/four.png")) == ["b/four.png"]
    assert name(readers.image_paths(spark, str(tmp_path), where=F.col("path").startswith(f"{tmp_path}/b"))) == ["b/four.png"]


def test_xlsx_filters_choose_files_sheets_and_rows(spark, tmp_path):
    head = ["Patent_ID", "Section", "Value"]
    book(tmp_path / "a.xlsx", {"Review": [head, ["P1", "T1", "x"], ["P2", "T2", None], ["P3", "T2", "y"]], "Notes": [head, ["N1", "T2", "z"]]})
    (tmp_path / "b.xlsx").write_bytes(b"not a workbook")
    cols = "Patent_ID string, Section string, Value string, _source_file string, _sheet string, row_ord long"
    scan = lambda where: readers.scan(spark, "xlsx", where and f"_source_file = 'a.xlsx' and {where}", cols, path=str(tmp_path / "*.xlsx"))
    assert [(r.Patent_ID, r._sheet) for r in scan("true").orderBy("row_ord").collect()] == [("P1", "Review"), ("P2", "Review"), ("P3", "Review"), ("N1", "Notes")]
    t2 = scan("Section = 'T2' and Value is not null and _sheet in ('Review', 'x')")
    assert [r.Patent_ID for r in t2.collect()] == ["P3"]
    assert all(x in pushed(t2) for x in ("EqualTo(_source_file,a.xlsx)", "EqualTo(Section,T2)", "IsNotNull(Value)"))
    assert [r.Patent_ID for r in scan("Value <> 'x' and _sheet <> 'Notes'").collect()] == ["P3"]  # unknown is not true
    assert [r.Patent_ID for r in readers.review_long(spark, str(tmp_path / "*.xlsx"), where="_source_file like 'a%' and Section = 'T1'").collect()] == ["P1"]
    with pytest.raises(Exception, match="zip"):
        scan(None).collect()
