"""Weights on the executors, device profiles and shards, and the ledger of inputs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import encode
from plumbline.plans import entrypoints
from plumbline.sources import ledger, weights


def checkpoint(path, seed=0, layers=3, dim=5):
    r = np.random.default_rng(seed)
    np.savez(path, **{f"w{k}": r.normal(size=(256, dim)) for k in range(layers)})
    return str(path)


def figures(spark, n=40):
    return spark.createDataFrame([(i, f"f{i}", "p", "main", bytes([i, i % 7, 255 - i] * (i + 1))) for i in range(n)], "row_idx long, figure_id string, patent_id string, figure_type string, content binary").repartition(6)


def test_weights_are_loaded_once_a_worker(spark, tmp_path):
    w = weights.publish(spark, checkpoint(tmp_path / "a.npz"))
    log = str(tmp_path / "loads")

    def parse(path):
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return np.load(path)["w1"].sum()

    def run(batches):
        for b in batches:
            yield b.assign(total=w.load(parse), pid=os.getpid())

    got = spark.range(0, 400, 1, 16).mapInPandas(run, "id long, total double, pid long").collect()
    loads = open(log).read().split()
    assert {r.total for r in got} == {np.load(tmp_path / "a.npz")["w1"].sum()} and len(got) == 400
    assert len(loads) == len(set(loads)) and {str(r.pid) for r in got} <= set(loads) and len(loads) < 16


def test_missing_and_changed_checkpoints(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no checkpoint"):
        weights.publish(spark, str(tmp_path / "none.npz"))
    path = checkpoint(tmp_path / "a.npz", 1)
    old = weights.publish(spark, path)
    assert weights.publish(spark, path, old.digest) == old
    checkpoint(tmp_path / "a.npz", 2)
    with pytest.raises(ValueError, match="has digest"):
        weights.publish(spark, path, old.digest)
    new = weights.publish(spark, path)  # another file beside the old one, which tasks that began with it still read
    first = lambda w: spark.range(1).mapInPandas(lambda bs: (b.assign(x=w.load(encode.histogram_weights)["w0"][0, 0]) for b in bs), "id long, x double").first().x
    assert new.digest != old.digest and first(new) == np.load(path)["w0"][0, 0] != first(old)
    with pytest.raises(Exception, match="has digest"):
        first(weights.Weights(new.name, "0" * 64))


def test_an_encoder_with_weights(spark, tmp_path):
    path = checkpoint(tmp_path / "a.npz")
    w, z = weights.publish(spark, path), np.load(path)
    got = encode.encode_images(figures(spark), lambda device: encode.HistogramEncoder(w, device=device), [0, 2], ["cls", "mean_patch"], num_hidden_layers=2)
    got = {(r.row_idx, r.layer, r.pooling): np.array(r.vec) for r in got.collect()}
    assert len(got) == 160
    for i in range(40):
        parts = np.array_split(np.frombuffer(bytes([i, i % 7, 255 - i] * (i + 1)), np.uint8), 4)
        h = np.mean([np.bincount(p, minlength=256) / max(len(p), 1) for p in parts], axis=0)
        for k in (0, 2):
            assert np.allclose(got[i, k, "cls"], h @ z[f"w{k}"], atol=1e-5) and np.allclose(got[i, k, "mean_patch"], h @ z[f"w{k}"], atol=1e-5)


@pytest.mark.parametrize("shards", [1, 3, [5.0, 1.0], [1.0, 0.0, 3.0, 0.2]])
def test_shards_are_contiguous_and_merge_in_order(spark, shards):
    rows = figures(spark)
    dealt = encode._dealt(rows.select("row_idx"), shards).withColumn("p", F.spark_partition_id()).collect()
    parts = {}
    for r in dealt:
        parts.setdefault(r.p, []).append(r.row_idx)
    assert [i for p in sorted(parts) for i in parts[p]] == list(range(40))
    if isinstance(shards, list):
        share = np.diff([0, *np.round(40 * np.cumsum(shards) / sum(shards))])
        assert [len(parts.get(p, [])) for p in range(len(shards))] == share.tolist()
    make = lambda: encode.HashEncoder(dim=3, layers=2)
    m = encode.encode_images(rows, make, [0, 2], ["cls"], shards=shards)
    whole = encode.encode_images(rows, make, [0, 2], ["cls"]).orderBy("layer", "pooling", "row_idx").collect()
    assert encode.merged(m, rows).collect() == whole
    for bad in (m.filter("row_idx <> 7"), m.union(m.filter("row_idx = 7"))):
        with pytest.raises(ValueError, match="rows"):
            encode.merged(bad, rows)
    assert encode.encode_images(rows.limit(0), make, [0], ["cls"], shards=shards).count() == 0


def test_a_device_profile_is_the_stages_own(spark):
    """Profiles need a cluster to run; the plan shows which stage has one."""
    rows = figures(spark)
    plan = lambda df: df._jdf.queryExecution().toString()
    m = encode.encode_images(rows, lambda: encode.HashEncoder(dim=3, layers=2), [0], ["cls"], profile=encode.device_profile("gpu", 0.5, cpus=2))
    line = next(x for x in plan(m.filter("row_idx > 3").groupBy("layer").count()).splitlines() if "MapInPandas" in x)
    assert "Profile: id" in line and "gpu" in line and "0.5" in line and "cpus" in line
    assert "Profile: id" not in plan(encode.encode_images(rows, lambda: encode.HashEncoder(dim=3, layers=2), [0], ["cls"]))
    assert encode.task_device() == "cpu"


def test_changed_inputs_alone_are_encoded_again(spark, tmp_path):
    images, store, log = tmp_path / "images", tmp_path / "store", tmp_path / "log"
    for n in ("a", "b", "sub/c", "d"):
        (images / f"{n}.png").parent.mkdir(parents=True, exist_ok=True)
        (images / f"{n}.png").write_bytes(n.encode() * 9)
    log.write_text("")

    class Counting(encode.HashEncoder):
        def hidden_states(self, contents, layers=None):
            with open(log, "a") as f:
                f.write("".join("x" for _ in contents))
            return super().hidden_states(contents, layers)

    def run(layers=(0,), settings=""):
        log.write_text("")
        got = entrypoints.refreshed_extraction(spark, str(images), str(store), lambda: Counting(dim=2, layers=2), list(layers), ["cls"], settings)
        rows = sorted((r.figure_id, r.layer, tuple(r.vec)) for r in got.collect())
        return rows, len(log.read_text())

    first, n = run()
    assert [r[0] for r in first] == ["a.png", "b.png", "c.png", "d.png"] and n == 4
    assert run() == (first, 0)
    (images / "b.png").write_bytes(b"changed")
    second, n = run()
    assert n == 1 and [x for x in second if x not in first] == [r for r in second if r[0] == "b.png"] and len(second) == 4
    (images / "a.png").unlink()
    (images / "e.png").write_bytes(b"new")
    third, n = run()
    assert n == 1 and [r[0] for r in third] == ["b.png", "c.png", "d.png", "e.png"] and run() == (third, 0)
    assert run(layers=(0, 1))[1] == 4 and run(settings="other")[1] == 4 and run() == (third, 0)


def test_a_failed_refresh_leaves_the_former_state(spark, tmp_path):
    at = "timestamp '2024-01-01 00:00:00'"
    inputs = lambda n: spark.range(n).selectExpr("concat('f', id) path", "id bytes", f"{at} modified")
    build = lambda new: new.select("path", (F.col("bytes") * 2).alias("twice"))
    go = lambda n, b=build: sorted(map(tuple, ledger.refresh(spark, str(tmp_path), "cfg", inputs(n), b).collect()))
    assert go(0) == [] and go(2) == [("f0", 0), ("f1", 2)]

    def breaks(new):
        return build(new).withColumn("twice", F.expr("if(path = 'f3', raise_error('gone'), twice)").cast("long"))

    with pytest.raises(Exception, match="gone"):
        go(4, breaks)
    assert ledger.ledger(spark, f"{tmp_path}/cfg").count() == 2
    seen = []
    assert go(4, lambda new: seen.append(new.count()) or build(new)) == [("f0", 0), ("f1", 2), ("f2", 4), ("f3", 6)] and seen == [2]
