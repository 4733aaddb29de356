"""Results that ties or a table's size once changed, against SQL or plain counts."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import pairs, probes, resampling, tiles
from plumbline.queries import ORACLES, QUERIES


@pytest.fixture()
def tied(tmp_path):
    """Line items that share order, part and number and differ in their flags."""
    rows = [(o, 7, 3, f, "O") for o in range(7) for f in ("NA" if o % 2 else "AN")] + [(9, 8, 1, "N", "F")]
    pd.DataFrame(rows, columns=["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"]).to_parquet(tmp_path / "lineitem.parquet")
    return tmp_path


def same_as_sql(spark, d, name, table):
    got = QUERIES[name](spark, str(d))
    db = duckdb.connect()
    db.execute("SET threads = 1")
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet'")
    want = db.execute(ORACLES[name]).df()[got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", ["image_table", "image_counts", "main_images"])
def test_first_of_tied_line_items(spark, tied, name):
    same_as_sql(spark, tied, name, "lineitem")


@pytest.fixture()
def in_files(tmp_path):
    """Line items in several files, ties apart and one file without rows, in a folder whose name must be escaped."""
    d = tmp_path / "two %20 words+"
    (d / "lineitem.parquet").mkdir(parents=True)
    rows = [(o, 8, 3, "NA"[(o + k) % 2], "OF"[k]) for k in range(2) for o in range(7)] + [(9, 8, 1, "N", "F")]
    df = pd.DataFrame(rows, columns=["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"])
    for i, (a, z) in enumerate(((0, 5), (5, 9), (9, 9), (9, 15))):
        df[a:z].to_parquet(d / "lineitem.parquet" / f"part-{i:04d}.parquet", index=False)
    return d


def same_over_files(spark, d, name):
    got = QUERIES[name](spark, str(d))
    db = duckdb.connect()
    db.execute("SET threads = 1")
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{d}/lineitem.parquet/*.parquet'")
    want = db.execute(ORACLES[name]).df()[got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", ["image_table", "image_counts", "main_images"])
def test_line_items_in_several_files(spark, in_files, name):
    """Files were looked up by a name of another form, found nowhere, and every image lost its flags."""
    same_over_files(spark, in_files, name)


@pytest.mark.parametrize("digits", [0, 1, 3])
def test_partners_over_parts(spark, tmp_path, monkeypatch, digits):
    """Long runs of one style, a class with two styles of which one is rare, one with a single style, rows without one."""
    rows = [(i, "a", "x" if i % 97 else "y") for i in range(400)] + [(i, "b", "pq r"[i % 4].strip() or None) for i in range(400, 460)] + [(i, "c", "x") for i in range(460, 480)] + [(480, None, "x"), (481, "d", "x"), (482, "d", "z")]
    pd.DataFrame(rows, columns=["doc_id", "lang", "source"]).to_parquet(tmp_path / "documents.parquet")
    monkeypatch.setattr(pairs, "PART_DIGITS", digits)
    same_as_sql(spark, tmp_path, "sampled_pairs", "documents")


def test_partners_take_one_pass(spark):
    """No frame that reaches to its group's end, which Spark adds up anew for each row: 200,000 rows of a class took minutes."""
    df = spark.range(10).select(F.col("id").alias("i"), F.lit("c").alias("c"), (F.col("id") % 3).alias("s"))
    plan = pairs.sampled_partner(df, "i", "c", "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()


def test_image_flags_aggregate_by_hashing(spark, tied):
    """A text among the aggregates makes Spark sort every image row before the shuffle."""
    for name in ("image_table", "image_counts"):
        plan = QUERIES[name](spark, str(tied))._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_blocks_of_a_large_table_stay_few(spark):
    """Each block is sent to all others, so their number may not grow with the rows."""
    m = spark.range(300_000).select(F.lit(0).alias("layer"), F.lit("cls").alias("pooling"), "id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    packed = tiles.blocks(m, "id")
    n, rows = packed.agg(F.count("*"), F.sum(F.size("ids"))).first()
    assert rows == 300_000 and n <= 1.5 * tiles.GROUPS


def test_stated_numbers_are_made_in_many_tasks(spark):
    """A file of one row group is one task, in which all digests were made."""
    df = spark.range(50).coalesce(1).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    got = probes.distance_against_random(df, "v", idx="id").select("random_mean")
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert 0.5 < got.first()[0] < 1.5


def test_restarts_at_rest_are_not_summed_again(spark, monkeypatch):
    """One restart begins at the clusters' means and is done at once; the other goes on, and both end as if alone."""
    x = [[0.0], [0.1], [0.2], [5.0], [5.1], [5.2], [9.0], [9.1]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "key long, x array<double>")
    rest, far = np.array([[0.1], [5.1], [9.05]]), np.array([[0.0], [0.1], [0.2]])
    sizes, summed = [], resampling.summed
    monkeypatch.setattr(resampling, "summed", lambda r, c, f, size: sizes.append(size) or summed(r, c, f, size))
    both = resampling.weighted_kmeans(rows, np.stack([rest, far]), 1, 0, 1)
    assert sizes[0] == 2 * sizes[-1] and len(sizes) > 2
    for i, start in enumerate((rest, far)):
        alone = resampling.weighted_kmeans(rows, start[None], 1, 0, 1)
        assert np.allclose(both[0][i], alone[0][0]) and np.isclose(both[1][i], alone[1][0])


def test_norm_is_found_once_a_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>")
    for f in (V.l2_zero_safe, V.l2_floor):
        got = df.select(f(F.col("v")).alias("u"))
        assert [r.u for r in got.collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]
        assert "transform(array(" in got._jdf.queryExecution().optimizedPlan().toString()  # bound outside the elements' lambda


def summary_like_numpy(spark, v, **how):
    m = spark.createDataFrame([(0, "cls", i, x) for i, x in enumerate(v.tolist())], "layer int, pooling string, id long, vec array<double>")
    got = tiles.cosine_summary(m, "id", **how).first()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = (u @ u.T)[np.triu_indices(len(u), 1)]
    assert got.n_pairs == len(c)
    assert np.allclose([got.cos_mean, got.cos_std, got.cos_p05, got.cos_p50, got.cos_p95], [c.mean(), c.std(), *np.percentile(c, [5, 50, 95])], rtol=0, atol=1e-12)


def test_summary_compares_all_pairs_twice(spark, monkeypatch):
    """Moments, counts, finer counts and values each made every product anew; few rows now say where to count finely at once."""
    calls, on_tiles = [], tiles.on_tiles
    monkeypatch.setattr(tiles, "on_tiles", lambda *a: calls.append(a) or on_tiles(*a))
    summary_like_numpy(spark, np.random.default_rng(1).normal(size=(3000, 6)), rows=700, most=150)
    assert len(calls) == 2


@pytest.mark.parametrize("range_", [(-0.9, -0.89), (0.9, 0.91), (0.0, 1e-12)])
def test_summary_where_proposed_ranges_miss(spark, monkeypatch, range_):
    """What the rows propose never decides: ranks beside their ranges are counted in the rest."""
    monkeypatch.setattr(tiles, "proposed", lambda packed, probs: {(0, "cls"): [range_] * len(probs)})
    summary_like_numpy(spark, np.random.default_rng(2).normal(size=(300, 6)), rows=70, most=20)


def test_summary_of_copies(spark):
    """Most pairs are equal but for rounding, more than are sorted from one range."""
    v = np.random.default_rng(3).normal(size=(400, 6))
    v[:380] = v[0]
    summary_like_numpy(spark, v, rows=90, most=20)
