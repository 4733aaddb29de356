"""What the third round's findings asked for: memory of a task, the named method, disk."""

import glob
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

pytest.importorskip("plumbline.llm")

from plumbline.llm import media, shared, simhash, suffixdup  # noqa: E402
from plumbline.llm.common import Scratch  # noqa: E402


def test_blocks_of_one_task_are_written_in_small_row_groups(spark):
    """a task's row group and page end with the block that fills them, not with its hundredth block."""
    r = random.Random(8)
    rows = [(i, "".join(r.choices("abcdefghijklmnop", k=3 << 20))) for i in range(8)]
    scratch = Scratch(spark, "blocks-test")
    scratch.keep(suffixdup.blocks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 1 << 20), "blocks", **suffixdup.SMALL_GROUPS)
    meta = [pq.ParquetFile(p).metadata for p in glob.glob(f"{scratch.path.removeprefix('file:')}/blocks/*.parquet")]
    groups = [m.row_group(i) for m in meta for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 8
    assert max(g.total_byte_size for g in groups) <= 16 << 20


def test_a_part_of_an_array_is_read_alone(tmp_path):
    """answers are read by the piece, so a worker's memory doesn't grow with the answers of all buckets."""
    a = np.arange(100_000, dtype=np.int64).astype(np.uint8)
    shared.put(str(tmp_path), "a", a)
    for lo, hi in ((0, 0), (0, 7), (5_000, 70_001), (99_999, 100_000)):
        assert (shared.part(str(tmp_path), "a", lo, hi) == a[lo:hi]).all()


def test_near_duplicates_are_linked_by_fingerprints(spark, monkeypatch):
    """without any band, texts whose SimHash fingerprints are near and whose shingles are similar are still linked."""
    monkeypatch.setattr(simhash, "band_keys", lambda h: np.empty(0, np.int64))
    r = random.Random(31)
    texts = []
    for _ in range(20):
        w = ["w%d" % r.randrange(3000) for _ in range(600)]
        texts.append(w)
        for _ in range(4):
            v = list(w)
            v[r.randrange(600)] = "e%d" % r.randrange(10**9)
            texts.append(v)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    h = {i: simhash.shingle_hashes(t, 5) for i, t in rows}
    fp = {i: simhash.fingerprint(x) & (1 << 64) - 1 for i, x in h.items()}
    root = {i: i for i in h}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in h:
        for j in range(i):
            both = len(np.intersect1d(h[i], h[j]))
            if (fp[i] ^ fp[j]).bit_count() <= simhash.TAU and both >= 0.8 * (len(set(h[i])) + len(set(h[j])) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = {x.doc_id: x.class_id for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: top(i) for i in h}
    assert len(set(got.values())) < 60


@pytest.mark.parametrize("n", [4, 40])
def test_fingerprints_that_differ_in_the_sign_bit_are_linked(spark, n):
    """F5, and op4_simhash: bit 63 counts like any other, in small and in large buckets."""
    r = random.Random(n)
    a = [r.getrandbits(62) << 1 for _ in range(n // 2)]
    fps = sorted({x for y in a for x in (y, (y ^ 1) - (1 << 63))})
    got = simhash.hamming_links(spark.createDataFrame([(x,) for x in fps], "fp long"), 2, Scratch(spark, "sign")).collect()
    assert {tuple(sorted(x)) for x in got} == {tuple(sorted((y, (y ^ 1) - (1 << 63)))) for y in a}


def test_media_keys_are_shared_by_the_images_that_have_them(spark):
    """op10_media: keys are sent packed, without their strings; the images of a key are those that brute force finds."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        w = rng.integers(-(1 << 63), 1 << 63, (9, 2))
        w[:4] = np.random.default_rng(i % 7).integers(-(1 << 63), 1 << 63, (4, 2))  # shared by every seventh
        w[4, 0] = (w[4, 0] >> 32 << 32) | 5  # one low half that all have
        w[5] = w[4]  # twice in one image
        if i < 2:
            w[6, 0] = (w[6, 0] >> 32 << 32) | 77  # shared by two whose other bits are unlike
        rows.append((i * 10**12 - 7, w[:, 0].tolist(), w[:, 1].tolist()))
    reps = spark.createDataFrame(rows, "id long, w0 array<long>, w1 array<long>").repartition(3)
    for tables in (2, 4):
        want: dict = {}
        for i, w0, w1 in rows:
            for a, b in zip(w0, w1):
                a, b = a % 2**64, b % 2**64
                for t, key in enumerate([a, b] if tables == 2 else [a >> 32, a % 2**32, b >> 32, b % 2**32]):
                    want.setdefault((t, key - 2**64 if key >= 2**63 else key), set()).add(i)
        want = {k: v for k, v in want.items() if len(v) > 1 and k != (1, 77)}
        got: dict = {}
        for r in media._shared(reps, 540, tables, 12).collect():
            assert r.id not in got.setdefault((r.t, r.key), set())
            got[r.t, r.key].add(r.id)
        assert got == want


def test_media_leaves_no_shuffle_files_behind(spark):
    """op10_media: each step's shuffle files go with it, so a query holds those of one step at a time."""
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    rng = np.random.default_rng(6)
    rows = [(i, b"P5 60 60 255\n" + np.kron(rng.integers(0, 256, (10, 10)), np.ones((6, 6))).astype(np.uint8).tobytes()) for i in range(20)]
    before = files()
    media.copies(spark.createDataFrame(rows, "id long, content binary"))
    assert not files() - before


def test_media_corners_of_stacked_images_are_those_of_each_alone(monkeypatch):
    """op10_media: small images are looked at together, which changes none of their corners."""
    rng = np.random.default_rng(5)
    images = [None if h == 7 else np.kron(rng.integers(0, 256, (-(-h // 3), 24)), np.ones((3, 3))).astype(np.uint8)[:h] for h in rng.integers(1, 120, 60).tolist()]
    together = list(media.describe(images))
    monkeypatch.setattr(media, "STACK", 1)
    alone = [x for im in images for x in media.describe([im])]
    assert sum(len(g) for g, _ in alone) > 100
    assert all((a == c).all() and (b == d).all() for (a, b), (c, d) in zip(together, alone, strict=True))
