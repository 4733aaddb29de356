"""The registered queries, with the parameters they run with, against SQL or brute force on the smallest tables."""

import collections
import hashlib
import zlib

import duckdb
import pytest
import xxhash

pytest.importorskip("plumbline.llm")

from plumbline.llm import registry  # noqa: E402


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def rows(con):
    return con.sql("select doc_id, text, lang from documents").fetchall()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, small, con, name):
    a, b = registry.QUERIES[name](spark, small).toPandas(), con.sql(registry.ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    line = lambda r: tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(line, a[cols].itertuples(index=False))) == sorted(map(line, b[cols].itertuples(index=False)))


def test_op4_against_all_pairs(spark, small, rows):
    def print_of(t):
        w = [x for x in (t or "").encode().lower().split()]
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fp = {i: print_of(t) for i, t, _ in rows}
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fp)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 2 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op4_simhash(spark, small).collect()}
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in fp}


def test_op8_against_every_window(spark, small, rows):
    n = 200
    raw = [(i, (t or "").encode()) for i, t, _ in rows]
    count = collections.Counter(b[p : p + n] for _, b in raw for p in range(len(b) - n + 1))
    want = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                gone[p : p + n] = b"\x01" * n
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    got = registry.op8_suffix(spark, small).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_op9_on_held_out_rows(spark, small, rows):
    got = {r.doc_id: r for r in registry.op9_langid(spark, small).collect()}
    held = [(i, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1 and t and lang]
    assert len(got) == len(rows) and all(got[i].held_out for i, _ in held) and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held)


def test_op2_links_equal_values(spark, small, rows):
    got = {r.doc_id: r for r in registry.op2_pii(spark, small).collect()}
    made = {}
    for i, t, _ in rows:
        at = 0
        for span in filter(None, got[i].spans.split(",")):
            kind, a, z = span.split(":")
            a, z = int(a), int(z)
            assert a >= at
            at = z
            if "ipv4" not in got[i].spans:  # other kinds keep their length, hence all places
                new = got[i].text[a:z]
                assert made.setdefault((kind, t[a:z]), new) == new and len(new) == z - a
    assert made
