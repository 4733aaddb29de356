"""Whitening, one-permutation near-duplicates and fill-in-the-middle against plain statements of their results."""

import collections
import fractions
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

pytest.importorskip("plumbline.llm")

from pyspark.sql import functions as F  # noqa: E402

from plumbline.llm import fim, minhash, registry, simhash, whitening  # noqa: E402

R = random.Random(9)
VOCAB = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCAB) for _ in range(n)]


def changed(words, at):
    return [f"new{i}x{len(words)}" if i in at else w for i, w in enumerate(words)]


# whitening


def vectors(spark, rows):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, n string")
    return df.withColumns({"deviation": F.lit(1), "whitened": F.lit("clash"), "vec": F.lit(0)}).repartition(3)


def exact(rows):
    """n, sums and scatter in fractions of the valid rows."""
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(good), len(good[0][1])
    s = [sum(x[j] for _, x in good) for j in range(d)]
    cov = [[fractions.Fraction(n * sum(x[i] * x[j] for _, x in good) - s[i] * s[j], n * n) for j in range(d)] for i in range(d)]
    return good, n, s, cov


@pytest.mark.parametrize("spread", [1.0, 5e4, 3e13])
def test_whitening_against_fractions(spark, spread):
    r = np.random.default_rng(3)
    base = r.normal(size=(70, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.2]) * spread
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(3, base[3].tolist()), (None, base[9].tolist())]
    rows += [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (93, [float("nan")] * 6), (94, [1.0, 1.0, float("-inf"), 1.0, 1.0, 1.0])]
    df = vectors(spark, rows)
    good, n, s, cov = exact(rows)
    model = whitening.fit(df)
    assert model.n == n and model.sums == s
    v = np.array([[float(c) for c in row] for row in cov])
    e, u = np.linalg.eigh(v)
    assert np.allclose(model.values, e[::-1], rtol=1e-9) and np.allclose(abs(model.vectors), abs(u[:, ::-1]), atol=1e-8)
    white = whitening.whitened(df, model, components=4)
    got = sorted(((r.vec_id, int(r.deviation), r.whitened) for r in white.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    want = sorted(((i, sum((n * x - a) ** 2 for x, a in zip(row, s)), row) for i, row in good), key=lambda r: (r[0] is None, r[0] or 0))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for (_, _, w), (_, _, x) in zip(got, want):
        centred = np.array([float(fractions.Fraction(a) - fractions.Fraction(b, n)) for a, b in zip(x, s)])
        assert len(w) == 4 and np.allclose(w, centred @ model.vectors[:, :4] / np.sqrt(model.values[:4]), rtol=1e-9, atol=1e-9)
    w = np.array([g[2] for g in got])
    assert abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-6 and whitening.identity_error(white) < 1e-6


def test_whitening_without_variance_and_without_rows(spark):
    for rows in ([], [(1, None), (2, [])], [(1, [1.0, 2.0])], [(i, [0.5, 0.5]) for i in range(5)]):
        df = vectors(spark, rows)
        model = whitening.fit(df)
        white = whitening.whitened(df, model)
        assert len(model.values) == 0 and all(r.whitened == [] and r.deviation == 0 for r in white.collect()) and whitening.identity_error(white) is None
    flat = vectors(spark, [(i, [i / 7, -i / 3.5, 1.0]) for i in range(40)])  # one direction but for the rounding
    assert len(whitening.fit(flat).values) == 2
    with pytest.raises(Exception, match="different lengths"):
        whitening.fit(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(Exception, match="too large"):
        whitening.fit(vectors(spark, [(1, [1.0]), (2, [1e300])]))


def test_scatter_is_exact_in_wide_numbers():
    r = np.random.default_rng(1)
    x = r.integers(-(1 << 61), 1 << 61, (9000, 3))
    s = whitening.Scatter(x[0])
    for part in np.array_split(x, 7):
        s.add(part)
    s.carry()
    y = (x.astype(object) - x[0].astype(object))
    assert s.n == 9000 and (s.sums == y.sum(axis=0)).all() and (s.products == y.T @ y).all()
    assert all(sum(int(d[k]) << 32 * p for p, d in whitening._digits(np.array([v], object))) == v for v in (0, -1, 1 << 200, -(1 << 200), (1 << 62) - 1) for k in [0])


def test_op11_on_the_whole_table(spark, small):
    got = registry.op11_whitening(spark, small).toPandas()
    e = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(e.embedding).astype(float)) + 1_000_000
    c = x - x.mean(axis=0)
    val, vec = np.linalg.eigh(c.T @ c / len(c))
    assert len(got) == 32 * len(e) and set(got.n) == {len(e)} and got.identity_error.max() < 1e-9
    for k, part in got.groupby("component"):
        part = part.set_index("vec_id").loc[e.vec_id]
        w = c @ vec[:, -k] / np.sqrt(val[-k])
        assert min(abs(part.whitened.to_numpy() - w).max(), abs(part.whitened.to_numpy() + w).max()) < 1e-8
        assert np.allclose(part.explained, val[-k] / val.sum())
    z = len(x) * x.astype(int) - x.astype(int).sum(axis=0)
    assert (got[got.component == 1].set_index("vec_id").loc[e.vec_id].deviation.to_numpy() == (z * z).sum(axis=1)).all()


# near-duplicates


def shingle_set(t, k=5):
    w = (t or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, percent=85):
    """{position: (n, component, kept)} from all pairs of rows; empty sets are alone."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(b)] = find(a)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((d, len(sets[i]), least[find(i)], d is not None and d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def found(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, digest string, node int").withColumns({"keys": F.lit("clash"), "h": F.lit(2), "n": F.lit("n")})
    return sorted(map(tuple, minhash.near_duplicates(df.repartition(3)).collect()), key=str)


def test_near_duplicates_against_all_pairs(spark):
    base, long = prose(150, 1), prose(6000, 2)
    texts = [
        (1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join(changed(base, {70}))), (4, " ".join(changed(base, {10, 70}))), (5, None), (6, ""), (7, " \n\t"), (8, "one"), (9, "ONE"),
        (10, "one two three"), (11, " ".join(long)), (12, " ".join(long[300:])), (13, " ".join(long[:3000])), (14, "É é   漢字"), (14, " ".join(base[:140])), (14, "one"), (None, " ".join(base[:145])),
        (None, None), (None, "only rows without an id"), (None, "only rows without an id"), (15, " ".join(base) + " " + " ".join(base)), (16, " ".join(prose(9, 7))), (17, " ".join([*prose(9, 7)[:8], "end"])), (17, " ".join(prose(9, 7))),
    ]
    # Chains of edits, whose ends are unlike, and a family whose members are like its centre, not one another.
    texts += [(100 + i, " ".join(changed(prose(200, 11), set(range(0, 2 * i, 2))))) for i in range(12)]
    texts += [(200 + i, " ".join(changed(prose(240, 12), {} if i == 17 else {7 * i % 240, (7 * i + 120) % 240, (11 * i + 60) % 240}))) for i in range(60)]
    R.shuffle(texts)
    assert found(spark, texts) == brute(texts)
    assert found(spark, texts[:0]) == []


def test_near_duplicates_at_the_border(spark):
    """Pairs of 100 shingles that share 91, 92 and 93: 0.835 to 0.869 around the border of 0.85."""
    rows = []
    for k in range(40):
        w = prose(104, 500 + k)
        cut = 7 + k % 4
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join([*w[:-cut], *(f"z{k}y{i}" for i in range(cut))]))]
    assert found(spark, rows) == brute(rows)


def test_pages_of_one_template_make_few_pairs(spark):
    """A thousand pages with 500 of 600 words in common, no similar pair: the prefix filter pairs none of them."""
    shared = prose(500, 21)
    sets = [(i, i, sorted({hash(s) for s in shingle_set(" ".join(shared + [f"p{i}w{k}" for k in range(100)]))})) for i in range(1000)]
    made = lambda rows: spark.createDataFrame([(*r, simhash.parity_sketch(np.array(r[2]).view(np.uint64)).tolist()) for r in rows], "node long, root long, h array<long>, sk array<long>")
    assert minhash.prefix_pairs(made(sets), 85).count() == 0
    near = [(i, i, h[: 3 if i < 4 else len(h)] + sets[0][2][3:] if i < 4 else h) for i, _, h in sets]
    got = {tuple(r) for r in minhash.prefix_pairs(made(near), 85).collect()}
    assert got >= {(a, b) for a, b in itertools.combinations(range(4), 2)} and len(got) < 50


def test_stars_are_bounded(spark):
    shared = spark.createDataFrame([(key, node, 50) for key in range(20) for node in range(50)], "key long, node long, c long")
    assert minhash.stars(shared).count() == 49  # one hub for all twenty buckets


def test_signatures_agree_as_often_as_sets_do():
    r = np.random.default_rng(4)
    for size in (1, 3, 20, 300, 5000):
        same = []
        for _ in range(60):
            h = r.integers(0, 1 << 63, size * 2, np.int64).astype(np.uint64) * np.uint64(2)
            a, b = np.unique(h[: size + size // 2]), np.unique(h[size // 2 :])
            same.append((minhash.signature(a) == minhash.signature(b)).mean())
        true = (size + size // 2 - size // 2) / (2 * size)
        if size == 1:
            assert len(minhash.band_keys(np.unique(h[:1]))) == minhash.BANDS
        else:
            assert abs(np.mean(same) - true) < 0.06
    assert len(minhash.band_keys(np.empty(0, np.uint64))) == 0


# fill-in-the-middle


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    g = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(g[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in fim.SENTINELS):
        return (doc_id, n, "plain", None, None, text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    return (doc_id, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")


def test_fim_against_slices(spark):
    body = ["", None, "\n", "\n\n\n", "one", "one\n", "a\r\nb\x00c\n\x0b", "a<P>b", "x\n<S>", "<M>", "<P\n<S\nS><\n<", "漢字\n\U0001f600é\né\n", "\n".join(map(str, range(3000))), "é" * 100_000, "<" * 50 + "\n" * 50]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(body * 6)] + [(7, "same\nrow\n")] * 2
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int").withColumns({"h0": F.lit("clash"), "form": F.lit(1), "output": F.lit(1)}).repartition(3)
    got = fim.transformed(df)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_fim(*r) for r in rows), key=str)
    back = got.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    assert {r.form for r in got.collect()} == {"plain", "spm", "psm"} and fim.transformed(df.limit(0)).count() == 0


def test_fim_parameters(spark):
    df = spark.createDataFrame([(i, " ".join(prose(20, i))) for i in range(300)], "doc_id long, text string")
    cut = fim.transformed(df, seed=1, rate=40, spm=0, unit=r"\S+\s*", sentinels=("[pre]", "{suf}", "|mid>"))
    forms = collections.Counter(r.form for r in cut.collect())
    assert 80 < forms["psm"] < 160 and set(forms) == {"psm", "plain"} and {r.n for r in cut.collect()} == {20}
    back = cut.select("doc_id", fim.restored(F.col("output"), F.col("form"), ("[pre]", "{suf}", "|mid>")).alias("text"))
    assert back.exceptAll(df).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P><", "<S>", "<M>")):
        with pytest.raises(ValueError, match="sentinels"):
            fim.transformed(df, sentinels=bad)
