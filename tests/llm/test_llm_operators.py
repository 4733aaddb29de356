"""Each operator against a brute-force statement on small rows with nulls, empties, copies, ties and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

pytest.importorskip("plumbline.llm")

from pyspark.sql import functions as F  # noqa: E402

from plumbline.llm import decontaminate, graph, langid, media, mixing, ngram, pii, secrets, simhash, suffixdup, toxicity  # noqa: E402
from plumbline.llm.common import Scratch  # noqa: E402

rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


LONG = prose(3000, 1)
BASE = prose(120, 2)
EDIT = BASE.split()
EDIT[60] = "changed"
TEXTS = [
    (1, BASE), (2, BASE), (3, " ".join(EDIT)), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "One TWO"), (9, LONG), (10, LONG[200:]),
    (11, prose(90, 3)), (12, "é ü ß 漢字 \U0001f600 " + prose(50, 4)), (13, BASE.upper()), (14, prose(40, 6) + " " + BASE), (14, prose(40, 6) + " " + BASE), (15, ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "src%d" % (i % 3) if i % 5 else None, i) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long").withColumns({"fp": F.lit("clash"), "h": F.lit(1), "size": F.lit("s")}).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return (t or "").encode().lower().split()


def shingles(t, k):
    w = words(t)
    return [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def components(ids, near):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(set(ids)), 2):
        if near(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7), (300, 300)]
    got = dict(graph.connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect())
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}, **{i: 200 for i in (200, 201, 202)}}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_simhash_matches_all_pairs(docs, empty):
    got = simhash.components(docs, shingle=3, tau=2).collect()
    want = {}
    for i, t in TEXTS:
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(t, 3)]
        want[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert len(got) == len(TEXTS)
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == want
    comp = components(list(want), lambda a, b: (want[a] ^ want[b]).bit_count() <= 2)
    assert {r.doc_id: r.component_id for r in got} == comp
    assert simhash.components(empty).count() == 0


@pytest.mark.parametrize("tau", [0, 1, 2, 5])
def test_hamming_links_lose_nothing_even_in_oversized_buckets(spark, tau, monkeypatch):
    r = np.random.default_rng(tau)
    seeds = r.integers(-(1 << 62), 1 << 62, 12)
    fps = {int(s) ^ sum(1 << int(b) for b in r.choice(62, r.integers(0, 4), replace=False)) for s in seeds for _ in range(25)}
    fps |= {(1 << 40) + (1 << int(b)) for b in range(60)}
    monkeypatch.setattr(simhash, "BUCKET", 20)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    scratch = Scratch(spark, "t")
    got = dict(graph.connected_components(simhash.hamming_links(df, tau, scratch), scratch).collect())
    want = components(sorted(fps), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= tau)
    assert {f: got.get(f, f) for f in fps} == want


def test_radii_add_up_and_partitions_cover():
    joint = np.full((64, 64), 250.0)
    np.fill_diagonal(joint, 500)
    for tau in (0, 1, 2, 3, 6):
        for m in (1, 2, 3, 5):
            parts = simhash.partitions(1000, joint, m)
            assert sorted(itertools.chain(*parts)) == list(range(64))
            cost, ts = simhash.allocate(1000, joint, parts, tau)
            assert not ts or sum(ts) == tau - m + 1


def test_near_duplicates_by_similarity(spark):
    r = random.Random(9)
    rows, n = [], 0
    for fam in range(25):
        w = [r.choice(VOCAB) + str(r.randint(0, 99)) for _ in range(r.randint(30, 300))]
        for k in range(3):
            v = list(w)
            for _ in range(k * max(1, len(w) // 80)):
                v[r.randrange(len(v))] = "e%d" % r.randint(0, 10**6)
            rows.append((n, " ".join(v)))
            n += 1
    sets = {i: set(shingles(t, 5)) for i, t in rows}
    want = components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {x.doc_id: x.class_id for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [i for i in want if got[i] != want[i]]
    assert len(missed) <= 1
    assert all(want[i] == want[c] for i, c in got.items())


def similarity_classes(rows, k=5):
    sets = {i: set(shingles(t, k)) for i, t in rows}
    return components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def replaced(w, n, r):
    v = list(w)
    for i in r.sample(range(len(v)), n):
        v[i] = "e%d" % r.randrange(10**9)
    return v


@pytest.mark.parametrize("bucket", [1024, 50])
def test_near_duplicates_miss_no_pair(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(bucket)
    texts = []
    for edits in (3, 4):  # families of hundreds at the threshold
        base = [r.choice(VOCAB) + str(r.randrange(99)) for _ in range(240)]
        texts += [replaced(base, edits, r) for _ in range(200)]
    passages = [[r.choice(VOCAB) + str(r.randrange(99)) for _ in range(50)] for _ in range(12)]
    common = [list(itertools.chain(*(r.choice(passages) for _ in range(6)))) for _ in range(250)]
    texts += common + [replaced(w, 3, r) for w in common[:60]]  # pairs built of frequent passages
    texts += [[r.choice("abc") for _ in range(r.randint(1, 14))] for _ in range(150)]  # short ones
    r.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = {x.doc_id: x.class_id for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == similarity_classes(rows)


def test_similar_sets_share_a_band():
    r = np.random.default_rng(3)
    for n in [*range(1, 60), 100, 500, 3000]:
        for _ in range(20):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            cut, add = r.integers(0, n // 5 + 1), r.integers(0, n // 4 + 1)
            b = np.unique(np.concatenate([r.permutation(a)[cut:], r.integers(0, 1 << 63, add).astype(np.uint64)]))
            if (n - cut) >= 0.8 * (n + add):
                assert len(np.intersect1d(simhash.band_keys(a), simhash.band_keys(b)))
                assert np.bitwise_count((simhash.parity_sketch(a) ^ simhash.parity_sketch(b)).view(np.uint64)).sum() <= cut + add


def test_bands_are_shared_as_often_as_reckoned():
    """At a similarity of 0.5 a band is shared with probability 0.5 ** 4, so the least hashes are as good as independent."""
    r = np.random.default_rng(4)
    share = []
    for _ in range(400):
        both, a, b = (np.unique(r.integers(0, 1 << 63, 60).astype(np.uint64)) for _ in range(3))
        x, y = (simhash.band_keys(np.concatenate([both, z[:30]])) for z in (a, b))
        share.append(len(np.intersect1d(x, y)) / simhash.BANDS)
    assert np.mean(share) == pytest.approx(0.5**4, rel=0.15)


def test_keep_one_keeps_columns_and_least(docs, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {1, 4, 7, 8, 9, 11, 12} <= ids and not ids & {2, 3, 13, 5, 6, 15}
    assert simhash.keep_one(empty).count() == 0


def test_rows_without_an_id_pass_and_repeated_rows_leave_one(spark, small):
    import corpus_pipeline as cp
    from plumbline.llm.common import read

    item = read(spark, small, "benchmark").filter("text is not null").first().text
    rows = [(None, BASE, "a"), (None, prose(60, 40), "a"), (None, prose(60, 40), "b"), (7, prose(60, 41), "a"), (7, prose(60, 41), "a"), (8, BASE, "b"), (None, item, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = cp.drop_near_duplicates(spark, df, small)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(8, BASE), (0, prose(60, 40)), (7, prose(60, 41)), (0, item)])
    clean = cp.drop_contaminated(spark, kept, small)
    assert sorted(r.doc_id or 0 for r in clean.collect()) == [0, 7, 8]
    mixed = cp.mix_sources(spark, clean, small)
    assert {r.text for r in mixed.collect()} == {BASE, prose(60, 40), prose(60, 41)}


def test_containment_is_exact(spark, docs, empty):
    items = [(1, " ".join(BASE.split()[10:50])), (2, " ".join(BASE.split()[40:80])), (3, None), (4, ""), (5, "one"), (6, LONG), (7, " ".join(BASE.split()[10:50])), (8, prose(30, 77)), (9, "ONE, two!")]
    table = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n int")
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())

    def sh(t):
        w = norm(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = {(i, j): len(sh(t) & sh(u)) / len(sh(u)) for i, t in TEXTS for j, u in items if sh(u) and len(sh(t) & sh(u)) / len(sh(u)) >= 0.8}
    found = decontaminate.containment(docs, table).collect()
    assert len(found) == len({(r.doc_id, r.item_id) for r in found})
    assert {(r.doc_id, r.item_id): r.containment for r in found} == pytest.approx(want) and want
    shared_id = docs.filter("doc_id in (1, 11)").withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.filter("doc_id = 2")).unionByName(docs.filter("doc_id = 2"))
    again = decontaminate.containment(shared_id, table).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.containment) for r in again) == sorted((i, j, c) for d, i in ((1, 0), (11, 0), (2, 2)) for (e, j), c in want.items() if e == d)
    left = decontaminate.decontaminated(docs, table)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in TEXTS if not any(i == d for d, _ in want))
    assert decontaminate.containment(empty, table).count() == 0
    assert decontaminate.containment(docs, table.limit(0)).count() == 0


def test_decontamination_uses_no_python(docs):
    plan = decontaminate.with_shingles(docs.select("doc_id", "text"), 5)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("kind,value", [
    ("card", "4111 1111 1111 1111"), ("card", "5500-0000-0000-0004"), ("iban", "DE89 3704 0044 0532 0130 00"), ("date", "2020-02-29"), ("date", "31/12/1999"), ("date", "12/31/1999"),
    ("ipv4", "192.168.0.1"), ("ssn", "123-45-6789"), ("phone", "+1 (643) 555-5742"), ("email", "Ann.Lee_7@mail3.example.com"),
])
def test_pseudonyms_keep_format_and_invert(kind, value):
    f = pii.Feistel(hashlib.blake2b(b"k", digest_size=32).digest())
    new = pii.pseudonym(kind, value, f)
    assert new != value and pii.pseudonym(kind, new, f, back=True) == value
    if kind != "ipv4":
        assert [c if not c.isalnum() else "" for c in new] == [c if not c.isalnum() else "" for c in value]
    assert pii.PATTERN.fullmatch(new) and pii.PATTERN.fullmatch(new).lastgroup == kind
    plain = re.sub(r"\D", "", new)
    assert kind != "card" or pii.luhn(plain)
    assert kind != "iban" or pii.iban_check(new[:2], re.sub(" ", "", new)[4:]) == new[2:4]


@pytest.mark.parametrize("n", [2, 3, 10, 97, 1000, 1 << 12])
def test_feistel_is_a_permutation(n):
    f = pii.Feistel(b"k" * 32)
    out = [f.permute(x, n) for x in range(n)]
    assert sorted(out) == list(range(n)) and [f.permute(y, n, back=True) for y in out] == list(range(n))


def test_pii_leaves_invalid_numbers_and_links_equal_values(spark, empty):
    rows = [(1, "card 4111111111111111 and 4111111111111112 ip 300.1.1.1"), (2, "again 4111111111111111."), (3, None), (4, ""), (5, "2021-02-30 none")]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), b"key").collect()}
    a, b = re.findall(r"\d{16}", got[1].text)
    assert b == "4111111111111112" and a != "4111111111111111" and re.findall(r"\d{16}", got[2].text) == [a]
    assert "300.1.1.1" in got[1].text and got[3].text is None and got[4].text == "" and got[5].n_spans == 0
    back = pii.pseudonymised(spark.createDataFrame([(r.doc_id, r.text) for r in got.values()], "doc_id long, text string"), b"key", back=True)
    assert {r.doc_id: r.text for r in back.collect()} == dict(rows)
    assert pii.pseudonymised(empty, b"k").count() == 0


@pytest.mark.parametrize("text,value", [
    ("4111111111111111 123", "4111111111111111"), ("4111 1111 1111 1111 12/27", "4111 1111 1111 1111"), ("12 4111111111111111", "4111111111111111"),
    ("ES9121000418450200051332 EUR", "ES9121000418450200051332"), ("8.8.8.8", "8.8.8.8"), ("a 1.1.1.1 b", "1.1.1.1"), ("4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"),
])
def test_pii_finds_values_beside_other_characters(text, value):
    f = pii.Feistel(hashlib.blake2b(b"k", digest_size=32).digest())
    new, spans = pii.pseudonymise(text, f)
    a = text.index(value)
    kind = spans[0][0]
    assert spans == [(kind, a, a + len(value))] and new == text[:a] + pii.pseudonym(kind, value, f) + text[a + len(value) :]


def test_apportionment_is_sainte_lague(spark):
    r = random.Random(3)
    for votes in ([5, 5, 5], [1000, 1, 1, 1], [r.random() * 100 for _ in range(12)], [0, 7, 0, 3]):
        for seats in (0, 1, 7, 50):
            q = sorted(((-v / (2 * k + 1), i, k) for i, v in enumerate(votes) if v > 0 for k in range(seats + 1)))[:seats]
            want = [sum(1 for x in q if x[1] == i) for i in range(len(votes))]
            df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(votes)], "g int, i int, v double")
            got = mixing.apportion(df, ["g"], "v", F.lit(seats), ["i"], "n").orderBy("i").collect()
            assert [x.n for x in got] == want, (votes, seats)


def test_mixing_meets_targets(spark, docs, empty):
    rows = [(i, "s%d" % (i % 4) if i % 9 else None, 10 + i % 50) for i in range(3000)] + [(9000, "tiny", 40), (9001, "zero", 0), (9002, None, None)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), shard_tokens=5000)
    got, again = out.collect(), out.collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    per = collections.defaultdict(lambda: [0, 0.0])
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-9
        per[r.source][0] += r.taken
        per[r.source][1] = r.target
    for s, (t, g) in per.items():
        assert abs(t - g) <= max(0.02 * g, 64), (s, t, g)
    assert sum(g for _, g in per.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    assert mixing.mix(mixing.sizes(empty)).count() == 0
    assert mixing.mix(mixing.sizes(docs.filter("text is null or text = ''"))).agg(F.sum("taken")).first()[0] == 0


def test_mixing_keeps_every_row(spark):
    """Rows with the same id, without one, and repeated whole: each is there once, with its own words."""
    rows = [(None, "a", 40), (None, "a", 40), (7, "a", 30), (7, "a", 30), (7, "b", 50), (8, "b", 0), (9, None, 20)]
    got = [(r.doc_id, r.source, r.size, r.taken) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), block=4, shard_tokens=60).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((r[:3] for r in got), key=key) == sorted(rows, key=key) and all(0 <= r[3] <= 2 * r[2] for r in got)
    text = " ".join(["w"] * 40)
    docs = spark.createDataFrame([(i, text, s, 1.5) for i, s in ((None, "a"), (None, "a"), (3, "b"))], "doc_id long, text string, source string, target double")
    out = mixing.mixed(docs, share=10.0)
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"] and sorted((r.doc_id or 0, r.taken) for r in out.collect()) == [(0, 80), (0, 80), (3, 80)]


def test_homoglyphs_and_signs_fold():
    assert toxicity.fold("1d10t іdіоt ID1OT $tupid 555 in$$$ x") == "idiot idiot idiot stupid 555 in$$$ x"


def test_toxicity_learns_terms_not_copies(spark, empty):
    r = random.Random(1)
    rows = []
    for i in range(400):
        w = [r.choice(VOCAB) for _ in range(r.randint(5, 80))]
        y = int(i % 5 == 0)
        if y:
            w.insert(r.randrange(len(w)), r.choice(["zork", "Zork!", "z0rk"]))
        rows.append((i, " ".join(w), y))
    rows += [(1000 + i, "odd copied page of text", 1) for i in range(30)]
    train = spark.createDataFrame(rows, "doc_id long, text string, y long")
    lex = toxicity.learn(train, Scratch(spark, "t"))
    assert "zork" in lex.terms and "copied" not in lex.terms
    tests = spark.createDataFrame([(1, "you ZORK here"), (2, prose(30, 8)), (3, None), (4, ""), (5, "zоrk"), (6, "zorkmid")], "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.score(tests, lex).collect()}
    assert [got[i].predicted for i in range(1, 7)] == [1, 0, 0, 0, 1, 0] and all(0 <= x.score <= 1 for x in got.values())
    assert {x.doc_id for x in toxicity.keep_clean(tests.withColumn("f", F.lit(1)), lex).collect()} == {2, 3, 4, 6}
    none = toxicity.learn(train.limit(0), Scratch(spark, "t"))
    assert toxicity.score(empty, none).count() == 0 and toxicity.score(tests, none).count() == 6


@pytest.mark.parametrize("bucket_tokens", [4_000_000, 40])
def test_ngram_is_kneser_ney(spark, docs, empty, bucket_tokens):
    """Also with nearly every word frequent, so that middle words are dealt in parts."""
    train = docs.filter("doc_id % 2 = 1")
    model = ngram.learn(train, Scratch(spark, "t"), bucket_tokens)
    assert bool(len(model.hot)) == (bucket_tokens == 40)
    got = sorted(ngram.score(docs, model).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    text = lambda t: [*words(t), "</s>"]
    tr = [text(t) for i, t in TEXTS if i % 2]
    triples = lambda t: list(zip(["<s>", "<s>", *t], ["<s>", *t], t))
    c = collections.Counter(itertools.chain(*tr))
    n, v = sum(c.values()), len(c)
    counts = {3: collections.Counter(itertools.chain(*map(triples, tr)))}
    counts[2] = collections.Counter((u, w) for _, u, w in counts[3])
    counts[1] = collections.Counter(w for _, w in counts[2])
    cc = lambda x: [sum(1 for k in x.values() if k == i) for i in (1, 2, 3, 4)]
    d = {k: [0, *ngram.discounts(*cc(x))] for k, x in counts.items()}
    total, left = collections.Counter(), collections.Counter()
    for k in (2, 3):
        for g, x in counts[k].items():
            total[g[:-1]] += x
            left[g[:-1]] += d[k][min(x, 3)]
    tot = sum(counts[1].values())
    floor = sum(d[1][min(x, 3)] for x in counts[1].values()) / tot / (v + 1)

    def p(context, w):
        k = len(context) + 1
        if k == 1:
            return max(counts[1][w] - d[1][min(counts[1][w], 3)], 0) / tot + floor
        lower = p(context[1:], w)
        if context not in total:
            return lower
        x = counts[k][(*context, w)]
        return max(x - d[k][min(x, 3)], 0) / total[context] + left[context] / total[context] * lower

    for context in ((VOCAB[0].encode(), VOCAB[1].encode()), ("<s>", "<s>"), triples(tr[0])[5][:2]):
        assert sum(p(context, w) for w in [*c, "?"]) == pytest.approx(1)
    for r, (i, t) in zip(got, sorted(TEXTS, key=lambda x: (x[0], len(text(x[1]))))):
        t = text(t)
        assert (r.doc_id, r.n_tokens, r.n_known) == (i, len(t), sum(w in c for w in t))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r.score == pytest.approx(sum(math.log10(p((a, u), w)) for a, u, w in triples(t)))
    none = ngram.learn(empty, Scratch(spark, "t"))
    assert ngram.score(empty, none).count() == 0 and {r.score for r in ngram.score(docs, none).collect()} == {0.0}


def test_packed_columns_and_wide_ids_round_trip():
    r = np.random.default_rng(1)
    cols = [r.integers(0, 1 << 32, 1000).astype(np.uint32) for _ in range(4)]
    assert all((a == b).all() for a, b in zip(ngram.unsqueezed(ngram.squeezed(cols), 4), cols))
    u, t, w = (r.integers(0, 5, 300).astype(np.uint32) for _ in range(3))
    narrow = ngram.count_triples(u, t, w, np.ones(300, np.uint32))
    wide = ngram.count_triples(*[x + np.uint32(1 << 31) for x in (u, t, w)], np.ones(300, np.uint32))
    assert all((a == b - (np.uint32(1 << 31) if i < 3 else 0)).all() for i, (a, b) in enumerate(zip(narrow, wide)))


def test_ids_of_any_type_name_the_rows(spark):
    rows = [("b", "zork zork one two three", 1, "aa"), (None, None, 0, "bb"), ("a", "zork zork one two three", 1, "aa"), ("c", "4111111111111111 plain", 0, "bb")]
    df = spark.createDataFrame(rows, "doc_id string, text string, y long, lang string")
    ids = ["", "a", "b", "c"]
    got = simhash.components(df)
    assert sorted(r.doc_id or "" for r in got.collect()) == ids and {r.doc_id: r.component_id for r in got.collect()}["b"] == "a"
    for out in (
        pii.pseudonymised(df, b"k"), toxicity.score(df, toxicity.learn(df, Scratch(spark, "t"))), langid.predict(df, langid.learn(df, Scratch(spark, "t"))),
        ngram.score(df, ngram.learn(df, Scratch(spark, "t"))),
    ):
        assert sorted(r.doc_id or "" for r in out.collect()) == ids


SECRETS = [
    (1, 'token = "abcdefgh12345"'), (2, "token=secret: abcdefghijk"), (3, None), (4, ""), (5, "x AKIAABCDEFGHIJKL y AKIA1 " + "0f" * 20), (6, "é\U0001f600 PASSWORD:'A+/_.=-12' api-key api_key=short apikey : longenough1"),
    (7, "0f" * 15 + "g" + "0f" * 16), (8, 'token = "abcdefgh12345"'), (9, "password=token=abcdefghi"), (10, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36), (11, "a" * 5000 + " secret = zzzzzzzz " + "b" * 40),
]


def brute_secrets(t):
    t = t or ""
    out = []
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [(m.start(), 0, "assign", m.end()) for m in a.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_secret_spans_and_ledger(spark):
    df = spark.createDataFrame([(i, 0, t, "c") for i, t in SECRETS], "path long, version int, text string, blob string")
    found, ledger = secrets.scan(df)
    got = {r.path: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in secrets.BASE) for r in found.collect()}
    assert got == {i: brute_secrets(t) for i, t in SECRETS}
    assert ledger.count() == len({t or "" for _, t in SECRETS})
    more = df.unionByName(spark.createDataFrame([(12, 1, "secret=newsecret99", "c"), (13, 0, SECRETS[0][1], "c")], df.schema))
    again, new = secrets.scan(more, ledger)
    assert new.count() == 1 and {r.path: len(r.spans) for r in again.collect()}[13] == 1
    assert secrets.scan(more, ledger, rules="3")[1].count() == ledger.count() + 1
    assert secrets.scan(df.limit(0))[0].count() == 0


def test_redaction_removes_findings_only(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in SECRETS], "doc_id long, text string, spans string")
    got = {r.doc_id: r.text for r in secrets.redacted(df).collect()}
    assert secrets.redacted(df).columns == df.columns and got[3] is None and got[4] == "" and got[2] == SECRETS[1][1]
    assert got[1] == "[SECRET]\"" and all(not brute_secrets(t) for t in got.values())
    no_ids = [(None, "password = hunter2hunter2"), (None, "nothing here"), (5, "x password = hunter2hunter2"), (5, "token=abcdefgh99 y")]
    out = secrets.redacted(spark.createDataFrame(no_ids, "doc_id long, text string"))
    assert sorted(r.text for r in out.collect()) == sorted(["[SECRET]", "nothing here", "x [SECRET]", "[SECRET] y"])


def test_suffix_dedup_matches_brute_force(spark, docs, empty):
    length = 40
    r = random.Random(4)
    rows = [(i, t) for i, t in TEXTS] + [(50 + i, prose(30, 100 + i) + LONG[r.randrange(5000) :][: r.randrange(20, 120)] + prose(r.randrange(5), 200 + i)) for i in range(60)] + [(200, "ab" * 200), (201, "é" * 41)]
    got = suffixdup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=length, v=21, block_bytes=2000).collect()
    count = collections.Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        count.update(b[p : p + length] for p in range(len(b) - length + 1))
    want = []
    for i, b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want) and sum(w[2] for w in want)
    assert suffixdup.deduplicate(empty).count() == 0


@pytest.mark.parametrize("v", [1, 2, 3, 7, 21, 64, 100, 133])
def test_difference_covers(v):
    d = suffixdup.difference_cover(v)
    assert len(np.unique((d[:, None] - d[None, :]) % v)) == v and len(d) <= 2.2 * v**0.5 + 2


def test_language_by_centroid(spark, empty):
    a, b = "abcde", "vwxyz"
    make = lambda al, s: "".join(random.Random(s).choices(al + " ", k=200))
    rows = [(i, make(a if i % 2 else b, i), "aa" if i % 2 else "bb") for i in range(100)] + [(200, None, "aa"), (201, "", "bb"), (202, "12 !", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df, Scratch(spark, "t"))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert all(got[i].lang_pred == ("aa" if i % 2 else "bb") for i in range(100)) and all(got[i].lang_pred == "und" for i in (200, 201, 202))
    assert all(0 <= r.score <= 1 for r in got.values()) and sum(got[i].rejected for i in range(100)) <= len(model.owner)  # a cluster's farthest own row lies below its quantile
    assert {r.lang_pred for r in langid.predict(df, langid.learn(df.limit(0), Scratch(spark, "t"))).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0
    marks = spark.createDataFrame([(1, "½ ²"), (2, "Ⅷ ①"), (3, "_-_"), (4, "漢"), (5, "½ a")], "doc_id long, text string")  # numerals are no letters
    assert {r.doc_id for r in langid.predict(marks, model).collect() if r.lang_pred == "und"} >= {1, 2, 3}


def pgm(a):
    return b"P5 %d %d 255\n" % (a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()


def test_media_finds_crops_edits_and_turns(spark):
    def scene(seed):
        r = np.random.default_rng(seed)
        a = np.kron(r.integers(0, 256, (40, 40)), np.ones((6, 6)))
        return a.astype(np.uint8)

    one, two = scene(1), scene(2)
    edited = one.copy()
    edited[100:140, 60:100] = 0
    rows = [(1, pgm(one)), (2, pgm(one)), (3, pgm(one[36:220, 24:230])), (4, pgm(edited)), (5, pgm(np.rot90(one))), (6, pgm(two)), (7, pgm(two[12:, 12:])), (8, None), (9, b""), (10, b"P5 broken"), (11, pgm(scene(3))), (12, pgm(np.zeros((90, 90))))]
    got = {r.id: r for r in media.copies(spark.createDataFrame(rows, "id long, content binary")).collect()}
    assert [got[i].class_id for i in range(1, 13)] == [1, 1, 1, 1, 1, 6, 6, 8, 9, 10, 11, 12]
    assert media.copies(spark.createDataFrame([], "id long, content binary")).count() == 0


@pytest.mark.parametrize("bucket", [1024, 2])
def test_media_copies_meet_behind_lesser_images_of_their_keys(spark, monkeypatch, bucket):
    monkeypatch.setattr(media, "BUCKET", bucket)
    r = np.random.default_rng(8)
    one = np.kron(r.integers(0, 256, (40, 40)), np.ones((6, 6))).astype(np.uint8)
    edited = one.copy()
    edited[100:140, 60:100] = 0
    rows = [(50, pgm(one)), (51, pgm(edited))]
    for i, (y, x) in enumerate(itertools.product((0, 12, 24, 36), repeat=2)):  # the same patches, but in other places
        tiles = [np.roll(one, (-y, -x), (0, 1))[a : a + 48, b : b + 48] for a in range(0, 240, 48) for b in range(0, 240, 48)]
        tiles = [tiles[j] for j in r.permutation(25)]
        rows.append((i, pgm(np.block([tiles[j : j + 5] for j in range(0, 25, 5)]))))
    got = {x.id: x.class_id for x in media.copies(spark.createDataFrame(rows, "id long, content binary"), min_votes=40).collect()}
    assert got == {i: min(i, 50) for i in got}


def test_op10_finds_edited_copies_of_ordinary_pages(spark, tmp_path):
    from plumbline.llm import registry

    rows = []
    for i in range(12):
        w = prose(220, 500 + i).split()
        v = list(w)
        v[110] = "#" * len(v[110])  # the rest of the page stays in place
        rows += [(2 * i, "<p>%s</p>" % " ".join(w)), (2 * i + 1, "<p>%s</p>" % " ".join(v))]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.class_id for r in registry.op10_media(spark, str(tmp_path)).collect()}
    assert got == {i: i // 2 * 2 for i in range(24)}


def test_png_decodes():
    import struct

    a = np.random.default_rng(0).integers(0, 256, (5, 7), np.uint8)
    raw = b"".join(b"\x01" + bytes([int(r[0]), *[(int(y) - int(x)) & 255 for x, y in zip(r, r[1:])]]) for r in a)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (media.decode(png) == a).all()


def test_pipeline_stages(spark, small, docs):
    import corpus_pipeline as cp
    from plumbline.llm.common import read

    frame, before = read(spark, small, "documents").withColumn("extra", F.lit(1)), None
    for name, stage in cp.STAGES:
        out = Scratch(spark, "t").keep(stage(spark, frame, small), name)
        if name != "mixing":
            assert out.columns == frame.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert before is None or ids <= before
        frame, before = out, ids
    assert before and set(frame.columns) >= {"taken", "target"}
    for _, stage in cp.STAGES:
        assert stage(spark, read(spark, small, "documents").limit(0), small).count() == 0
