"""SimHash near-duplicates with generalised-pigeonhole candidate search.

Fingerprints are counted over word shingles; distinct ones are joined within a Hamming radius. Bits that
move together are put into one partition, each partition gets its own radius (from -1, never probed) by
dynamic programming over estimated candidate counts, and the radii add up to tau - m + 1, which by the
generalised pigeonhole principle loses no link. Signatures with up to that many bits masked are probed,
oversized buckets are refined by the remaining bits, and every link is verified on the whole fingerprint.

Nulls and texts without a word have fingerprint zero and link like any other. Ties (a bit set in exactly
half the hashes) give 0. Repeated rows share a fingerprint, hence a component. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, arrow, docs_view, id_kind, only, rows_of
from plumbline.llm.graph import connected_components

BITS = 64
#: Rows of a bucket that one task compares; larger buckets are split by further bits first.
BUCKET = 1024


def word_spans(text: str | None) -> tuple[bytes, list[int], list[int]]:
    """Lower-cased words joined by single spaces, with each word's start and end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    ends = list(itertools.accumulate((len(w) + 1 for w in words)))
    return b" ".join(words), [0, *ends[:-1]] if ends else [], [e - 1 for e in ends]


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included; fewer words: the whole sequence; none: empty."""
    data, start, end = word_spans(text)
    if not start:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(start) <= k:
        return np.array([h(data, 42)], np.uint64)
    return np.array([h(data[a:b], 42) for a, b in zip(start, end[k - 1 :])], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 where it is set in over half the hashes; as a signed 64-bit integer."""
    if not len(h):
        return 0
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65536):
        count += np.unpackbits(h[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(h)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one pass over whole texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(shingle_hashes(t, shingle)) for t in rows_of(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs_view(docs).transform(arrow(run, f"doc_id {id_kind(docs)}, fp long"))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(n, joint counts of set bits) over all distinct fingerprints; 64 x 64 numbers a task reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, joint = 0, np.zeros((BITS, BITS), np.float64)
        for b in batches:
            x = np.array(b.column(0).to_numpy(zero_copy_only=False), dtype=np.int64).astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1)[:, ::-1].astype(np.float32)  # column i is bit i
            joint += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([joint.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "joint"])

    parts = fps.select("fp").transform(arrow(run, "n long, joint array<double>"))
    cells = parts.select("n", F.posexplode("joint").alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    out, n = np.zeros(BITS * BITS), 0
    for p, x, k in cells.collect():  # 4096 rows whatever the input
        out[p], n = x, k
    return int(n), out.reshape(BITS, BITS)


def partitions(n: int, joint: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of nearly equal width: each is grown from the most skewed free bit by correlation."""
    p = np.diag(joint) / max(n, 1)
    cov = joint / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    free, out = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        group = [max(free, key=lambda b: (abs(p[b] - 0.5), -b))]
        free.discard(group[0])
        while len(group) < width:
            nxt = max(free, key=lambda b: (corr[b, group].mean(), -b))
            group.append(nxt)
            free.discard(nxt)
        out.append(sorted(group))
    return out


def estimated(n: int, joint: np.ndarray, bits: list[int], t: int) -> tuple[float, float]:
    """(candidate pairs, signatures) of a partition at radius t, its bits taken as independent."""
    if t < 0:
        return 0.0, 0.0
    p = np.diag(joint)[bits] / max(n, 1)
    differ = 2 * p * (1 - p)
    dist = np.zeros(t + 1)
    dist[0] = 1.0
    for q in differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    masks = len(list(itertools.combinations(bits, t)))
    return dist.sum() * n * n / 2, float(masks) * n


def allocate(n: int, joint: np.ndarray, parts: list[list[int]], tau: int, per_signature: float = 4.0) -> tuple[float, list[int]]:
    """Radii that add up to tau - m + 1 at the least estimated cost, by dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in parts:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, min(tau, len(bits)) + 1):
                cand, sig = estimated(n, joint, bits, t)
                c, k = cost + cand + per_signature * sig, used + t
                if k not in nxt or c < nxt[k][0]:
                    nxt[k] = (c, [*ts, t])
        best = nxt
    return best.get(tau - len(parts) + 1, (float("inf"), []))


def plan(n: int, joint: np.ndarray, tau: int) -> list[tuple[list[int], int]]:
    """The cheapest number of partitions with its radii; partitions never probed are left out."""
    options = []
    for m in range(1, tau + 3):
        parts = partitions(n, joint, m)
        cost, ts = allocate(n, joint, parts, tau)
        if ts:
            options.append((cost, m, [(b, t) for b, t in zip(parts, ts) if t >= 0]))
    return min(options, key=lambda o: o[:2])[2]


def _mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def signatures(fps: DataFrame, layout: list[tuple[list[int], int]]) -> DataFrame:
    """(mask, key, fp): two fingerprints within radius t on a partition share the key of some t masked bits of it."""
    masks = [_mask(set(bits) - set(off)) for bits, t in layout for off in itertools.combinations(bits, t)]
    m = F.explode(F.array(*[F.lit(x).cast("long") for x in masks]))
    return fps.select("fp", m.alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")


def _forest(fp: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to connect all pairs within tau: each row to the first row of its component in the bucket."""
    n = len(fp)
    root = np.arange(n)
    for i in range(n):
        near = np.flatnonzero(np.bitwise_count((fp[i + 1 :] ^ fp[i]).view(np.uint64)) <= tau) + i + 1
        if len(near):
            olds = np.unique(np.append(root[near], root[i]))
            if len(olds) > 1:
                root[np.isin(root, olds)] = olds[0]
    at = np.flatnonzero(root != np.arange(n))
    return fp[at], fp[root[at]]


def _links_within(rows: DataFrame, tau: int) -> DataFrame:
    """Links of all buckets of a partition in one pass over its sorted rows; a bucket is held whole, no more."""

    def links(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        head = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])))
        size = np.diff(np.append(head, len(fp)))
        group = np.repeat(np.arange(len(head)), size)
        us, vs = [], []
        small = size <= 16
        for d in range(1, int(size[small].max(initial=1))):
            i = np.flatnonzero((group[:-d] == group[d:]) & small[group[:-d]])
            i = i[np.bitwise_count((fp[i] ^ fp[i + d]).view(np.uint64)) <= tau]  # of a signed number it would count the absolute value's bits
            us.append(fp[i])
            vs.append(fp[i + d])
        for g in np.flatnonzero(~small):
            u, v = _forest(fp[head[g] : head[g] + size[g]], tau)
            us.append(u)
            vs.append(v)
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cat(us)), pa.array(cat(vs))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for b in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, b.columns)]
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            at = int(np.argmax(same)) if len(same) else 0  # the last bucket may go on in the next batch
            if at:
                yield links(*[h[:at] for h in held])
                held = [h[at:] for h in held]
        if len(held[0]):
            yield links(*held)

    return rows.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").transform(arrow(run, "u long, v long"))


def _refine(rows: DataFrame, tau: int) -> DataFrame:
    """Rows of oversized buckets under longer keys: the bits outside the mask in tau + 1 parts, one of them equal."""
    rest = F.bitwise_not(F.col("mask"))
    free = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.getbit(rest, b) == 1)
    width = F.ceil(F.size(free) / F.lit(tau + 1)).cast("int")
    add = F.transform(
        F.sequence(F.lit(0), F.lit(tau)),
        lambda i: F.aggregate(F.slice(F.col("_free"), i * F.col("_w") + 1, F.col("_w")), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))),
    )
    x = rows.withColumn("_free", free).withColumn("_w", F.greatest(width, F.lit(1)))
    x = x.select("fp", F.explode(add).alias("_more"), F.col("mask").alias("_m")).select("fp", F.col("_m").bitwiseOR(F.col("_more")).alias("mask"))
    return x.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp").distinct()


def hamming_links(fps: DataFrame, tau: int, scratch: Scratch, label: str = "link") -> DataFrame:
    """(u, v) links that connect exactly what all pairs of distinct fingerprints within ``tau`` bits connect.

    A bucket is compared by one task only up to BUCKET rows. Larger ones are dealt anew under longer keys,
    again by the pigeonhole principle, until they fit; a bucket whose keys hold all but 10 bits always fits.
    """
    n, joint = bit_statistics(fps)
    layout = plan(n, joint, tau) if n else [([0], 0)]
    rows = signatures(fps, layout)
    out = None
    for depth in range(8):
        rows = scratch.keep(rows, f"{label}-sig{depth}")
        big = scratch.keep(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET), f"{label}-big{depth}")
        pairs = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n").between(2, BUCKET)).drop("n")
        links = scratch.keep(_links_within(rows.join(pairs, ["mask", "key"], "left_semi"), tau), f"{label}-out{depth}")
        out = links if out is None else out.unionByName(links)
        if not big.limit(1).count():
            break
        rows = _refine(rows.join(big, ["mask", "key"], "left_semi"), tau)
    return out


def components(docs: DataFrame, shingle: int = 3, tau: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): component by links at ``tau`` or fewer differing bits, named by its least doc_id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, shingle), "prints")
    first = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("d")), "distinct")
    comp = connected_components(hamming_links(first, tau, scratch), scratch)
    root = first.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "d", F.coalesce("root", "fp").alias("root"))
    least = root.groupBy("root").agg(F.min("d").alias("component_id"))
    named = scratch.keep(root.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


# Below: near-duplicates by similarity, for deduplication. Fingerprints within TAU bits are linked first, by the
# Hamming join above, and their pairs verified by shingles. A fingerprint of 64 bits tells 0.8 from 0.5
# only at ten and more differing bits, where no partition of 64 bits is selective. So what is similar and
# farther apart than TAU bits is completed from bands of least hashes of the shingle sets, as many keys for a
# long text as for a short one, verified in the same way.

#: Differing bits up to which fingerprints make candidates of the deduplication.
TAU = 3

SKETCH = 512
#: Least hashes of a band, and bands. Two sets of similarity s share no band with probability
#: (1 - s ** ROWS) ** BANDS: 5e-8 at 0.8, 2e-15 at 0.9.
ROWS, BANDS = 4, 32
_seeds = np.random.default_rng(20241).integers(1, 1 << 63, (2, ROWS * BANDS), dtype=np.uint64)
_XOR, _ODD = _seeds[0][:, None], _seeds[1][:, None] * np.uint64(2) + np.uint64(1)


def band_keys(h: np.ndarray) -> np.ndarray:
    """Keys of a set of distinct hashes: a hash of each band's least hashes; an empty set has none."""
    if not len(h):
        return np.empty(0, np.int64)
    least = np.concatenate([((h[None] ^ _XOR[i : i + 16]) * _ODD[i : i + 16]).min(axis=1) for i in range(0, ROWS * BANDS, 16)])
    x = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in least.reshape(BANDS, ROWS).T:
        x = (x ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
    return np.unique(x).view(np.int64)


def parity_sketch(h: np.ndarray) -> np.ndarray:
    """Parities of a set's elements by hash: two sets' sketches differ in no more bits than the sets in elements."""
    bits = (np.bincount((h >> np.uint64(7)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1).astype(np.uint8)
    return np.packbits(bits).view(">i8").astype(np.int64)


def _bucket_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of rows in a chunk of a bucket that lie in other classes and may be similar by size and sketch.

    ``rows(key, chunk, home, guest, doc_id, root, n, sk)``: guests meet all rows at home in the chunk.
    """
    far = (1 - similarity) / (1 + similarity)

    def pairs(home, guest, ids, root, n, sk):
        us, vs = [], []
        at = np.flatnonzero(home)
        for g in np.flatnonzero(guest):
            i = at[(root[at] != root[g]) & (np.minimum(n[at], n[g]) >= similarity * np.maximum(n[at], n[g]) - 1e-6)]
            i = i[np.bitwise_count((sk[i] ^ sk[g]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= far * (n[i] + n[g]) + 1e-6]
            us.append(np.minimum(ids[i], ids[g]))
            vs.append(np.maximum(ids[i], ids[g]))
        return us, vs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                cols = [c.to_numpy(zero_copy_only=False) for c in b.columns[:-1]] + [b.column(7).flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCH // 64)]
                held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            if held is None or not len(held[0]):
                continue
            head = np.flatnonzero(np.append(True, (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])))
            ends = np.append(head[1:], len(held[0]))
            us, vs = [], []
            for s, e in zip(head, ends) if b is None else zip(head[:-1], ends[:-1]):  # the last may go on in the next batch
                u, v = pairs(*[x[s:e] for x in held[2:]])
                us += u
                vs += v
            held = [x[head[-1] :] for x in held]
            if us:
                both = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], axis=1), axis=0)
                for i in range(0, len(both), 100_000):
                    part = both[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["a", "b"])

    return rows.select("key", "chunk", "home", "guest", "doc_id", "root", "n", "sk").repartition("key", "chunk").sortWithinPartitions("key", "chunk").transform(arrow(run, "a long, b long"))


def print_pairs(reps: DataFrame, scratch: Scratch, tau: int = TAU) -> DataFrame:
    """(a, b) of ``reps(doc_id, fp)`` whose fingerprints differ in ``tau`` bits at most, enough to connect all such.

    A fingerprint is stood for by its least doc_id; rows of one fingerprint are chained, large groups in chunks.
    """
    first = scratch.keep(reps.groupBy("fp").agg(F.min("doc_id").alias("d"), F.count("*").alias("c")), "first")
    end = lambda c, d: first.select(F.col("fp").alias(c), F.col("d").alias(d))
    across = hamming_links(first, tau, scratch, "print").join(end("u", "a"), "u").join(end("v", "b"), "v").select("a", "b")
    many = reps.select("doc_id", "fp").join(first.filter("c > 1"), "fp").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("c") / BUCKET)))
    before = F.lag("doc_id").over(Window.partitionBy("fp", "chunk").orderBy("doc_id"))
    within = many.select(F.coalesce(before, "d").alias("a"), F.col("doc_id").alias("b")).filter("a <> b")
    return across.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, class_id, n_links): classes that all pairs with Jaccard similarity of word shingles of at least ``similarity`` connect.

    Texts with the same words collapse first, so groups of copies cost one row. A similar pair shares a key of
    ``band_keys`` but for a chance of 5e-8 at most (at ROWS and BANDS as they are, for 0.8). First texts whose
    SimHash fingerprints differ in TAU bits at most are linked. Then texts of different classes that are next to each
    other in a bucket meet, which connects most of a family. Then in each bucket all pairs of still different classes
    are compared, but for those that size or sketch rule out; large buckets are dealt out in chunks. Only the exact similarity makes a link. n_links counts the links
    verified, not every similar pair. Null and empty texts form one class.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    view = docs_view(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in rows_of(b, "text"):
                all_h = shingle_hashes(t, shingle)
                h = np.unique(all_h)
                rows.append((xxhash.xxh128_digest(word_spans(t)[0]), len(h), band_keys(h), parity_sketch(h), fingerprint(all_h)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int64())), pa.array([r[4] for r in rows], pa.int64())],
                names=["doc_id", "words", "n", "keys", "sk", "fp"],
            )

    prints = scratch.keep(view.transform(arrow(run, "doc_id long, words binary, n long, keys array<long>, sk array<long>, fp long")), "prints")
    copies = scratch.keep(prints.groupBy("words").agg(F.min("doc_id").alias("rep")), "copies")
    reps = prints.join(copies.select("words", F.col("rep").alias("doc_id")), ["words", "doc_id"], "left_semi").dropDuplicates(["doc_id"])
    reps = scratch.keep(reps.select("doc_id", "n", "sk", "keys", "fp"), "reps")
    named = scratch.keep(prints.select("doc_id", "words"), "named")
    scratch.drop("prints")

    keyed = reps.select("doc_id", F.explode("keys").alias("key"))
    sizes = scratch.keep(keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "sizes")
    deal = F.pmod(F.xxhash64("doc_id", "key"), F.ceil(F.col("c") / BUCKET)).cast("int")
    shared = scratch.keep(keyed.join(sizes, "key").select("key", "c", "doc_id", deal.alias("chunk")), "shared")
    slim = reps.select("doc_id", "n", "sk")
    far = (1 - similarity) / (1 + similarity)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in rows_of(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(h, pa.list_(pa.int64()))], names=["doc_id", "h"])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        some = scratch.keep(only(view, ids, "doc_id", ids.count()).transform(arrow(sets, "doc_id long, h array<long>")).dropDuplicates(["doc_id"]), f"{name}-sets")
        j = pairs.join(some.select(F.col("doc_id").alias("a"), F.col("h").alias("ha")), "a").join(some.select(F.col("doc_id").alias("b"), F.col("h").alias("hb")), "b")
        both = F.size(F.array_intersect("ha", "hb"))
        out = scratch.keep(j.filter(both >= similarity * (F.size("ha") + F.size("hb") - both)).select(F.col("a").alias("u"), F.col("b").alias("v")), f"{name}-links")
        scratch.drop(f"{name}-sets")
        return out

    apart = sum((F.bit_count(F.get("sk_a", F.lit(i)).bitwiseXOR(F.get("sk_b", F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))

    def close(pairs: DataFrame, rows: DataFrame) -> DataFrame:
        """Pairs of different roots that may be similar by size and sketch."""
        side = lambda c: rows.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sk").alias(f"sk_{c}"), F.col("root").alias(f"root_{c}"))
        may = (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6) & (apart <= far * (F.col("n_a") + F.col("n_b")) + 1e-6)
        return pairs.join(side("a"), "a").join(side("b"), "b").filter(F.col("root_a") != F.col("root_b")).filter(may).select("a", "b")

    by_print = scratch.keep(print_pairs(reps, scratch), "by-print")
    links = verified(scratch.keep(close(by_print, slim.withColumn("root", F.col("doc_id"))), "close-print"), "print")
    comp = connected_components(links, scratch, "cc-print").withColumnRenamed("node", "doc_id")
    rooted = scratch.keep(slim.join(comp, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "rooted")

    beside = F.lead("doc_id").over(Window.partitionBy("key", "chunk").orderBy(F.xxhash64("key", "doc_id"), "doc_id"))
    chain = shared.select("doc_id", beside.alias("next")).filter("next is not null")
    chain = scratch.keep(chain.select(F.least("doc_id", "next").alias("a"), F.greatest("doc_id", "next").alias("b")).distinct(), "chain")
    links = links.unionByName(verified(scratch.keep(close(chain, rooted), "close"), "first"))
    spent_prints = [f"print-{x}{i}" for x in ("sig", "big", "out") for i in range(8)]
    for spent in ("first", "by-print", "close-print", "rooted", "chain", *spent_prints):
        scratch.drop(spent)
    comp = connected_components(links, scratch, "cc-first").withColumnRenamed("node", "doc_id")

    # Buckets that hold more than one class: rows outside a bucket's largest class are guests of all its chunks.
    state = shared.join(comp, "doc_id", "left").select("key", "c", "chunk", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    state = scratch.keep(state, "state")
    scratch.drop("shared")
    per = state.groupBy("key", "root").agg(F.count("*").alias("m"))
    mixed = per.groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1").select("key", "main")
    rest = state.join(scratch.keep(mixed, "mixed"), "key").withColumn("guest", F.col("root") != F.col("main"))
    to = F.when(F.col("guest"), F.sequence(F.lit(0), (F.ceil(F.col("c") / BUCKET) - 1).cast("int"))).otherwise(F.array("chunk"))
    rest = rest.join(slim, "doc_id").select("key", "chunk", "guest", "doc_id", "root", "n", "sk", F.explode(to).alias("to"))
    rest = rest.select("key", F.col("to").alias("chunk"), (F.col("to") == F.col("chunk")).alias("home"), "guest", "doc_id", "root", "n", "sk")
    across = scratch.keep(_bucket_pairs(rest, similarity).distinct(), "across")
    links = scratch.keep(links.unionByName(verified(across, "second")), "links")
    for spent in ("reps", "close", "state", "mixed", "across", "sizes"):
        scratch.drop(spent)
    comp = connected_components(links, scratch)
    degree = links.select(F.col("u").alias("rep")).unionByName(links.select(F.col("v").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    classes = copies.join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    classes = scratch.keep(classes.select("words", F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    scratch.drop("copies")
    return named.join(classes, "words").select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One row of each near-duplicate class stays: the least doc_id, rows without one last. Columns are those of ``docs``.

    Classes are those of ``near_duplicates``: verified SimHash links, completed by the pairs that fingerprints miss.
    Rows have a scratch key, so that rows without an id are compared like others and repeated rows leave one.
    The keys are broadcast while their counted number is bounded; beyond it the join shuffles.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    rows = scratch.keep(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    classes = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), **how).select(F.col("doc_id").alias("_row"), "class_id")
    named = classes.join(rows.select("_row", "doc_id"), "_row")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    kept = scratch.keep(named.groupBy("class_id").agg(least.alias("least")).select(F.col("least._row").alias("_row")), "ids")
    return only(rows, kept, "_row", kept.count()).select(*docs.columns)
