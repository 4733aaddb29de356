"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped edges.

A text is the set of its distinct word shingles. One hash a shingle orders them; the hash space is cut in bins, and
the least hash of each bin is the signature. An empty bin takes the value of the first filled bin in an order of its
own, the same for all texts, so each bin of two sets agrees with the chance of their similarity. Bands of bins are
the keys of buckets.

In each bucket every text is compared with one hub alone, the text of the bucket that shares the most bucket places,
so a bucket of m texts costs m - 1 edges. Stars lose pairs whose hub is unlike; so texts of buckets that still hold
several components are compared again by an exact prefix filter: with shingles ordered from rare to frequent, two
similar sets share one among their first (1 - t) n + 1. Frequent shingles of a template are not among those, so
pages that share a template and no more are never paired. All edges are confirmed on full sets; a similar pair is
missed only if none of its bands agrees (below).

Equal sets are one node, with or without an id and however often ids repeat. Null and empty texts, and texts without
a word, have no set and link with nothing. A component is named by its least doc_id, null where no row of it has one.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, arrow, docs_view, id_kind, only, rows_of
from plumbline.llm.graph import connected_components
from plumbline.llm.simhash import SKETCH, parity_sketch, shingle_hashes

#: Bins of a band, and bands. Two sets of similarity s agree in no band with probability (1 - s ** ROWS) ** BANDS:
#: 7e-8 at 0.85, 1e-13 at 0.9.
ROWS, BANDS = 8, 52
BINS = ROWS * BANDS
_EDGE = np.array([(i << 64) // BINS for i in range(BINS)], np.uint64)
_NEXT = np.append(_EDGE[1:] - np.uint64(1), np.uint64(2**64 - 1))
#: Row i: when the empty bin i looks into each bin. A permutation, so it meets a filled one at the latest in its last look.
_TURN = np.random.default_rng(20242).permuted(np.tile(np.arange(BINS, dtype=np.uint16), (BINS, 1)), axis=1)


def signature(h: np.ndarray) -> np.ndarray:
    """Least hash of each bin of sorted distinct hashes, empty bins densified."""
    at = np.searchsorted(h, _EDGE)
    value = h[np.minimum(at, len(h) - 1)]
    filled = (at < len(h)) & (value <= _NEXT) & (value >= _EDGE)
    full, empty = np.flatnonzero(filled), np.flatnonzero(~filled)
    if len(empty):
        value[empty] = value[full[_TURN[np.ix_(empty, full)].argmin(axis=1)]]
    return value


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key a band; an empty set has none."""
    if not len(h):
        return np.empty(0, np.int64)
    x = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in signature(h).reshape(BANDS, ROWS).T:
        x = (x ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
    return x.view(np.int64)


def _set(text: str | None, shingle: int) -> tuple[bytes, np.ndarray]:
    """(name of the set, its sorted distinct hashes)."""
    h = np.unique(shingle_hashes(text, shingle))
    return xxhash.xxh3_128_digest(h.tobytes()), h


def prints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, digest, n, keys), one pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(name, len(h), band_keys(h)) for name, h in (_set(t, shingle) for t in rows_of(b, "text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
                names=["doc_id", "digest", "n", "keys"],
            )

    return docs_view(docs).transform(arrow(run, f"doc_id {id_kind(docs)}, digest binary, n long, keys array<long>"))


def stars(shared: DataFrame) -> DataFrame:
    """(a, b): each row of a bucket with the bucket's hub, the node that meets the most others over all its buckets."""
    weight = shared.groupBy("node").agg(F.sum("c").alias("w"))
    hub = shared.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("w", "node")).alias("hub"))
    edges = shared.join(hub, "key").filter("node <> hub")
    return edges.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of rows in different components that may be similar, by prefix, position, size and sketch.

    ``sets(node, root, h, sk)``. Exact: each condition holds for every pair of at least ``percent`` of a hundred, the
    one on positions at the first shingle that the pair has in common, the one on ``parity_sketch`` always.
    """
    each = sets.select("node", "root", F.size("h").alias("n"), F.explode("h").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("f"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("f", "s"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1
    post = each.join(often, "s").withColumn("rank", rank).filter((F.col("rank") <= first) & (F.col("f") > 1)).select("s", "node", "root", "n", "rank")
    per = post.groupBy("s", "root").agg(F.count("*").alias("m"))
    main = per.groupBy("s").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1").select("s", "main")
    live = post.join(main, "s").join(sets.select("node", "sk"), "node")
    guest = live.filter("root <> main").select("s", *[F.col(c).alias(f"g_{c}") for c in ("node", "root", "n", "rank", "sk")])
    both, apart = F.col("n") + F.col("g_n"), sum((F.bit_count(F.get("sk", F.lit(i)).bitwiseXOR(F.get("g_sk", F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))
    fits = F.least("n", "g_n") * 100 >= F.greatest("n", "g_n") * percent
    enough = (F.least(F.col("n") - F.col("rank"), F.col("g_n") - F.col("g_rank")) + 1) * (100 + percent) >= both * percent
    close = apart * (100 + percent) <= both * (100 - percent)
    once = (F.col("root") == F.col("main")) | (F.col("node") < F.col("g_node"))
    pair = guest.join(live, "s").filter((F.col("root") != F.col("g_root")) & once & fits & enough & close)
    return pair.select(F.least("node", "g_node").alias("a"), F.greatest("node", "g_node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of all pairs with 100 * intersection >= percent * union.

    The chances stated with ROWS and BANDS hold for ``percent`` of 85 and more.
    """
    if percent < 85:
        raise ValueError("the bands are laid out for a similarity of 0.85 and more")
    scratch = Scratch(docs.sparkSession, "minhash")
    marked = scratch.keep(prints(docs, shingle), "prints")
    copies = marked.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
    nodes = scratch.keep(copies.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written, so the numbers stay
    named = scratch.keep(marked.select("doc_id", "digest", "n"), "named")
    scratch.drop("prints")

    keyed = nodes.select("node", F.explode("keys").alias("key"))
    sizes = scratch.keep(keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "sizes")
    shared = scratch.keep(keyed.join(sizes, "key"), "shared")

    # Full sets of all texts that share a bucket. Rows are found by id, then told apart by their set's name.
    met = scratch.keep(nodes.select("node", "digest", "doc_id").join(shared.select("node").distinct(), "node", "left_semi"), "met")
    view = docs_view(docs)
    wanted = only(view, met.filter("doc_id is not null"), "doc_id", met.count())
    if met.filter("doc_id is null").limit(1).count():
        wanted = wanted.unionByName(view.filter("doc_id is null"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_set(t, shingle) for t in rows_of(b, "text")]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in ([r[1].view(np.int64) for r in rows], [parity_sketch(r[1]) for r in rows])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), *lists], names=["digest", "h", "sk"])

    sets = wanted.transform(arrow(full, "digest binary, h array<long>, sk array<long>")).join(met.select("digest", "node"), "digest").select("node", "h", "sk")
    sets = scratch.keep(sets.dropDuplicates(["node"]), "sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        j = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
        both = F.size(F.array_intersect("ha", "hb"))
        return scratch.keep(j.filter(both * 100 >= (F.size("ha") + F.size("hb") - both) * percent).select(F.col("a").alias("u"), F.col("b").alias("v")), name)

    size = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    edges = scratch.keep(stars(shared), "stars").join(size("a"), "a").join(size("b"), "b")
    edges = edges.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b")
    links = confirmed(edges, "links-star")
    scratch.drop("stars")
    comp = connected_components(links, scratch, "cc-star")

    # Buckets with more than one component: what their hub did not settle.
    state = scratch.keep(shared.join(comp.withColumnRenamed("node", "_n").withColumnRenamed("root", "_r"), F.col("node") == F.col("_n"), "left").select("key", "node", F.coalesce("_r", "node").alias("root")), "state")
    mixed = state.groupBy("key").agg((F.min("root") < F.max("root")).alias("open")).filter("open").select("key")
    rest = scratch.keep(state.join(mixed, "key", "left_semi").select("node", "root").distinct(), "rest")
    again = scratch.keep(prefix_pairs(sets.join(rest, "node"), percent), "again")
    links = scratch.keep(links.unionByName(confirmed(again, "links-rest")), "links")
    for spent in ("sizes", "shared", "state", "rest", "again", "sets", "met", "links-star", "links-rest"):
        scratch.drop(spent)
    comp = connected_components(links, scratch)
    root = nodes.select("node", "digest", "doc_id").join(comp, "node", "left").select("digest", "doc_id", F.coalesce("root", "node").alias("root"))
    least = root.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = scratch.keep(root.join(least, "root").select("digest", F.col("root"), "component_id"), "classes")
    out = named.join(classes, "digest", "left")
    alone = F.col("root").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
