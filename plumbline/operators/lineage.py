"""Transitive duplicate roots over a functional graph (J7) and the dedupe that uses them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_edges(long: DataFrame) -> DataFrame:
    """(src, dst) from the duplicateId rows; the last row of a patent wins."""
    return (
        long.filter((F.col("Field") == "duplicateId") & F.col("Value").isNotNull() & (F.trim("Value") != ""))
        .groupBy(F.col("Patent_ID").alias("src")).agg(F.trim(F.max_by("Value", "row_ord")).alias("dst"))
    )


def duplicate_roots(ids: DataFrame, edges: DataFrame, max_chain: int | None = None) -> DataFrame:
    """(id, root_id) for every id, by pointer doubling; cycles end at the first cycle node reached.

    ``ids(id)``, ``edges(src, dst)`` with one edge per src. A dangling target is a root. Each doubling is one
    self-join on the key that also notes which walks still move, so rounds follow the logarithm of the longest
    chain; only where there is a cycle is ``max_chain`` (the number of edges) walked to find its nodes. Nodes on
    a cycle are their own roots: their out-edges go before the doubling. The frames are checkpointed where a
    checkpoint folder is set, else persisted and released a round later.
    """
    edges = edges.select("src", "dst").dropna().dropDuplicates(["src"])
    shared = bool(edges.sparkSession.sparkContext.getCheckpointDir())
    keep = (lambda d: d.checkpoint()) if shared else (lambda d: d.persist())
    drop = (lambda d: None) if shared else (lambda d: d.unpersist())
    edges = keep(edges)

    def doubled(f: DataFrame, rounds: int | None = None) -> DataFrame:
        n = 0
        while rounds is None or n < rounds:
            to = f.select(F.col("src").alias("dst"), F.col("dst").alias("dst2"))
            g = keep(f.join(to, "dst", "left").select("src", F.coalesce("dst2", "dst").alias("dst"), (F.col("dst2").isNotNull() & (F.col("dst2") != F.col("dst"))).alias("moved")))
            moving = g.filter("moved").limit(1).count()
            if n:
                drop(f)
            f, n = g.select("src", "dst"), n + 1
            if not moving:
                break
        return f

    # Along acyclic chains a walk stops moving; on cycles it never does. So the nodes of cycles are found first.
    if max_chain is None:
        max_chain = edges.count() + 1
    on_cycle = _cycle_nodes(edges, keep, max_chain)
    flat = doubled(keep(edges.join(on_cycle, "src", "left_anti")))
    return ids.select("id").distinct().join(flat, F.col("id") == F.col("src"), "left").select("id", F.coalesce("dst", "id").alias("root_id"))


def _cycle_nodes(edges: DataFrame, keep, max_chain: int) -> DataFrame:
    """(src) on cycles. Walks that end at a node without an out-edge are dropped as soon as they do; where all
    have ended there is no cycle, after rounds in the logarithm of the longest chain. Those that outlive
    ``max_chain`` steps stand on cycles, and where they stand is all of them."""
    live, steps = edges, 1
    while steps <= max_chain:
        to = live.select(F.col("src").alias("dst"), F.col("dst").alias("dst2"))
        live = keep(live.join(to, "dst").select("src", F.col("dst2").alias("dst")))  # inner: an ended walk goes
        if not live.limit(1).count():
            break
        steps *= 2
    return live.select(F.col("dst").alias("src")).distinct()


def dedupe_to_roots(df: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Rows whose key is its own root; keys without a root row stay."""
    gone = roots.filter("root_id <> id").select(F.col("id").alias(key))
    return df.join(gone, key, "left_anti")


def dangling_targets(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Targets absent from the data: their whole chain leaves the deduped table."""
    return edges.select(F.col("dst").alias("id")).distinct().join(ids.select("id"), "id", "left_anti")
