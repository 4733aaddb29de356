"""Connected components by alternating large-star and small-star rounds, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch


def _mark() -> list[Column]:
    """Number and order-free hashes of the edges; taken while a round is written."""
    return [F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1_000_003))).alias("s")]


def _round(edges: DataFrame, scratch: Scratch, name: str, large: bool) -> tuple[DataFrame, dict]:
    """Large: every greater neighbour of u is hung on u's least; small: every lesser one, and u itself.

    The minima are a table of their own, so the join reads two plain tables and a hub's rows can be split.
    """
    both = edges.select(F.col("u"), F.col("v")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    sym = both if large else both.filter("v < u")
    least = scratch.keep(sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"{name}-least")
    on = sym.join(least, "u")
    hung = on.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else on.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = scratch.keep_with(hung.filter("u <> v").distinct(), name, *_mark())
    scratch.drop(f"{name}-least")
    return out


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(node, root): the least node reachable, for every node of an edge. ``edges(u, v)`` in any direction.

    Ends when a round changes nothing, by count and an order-free hash of the edges; the number of rounds
    grows with the logarithm of the component size.
    """
    edges = edges.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state, seen = scratch.keep_with(edges, f"{label}0", *_mark())
    n = 0
    while seen["n"]:
        n += 1
        a, _ = _round(state, scratch, f"{label}{n}a", large=True)
        state, now = _round(a, scratch, f"{label}{n}", large=False)
        scratch.drop(f"{label}{n}a")
        scratch.drop(f"{label}{n - 1}")
        if now == seen:
            break
        seen = now
    stars = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
