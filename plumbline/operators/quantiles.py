"""Exact quantiles by distributed selection (A16, A21): the edges of ``percentile`` without its one buffer.

Each wanted rank has a range of values that is known to hold it. While a range holds more rows than one task
should sort, a sketch of its values proposes a narrower one and an exact count decides which part the rank is in,
so a bad sketch costs a round and never the result. What is left is counted by value, so ties cost one row, and
sorted within its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut, join_null_safe

#: Rows of a range that are sorted; a range with more is narrowed.
RANGE = 1_000_000
GRID = 500
#: Ranges up to this many are broadcast, a few numbers each; with more groups the joins shuffle.
BROADCAST = 100_000


def exact_quantiles(df: DataFrame, col: str, probs: list[float], by: list[str] | None = None, most: int = RANGE) -> DataFrame:
    """(by ..., n_valid, quantiles): linear interpolation between order statistics, as numpy and ``percentile`` have it.

    Nulls and NaN are no values. A group without values has null quantiles; without ``by`` there is always one row.
    """
    if any(not 0 <= p <= 1 for p in probs):
        raise ValueError(f"probabilities must lie in 0..1, not {probs}")
    g = [f"_by{i}" for i in range(len(by or []))]
    x = F.col(col).cast("double")
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by or [], g)], F.when(~F.isnan(x), x + F.lit(0.0)).alias("x"))  # -0.0 is 0.0
    groups = cut(rows.groupBy(*g).agg(F.count("x").alias("n_valid"), F.min("x").alias("low"), F.max("x").alias("high")))
    rows = rows.filter("x is not null")

    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    want = groups.filter("n_valid > 0").select(*g, "n_valid", "low", "high", asked.alias("w")).withColumn("at", (F.col("n_valid") - 1) * F.col("w.p"))
    want = cut(want.select(*g, "w.k", "at", F.floor("at").alias("first"), F.ceil("at").alias("last"), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n_valid").alias("inside")))
    hint = F.broadcast if want.count() <= BROADCAST else lambda d: d  # a row a group and probability

    while want.filter(_wide(most)).limit(1).count():
        moved = cut(_narrow(rows, want, g, most, hint))
        done = not moved.filter("moved").limit(1).count()  # ranges that stay hold few values, repeated: counted by value below
        want = moved.drop("moved")
        if done:
            break

    counted = _inside(rows, want, g, hint).groupBy(*g, "low", "high", "x").agg(F.count("*").alias("n"))
    counted = counted.withColumn("upto", F.sum("n").over(Window.partitionBy(*g, "low", "high").orderBy("x")))
    j = join_null_safe(counted, hint(want), [*g, "low", "high"])
    has = lambda rank: (F.col("upto") > F.col(rank) - F.col("below")) & (F.col("upto") - F.col("n") <= F.col(rank) - F.col("below"))
    q = j.groupBy(*g, "k", "at", "first", "last").agg(F.max(F.when(has("first"), F.col("x"))).alias("a"), F.max(F.when(has("last"), F.col("x"))).alias("b"))
    value = F.when(F.col("first") == F.col("last"), F.col("a")).otherwise((F.col("last") - F.col("at")) * F.col("a") + (F.col("at") - F.col("first")) * F.col("b"))
    lists = q.groupBy(*(g or [F.lit(True)])).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", value.alias("v")))), lambda e: e["v"]).alias("quantiles"))  # len(probs) each
    out = join_null_safe(groups, lists, g, "left")
    return out.select(*[F.col(k).alias(c) for c, k in zip(by or [], g)], "n_valid", "quantiles")


def _wide(most: int) -> Column:
    return (F.col("inside") > most) & (F.col("low") < F.col("high"))


def _inside(rows: DataFrame, ranges: DataFrame, g: list[str], hint) -> DataFrame:
    """(by, low, high, x) of the rows in each different range."""
    return join_null_safe(rows, hint(ranges.select(*g, "low", "high").distinct()), g, where=F.col("x").between(F.col("low"), F.col("high")))


def _narrow(rows: DataFrame, want: DataFrame, g: list[str], most: int, hint) -> DataFrame:
    """``want`` with a narrower range for each rank whose range holds more than ``most`` rows, and whether it moved.

    ``below`` is always the exact number of rows under the range; ``inside`` is exact or too large.
    """
    wide = want.filter(_wide(most))
    inside = _inside(rows, wide, g, hint)
    grid = inside.groupBy(*g, "low", "high").agg(F.percentile_approx("x", [i / GRID for i in range(GRID + 1)], 20 * GRID).alias("grid"))
    place = lambda rank, move: ((F.col(rank) - F.col("below")) / F.col("inside") * GRID).cast("int") + move
    cuts = join_null_safe(wide, grid, [*g, "low", "high"]).select(
        *g, "k", "at", "first", "last", "low", "high", "below", "inside",
        F.get("grid", F.greatest(place("first", -1), F.lit(0))).alias("a"), F.get("grid", F.least(place("last", 2), F.lit(GRID))).alias("b"),
    )
    cuts = cut(cuts)
    pairs = hint(cuts.select(*g, "low", "high", "a", "b").distinct())
    n = join_null_safe(inside, pairs, [*g, "low", "high"]).groupBy(*g, "low", "high", "a", "b").agg(
        F.count_if(F.col("x") < F.col("a")).alias("n_before"), F.count_if(F.col("x").between(F.col("a"), F.col("b"))).alias("n_between")
    )
    c = join_null_safe(cuts, n, [*g, "low", "high", "a", "b"])
    start, end = F.col("below") + F.col("n_before"), F.col("below") + F.col("n_before") + F.col("n_between")
    after_a, before_b = F.col("first") >= start, F.col("last") < end
    # The ranks lie in a..b, from the start to a, from the start to b, from a to the end, or on both sides.
    low = F.when(after_a, F.col("a")).otherwise(F.col("low"))
    high = F.when(F.col("last") < start, F.col("a")).when(before_b, F.col("b")).otherwise(F.col("high"))
    new = c.select(
        *g, "k", "at", "first", "last", low.alias("low"), high.alias("high"), F.when(after_a, start).otherwise(F.col("below")).cast("long").alias("below"),
        F.when(after_a & before_b, F.col("n_between")).otherwise(F.col("inside")).alias("inside"), ((low > F.col("low")) | (high < F.col("high"))).alias("moved"),
    )
    return want.filter(~_wide(most)).withColumn("moved", F.lit(False)).unionByName(new)
