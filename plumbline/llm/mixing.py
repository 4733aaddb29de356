"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: weights times a scale, each at most ``most`` times its source's size, the excess reshared by weight
until none is above (water-filling, in closed form over the sorted ratios of cap to weight). Blocks of
``block`` tokens are then given to sources by highest quotients target / (2 k + 1), and each source's blocks
to its shards the same way by the shards' sizes, so every shard has an integer quota and selects alone:
whole passes over its token stream first, then blocks by a seeded order. Shards are cut by a seeded hash so
that each holds about ``shard_tokens``; a hot source has more shards, none of them larger.

Null text has size 0 and takes nothing; a null source is a source, last in order; ties break by order; an
empty table gives an empty result. Every row is a row of its own, with or without an id: rows that share an id
lie side by side in their shard's stream and each takes its own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size[, _row]): words of the whole text."""
    n = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long")
    return docs.select("doc_id", "source", n.alias("size"), *[c for c in docs.columns if c == "_row"])


def targets(by_source: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, place, target) from (source, source_size): one row a source, so a table of sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = by_source.withColumn("place", F.row_number().over(order)).withColumn("w", F.get(cycle, F.pmod(F.col("place") - 1, F.lit(len(weights)))))
    t = t.withColumn("cap", most * F.col("source_size"))
    # In order of cap / weight: sources before a point are capped, the rest share what is left by weight.
    up = Window.orderBy(F.col("cap") / F.col("w"), "place")
    every = Window.partitionBy(F.lit(1))
    t = t.withColumns(
        {
            "caps": F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)),
            "goal": share * F.sum("source_size").over(every),
        }
    ).withColumn("level", (F.col("goal") - F.col("caps")) / F.col("rest"))
    # The first source whose cap lies above its level fixes the level; if none does, all are capped.
    level = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), "place", "level"))).over(every)
    t = t.withColumn("fixed", level["level"])
    return t.select("source", "source_size", "place", F.least("cap", F.coalesce(F.col("fixed") * F.col("w"), "cap")).alias("target"))


def apportion(rows: DataFrame, group: list[str], votes: str, seats: Column, order: list[str], out: str) -> DataFrame:
    """Sainte-Lague: integer seats by highest quotients votes / (2 k + 1), exactly, without listing every quotient.

    A first divisor gives each row round(votes * seats / total) seats, which is off by less than the
    group's rows in all; the last few are added or taken by the next or the lowest quotient in turn.
    """
    g = Window.partitionBy(*group)
    r = rows.withColumn("_seats", seats).withColumn("_total", F.sum(votes).over(g))
    r = r.withColumn("_d", F.when(F.col("_total") > 0, F.col("_total") / F.greatest(F.col("_seats"), F.lit(1))))
    r = r.withColumn("_base", F.when(F.col(votes) > 0, F.floor(F.col(votes) / F.col("_d") + 0.5)).otherwise(0))
    r = r.withColumn("_gap", F.col("_seats") - F.sum("_base").over(g)).withColumn("_rows", F.count("*").over(g))
    # candidates: each row's nearby quotients; enough of them for any gap, which is at most half the rows
    near = F.sequence(F.greatest(F.lit(0), F.col("_base") - 3), F.col("_base") + 3)
    q = r.filter((F.col(votes) > 0) & (F.col("_gap") != 0)).select(*group, *[c for c in order if c not in group], "_base", "_gap", F.col(votes).alias("_v"), F.explode(near).alias("_k"))
    q = q.withColumn("_q", F.col("_v") / (2 * F.col("_k") + 1)).withColumn("_has", F.col("_k") < F.col("_base"))
    add = Window.partitionBy(*group, "_has").orderBy(F.desc("_q"), *order, "_k")
    take = Window.partitionBy(*group, "_has").orderBy("_q", *[F.desc(c) for c in order], F.desc("_k"))
    q = q.withColumn("_up", F.row_number().over(add)).withColumn("_down", F.row_number().over(take))
    step = F.when(~F.col("_has") & (F.col("_up") <= F.col("_gap")), 1).when(F.col("_has") & (F.col("_down") <= -F.col("_gap")), -1).otherwise(0)
    keys = [*group, *[c for c in order if c not in group]]
    change = q.groupBy(*[F.col(c).alias(f"_on_{c}") for c in keys]).agg(F.sum(step).alias("_step"))
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    got = r.join(change, on, "left")
    return got.select(*rows.columns, (F.col("_base") + F.coalesce("_step", F.lit(0))).cast("long").alias(out))


def mix(
    sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 32,
    shard_tokens: int = 200_000, seed: int = 7,
) -> DataFrame:
    """(_row, doc_id, source, size, source_size, target, taken) from (doc_id, source, size[, _row]).

    ``_row`` numbers the rows, by the caller or here; it only ties rows to their words and orders nothing
    but rows alike in id and size, so reruns agree.
    """
    scratch = Scratch(sized.sparkSession, "mixing")
    own = F.col("_row") if "_row" in sized.columns else F.monotonically_increasing_id().alias("_row")
    sized = scratch.keep(sized.select(own, "doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size")), "sizes")
    plan = scratch.keep(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    goal = plan.withColumn("all_", F.lit(1)).withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy(F.lit(1))) / block))
    seats = apportion(goal, ["all_"], "target", F.col("blocks"), ["place"], "source_blocks")
    seats = seats.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)))
    seats = scratch.keep(seats.select("source", "source_size", "place", "target", "source_blocks", "shards"), "seats")

    # Few sources: a size-checked broadcast; the join carries no text.
    few = seats.count() <= 100_000
    side = seats.withColumnRenamed("source", "_s")
    tagged = sized.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    tagged = tagged.withColumn("mark", mark).withColumn("shard", F.pmod(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long"), F.col("shards")))

    per = tagged.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    quota = scratch.keep(apportion(per, ["place"], "shard_size", F.col("source_blocks"), ["shard"], "quota").select("place", "shard", "shard_size", "quota"), "quota")

    # A shard's stream: its documents in seeded order; each owns the words from its offset on.
    stream = Window.partitionBy("place", "shard").orderBy("mark", "doc_id", "size", "_row")
    placed = tagged.filter("size > 0").withColumn("end", F.sum("size").over(stream)).withColumn("begin", F.col("end") - F.col("size"))
    placed = scratch.keep(placed.join(quota.select("place", "shard", "shard_size", "quota"), ["place", "shard"]).select("_row", "place", "shard", "size", "begin", "end", "shard_size", "quota"), "placed")

    # Whole passes, then as many more full blocks as the quota leaves, chosen in seeded order; the stream's
    # partial last block takes part as the block it is.
    n_blocks = F.ceil(F.col("shard_size") / block)
    passes = F.least(F.floor(F.col("quota") * block / F.col("shard_size")), F.lit(int(most)))
    extra = F.when(passes >= most, 0).otherwise(F.least(n_blocks, F.round((F.col("quota") * block - passes * F.col("shard_size")) / block)))
    shards = quota.filter("shard_size > 0").withColumn("passes", passes).withColumn("extra", extra)
    # Dealt out first: a block's row is made in its shard's task, where the window finds it.
    spread = shards.repartition(int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place", "shard")
    blocks = spread.select("place", "shard", "passes", "extra", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks.cast("long") - 1)).alias("b"))
    pick = Window.partitionBy("place", "shard").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "place", "shard", "b")), "b")
    chosen = scratch.keep(blocks.withColumn("r", F.row_number().over(pick)).filter("r <= extra").select("place", "shard", "b"), "chosen")

    own = placed.select("_row", "place", "shard", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))).alias("b"))
    over = own.join(chosen, ["place", "shard", "b"]).withColumn("w", F.least("end", (F.col("b") + 1) * block) - F.greatest("begin", F.col("b") * block))
    got = over.groupBy("_row").agg(F.sum("w").alias("picked"))
    base = placed.join(shards.select("place", "shard", "passes"), ["place", "shard"]).select("_row", (F.col("passes") * F.col("size")).alias("passed"))
    taken = scratch.keep(base.join(got, "_row", "left").select("_row", (F.col("passed") + F.coalesce("picked", F.lit(0))).cast("long").alias("taken")), "taken")
    return tagged.select("_row", "doc_id", "source", "size", "source_size", "target").join(taken, "_row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """Rows of ``docs`` that the mix takes, with size, source_size, target and taken (columns of these names give way)."""
    scratch = Scratch(docs.sparkSession, "mixed")
    names = ["size", "source_size", "target", "taken"]
    rows = scratch.keep(docs.drop(*names, "_row").withColumn("_row", F.monotonically_increasing_id()), "rows")
    got = mix(sizes(rows), **how).filter("taken > 0").select("_row", *names)
    return rows.join(got, "_row").drop("_row")
