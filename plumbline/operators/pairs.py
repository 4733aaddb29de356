"""Class-matched, style-contrasting pairs and the NT-Xent loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.functions.text import basename
from plumbline.schemas import require_columns


#: Hexadecimal digits of the seeded order that cut a class into parts: at most 4,096 of them.
PART_DIGITS = 3


def eligible_classes(df: DataFrame, cls: str, style: str, min_count: int = 2) -> DataFrame:
    """Classes with enough rows and at least two styles."""
    g = df.filter(F.col(cls).isNotNull()).groupBy(cls).agg(F.count("*").alias("n"), F.count_distinct(style).alias("n_styles"))
    return g.filter((F.col("n") >= min_count) & (F.col("n_styles") >= 2))


def pair_table(canon: DataFrame, class_col: str, style_cols: list[str], min_count: int = 2, existing_paths: DataFrame | None = None) -> DataFrame:
    """P13, F7, A9, J12 over the canonical table."""
    require_columns(canon, ["base_patent_id", "arch_index", "image_path", class_col, *style_cols], "canonical table")
    df = canon.select("base_patent_id", "arch_index", F.col("image_path").alias("path"), class_col, *[c for c in style_cols if c != class_col])
    df = df.dropna(subset=["path", class_col, *style_cols])
    if existing_paths is not None:
        df = df.join(existing_paths.select("path").distinct(), "path", "left_semi")
    df = df.withColumn("style_key", F.concat_ws("|", *style_cols))
    df = df.join(eligible_classes(df, class_col, "style_key", min_count), class_col, "left_semi")
    return df.withColumns({"figure_id": basename(F.col("path")), "patent_id": F.col("base_patent_id"), "figure_type": F.lit("main")})


def least_partner(df: DataFrame, idx: str, cls: str, style: str) -> DataFrame:
    """For each row the smallest id of its class with another style; rows without one are absent.

    Per class only the best id of each style matters, and of those only the best two: the answer is the
    first unless it has the row's own style. So nothing is paired and no class is quadratic.
    """
    per = df.filter(F.col(cls).isNotNull() & F.col(style).isNotNull()).groupBy(cls, style).agg(F.min(idx).alias("m"))
    best = per.withColumn("r", F.row_number().over(Window.partitionBy(cls).orderBy("m"))).filter("r <= 2")
    two = best.groupBy(cls).agg(F.min_by("m", "r").alias("m1"), F.min_by(style, "r").alias("s1"), F.max_by(F.when(F.col("r") == 2, F.col("m")), "r").alias("m2"))
    got = df.join(two, cls).withColumn("partner", F.when(F.col(style) != F.col("s1"), F.col("m1")).otherwise(F.col("m2")))
    return got.filter("partner is not null").select(F.col(idx).alias("anchor"), "partner")


def sampled_partner(df: DataFrame, idx: str, cls: str, style: str, seed: int = 42, epoch: int = 0) -> DataFrame:
    """A seeded random partner of the same class and another style, another for each epoch.

    Rows of a class are laid on a ring in seeded order; the partner is the next row of another style, that is the
    head of the run after the row's own. The order is a hash, so its first digits cut a class into parts of even
    size, and a task sorts a part. A part's last run looks on among a few rows that stand for the parts: of each the
    first, the first of another style than that, and the last.
    """
    h = F.md5(F.concat_ws(":", F.col(idx).cast("string"), F.lit(str(seed)), F.lit(str(epoch))))
    rows = df.filter(F.col(cls).isNotNull() & F.col(style).isNotNull()).select(F.col(idx).alias("i"), F.col(cls).alias("c"), F.col(style).alias("s"), h.alias("h"))
    rows = rows.withColumn("part", F.substring("h", 1, PART_DIGITS))
    runs = _next_head(rows, ["c", "part"], ["h", "i"])
    at = F.struct("h", "i", "s")
    own = runs.groupBy("c", "part").agg(F.min(at).alias("a"), F.min_by("nx", F.when(F.col("nx").isNotNull(), F.struct("h", "i"))).alias("b"), F.max(at).alias("z"))
    stand = own.select("c", "part", F.posexplode(F.array(F.struct("a.i", "a.s"), "b", F.struct("z.i", "z.s"))).alias("place", "e")).filter("e is not null")
    stand = stand.select("c", "part", "place", "e.i", "e.s")
    ahead = _next_head(stand, ["c"], ["part", "place"]).filter("place = 2").select("c", "part", F.col("nx.i").alias("on"))
    first = stand.groupBy("c").agg(F.min_by(F.struct("i", "s"), F.struct("part", "place")).alias("f"))
    other = stand.join(first, "c").filter("s <> f.s").groupBy("c", "f").agg(F.min_by("i", F.struct("part", "place")).alias("i1"))
    wrap = F.when(F.col("s") != F.col("f.s"), F.col("f.i")).otherwise(F.col("i1"))
    return runs.join(ahead, ["c", "part"]).join(other, "c").select(F.col("i").alias("anchor"), F.coalesce("nx.i", "on", wrap).alias("partner"))


def _next_head(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``nx``, the (i, s) of the next row of another style ``s`` in its group, or null: one pass from the group's end."""
    back = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
    n = rows.withColumn("n", F.lag(F.struct("i", "s")).over(back))
    head = F.when(F.col("n.s") != F.col("s"), F.col("n"))
    return n.withColumn("nx", F.last(head, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))).drop("n")


def nt_xent(pairs: DataFrame, batch: str, a: str, b: str, pair_id: str, temperature: float = 0.07) -> DataFrame:
    """Loss of each batch. All views of a batch but itself are candidates; the other view is the target.

    Batches are bounded by the batch size, so the join stays within a batch key.
    """
    side = lambda c, k: pairs.select(F.col(batch).alias("batch"), F.col(pair_id).alias("p"), F.lit(k).alias("k"), V.l2_floor(F.col(c)).alias("z"))
    z = side(a, 0).unionByName(side(b, 1))
    x, y = z.alias("x"), z.alias("y")
    other = ~((F.col("x.p") == F.col("y.p")) & (F.col("x.k") == F.col("y.k")))
    sim = x.join(y, (F.col("x.batch") == F.col("y.batch")) & other).select(
        F.col("x.batch").alias("batch"), F.col("x.p").alias("p"), F.col("x.k").alias("k"), (F.col("x.p") == F.col("y.p")).alias("pos"),
        (V.dot(F.col("x.z"), F.col("y.z")) / temperature).alias("s"),
    )
    top = sim.groupBy("batch", "p", "k").agg(F.max("s").alias("m"), F.collect_list("s").alias("all"), F.max(F.when(F.col("pos"), F.col("s"))).alias("sp"))
    lse: Column = F.col("m") + F.log(F.aggregate("all", F.lit(0.0), lambda t, s: t + F.exp(s - F.col("m"))))
    return top.select("batch", (lse - F.col("sp")).alias("l")).groupBy("batch").agg(F.avg("l").alias("loss"), F.count("*").alias("n_views"))


def epoch_loss(history: DataFrame) -> DataFrame:
    """Mean loss per epoch; no batch gives no row."""
    return history.groupBy("epoch").agg(F.avg("loss").alias("avg_loss"))
