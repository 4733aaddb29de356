"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly. DataFrame functions only.

Texts are lower-cased, cut into letter and digit runs, and read as sets of ``shingle``-word shingles (fewer
words: the whole sequence, found only in a document of just these words). Items are partitioned by size, in
powers of two. Within a partition every item is sketched by its ``k`` least shingle hashes, k being the most
that any size u of the partition needs: ``u - ceil(threshold * u) + 1``. MinHash order makes them a uniform
sample of the item, and with that many of them a document that contains the threshold share of the item holds
at least one, whatever its own length: short items are found inside documents of any size and none is missed.
Least hashes are small, the more so in partitions of long items, so document shingles above a partition's
greatest sketched hash meet no item of it and are dropped before the join. Candidates are verified by the
exact share of the item's shingles in the document.

Texts are addressed by content, so rows may have no id or share one: every row is judged by its own text, and
a row (doc_id, item_id) appears once for each distinct text. Null or wordless items and texts match nothing;
repeated items are found under each item_id, and an item_id with several texts by each of them; an item that a
third of the documents hold costs a row per document and item; empty tables give an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_IDS, Scratch, only


def with_shingles(df: DataFrame, k: int) -> DataFrame:
    """Replaces ``text`` by ``s``, the 64-bit hashes of its k-word shingles, repeats included.

    Words are hashed once each, then k hashes at a time. Each step is a projection of its own, so that no
    expression is evaluated twice; callers use the outer explode, for which the optimizer infers no filter
    that would carry the whole expression below these steps.
    """
    rest = [c for c in df.columns if c != "text"]
    w = df.select(*rest, F.split(F.lower("text"), r"[^\p{L}\p{N}]+").alias("w"))
    w = w.select(*rest, F.filter("w", lambda x: x != "").alias("w"))
    h = w.select(*rest, F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    n = F.size("h")
    rolled = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(F.col("h"), i + j) for j in range(k)]))
    return h.select(*rest, F.when(n >= k, rolled).when(n > 0, F.array(F.xxhash64("h"))).otherwise(F.array().cast("array<bigint>")).alias("s"))


def partitioned(items: DataFrame, k: int, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(items as (item, item_id, n, size_class, s), sketches as (size_class, item, h)), both in the shared folder.

    ``item`` tells repeated ids with different texts apart. ``s`` is sorted, so the sketch is its head.
    """
    s = with_shingles(items.select("item_id", "text", F.md5("text").alias("item")), k).select("item", "item_id", F.array_sort(F.array_distinct("s")).alias("s"))
    s = s.withColumn("n", F.size("s")).filter("n > 0").distinct()
    index = scratch.keep(s.withColumn("size_class", F.floor(F.log2("n")).cast("int")), "items")
    need = F.col("n") - F.ceil(F.col("n") * threshold) + 1
    lengths = index.groupBy("size_class").agg(F.max(need).cast("int").alias("k"))  # one row a partition
    sketch = index.join(F.broadcast(lengths), "size_class").select("size_class", "item", F.explode(F.slice("s", 1, F.col("k"))).alias("h")).distinct()
    return index, scratch.keep(sketch, "sketches")


def candidates(docs: DataFrame, index: DataFrame, sketch: DataFrame, shingle: int) -> DataFrame:
    """(blob, item): document texts that share a sketched hash with an item."""
    bounds = [r.top for r in sketch.groupBy("size_class").agg(F.max("h").alias("top")).collect()]  # one row a partition
    probe = with_shingles(docs, shingle).select("blob", F.explode_outer(F.filter("s", lambda h: h <= F.lit(max(bounds, default=0)))).alias("h"))
    few = sketch.count() <= BROADCAST_IDS
    slim = sketch.select("h", "item")
    return probe.join(F.broadcast(slim) if few else slim, "h").select("blob", "item").distinct()


def verified(docs: DataFrame, items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(doc_id, blob, item_id, n_shingles, n_shared, containment) of every row of docs(doc_id, text) and item at or over ``threshold``."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    index, sketch = partitioned(items, shingle, threshold, scratch)
    rows = docs.select("doc_id", "text", F.md5("text").alias("blob"))
    pairs, seen = scratch.keep_with(candidates(rows, index, sketch, shingle), "candidates", F.count("*").alias("n"))
    again = only(rows, pairs, "blob", seen["n"])
    sets = with_shingles(again, shingle).select("doc_id", "blob", F.array_distinct("s").alias("s"))
    few = seen["n"] <= BROADCAST_IDS
    body = index.select("item", "item_id", F.col("n").alias("n_shingles"), F.col("s").alias("body"))
    held = sets.join(F.broadcast(pairs) if few else pairs, "blob").join(body, "item")
    shared = held.select("doc_id", "blob", "item_id", "n_shingles", F.size(F.array_intersect("s", "body")).cast("long").alias("n_shared"))
    return shared.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= threshold)


def containment(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every pair at or over ``threshold``.

    ``docs(doc_id, text)``, ``items(item_id, text)``. Sketches and candidates are broadcast while their counted
    number is bounded; beyond it the same joins are shuffled by hash. Only candidate documents are read again.
    """
    return verified(docs, items, shingle, threshold).distinct().drop("blob")


def decontaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows of ``docs`` whose text holds no item, all columns kept; rows without a text stay."""
    scratch = Scratch(docs.sparkSession, "decontaminated")
    found = verified(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), items, shingle, threshold).select("blob").distinct()
    blobs, seen = scratch.keep_with(found.withColumnRenamed("blob", "_blob"), "blobs", F.count("*").alias("n"))
    keyed = docs.withColumn("_blob", F.md5("text"))
    return keyed.join(F.broadcast(blobs) if seen["n"] <= BROADCAST_IDS else blobs, "_blob", "left_anti").select(*docs.columns)
