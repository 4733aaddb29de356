"""The reference's operators on the driver's tables: each query with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions import vectors as V
from plumbline.operators import embeddings as E
from plumbline.operators import labels as L
from plumbline.operators import catalog, lineage, pairs, probes, structure, tiles, training
from plumbline.operators.quantiles import exact_quantiles
from plumbline.session import placed, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
R = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, R).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def matrix(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("figure_id"), F.col("label").cast("string").alias("patent_id"), F.lit(0).alias("layer"), F.lit("cls").alias("pooling"), F.col("embedding").alias("vec")
    )


_SAMPLE = "(SELECT * FROM embeddings ORDER BY md5(vec_id || ':42'), vec_id LIMIT 512)"
_UNIT = f"u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) v FROM (SELECT *, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) n FROM {_SAMPLE}))"
_COS = f"{_UNIT}, c AS (SELECT a.vec_id i, b.vec_id j, list_sum(list_transform(range(1, len(a.v) + 1), lambda k: a.v[k] * b.v[k])) cos FROM u a JOIN u b ON a.vec_id < b.vec_id)"
_STATS = "round(avg(cos), 6) cos_mean, round(stddev_pop(cos), 6) cos_std, round(quantile_cont(cos, 0.05), 6) cos_p05, round(quantile_cont(cos, 0.5), 6) cos_p50, round(quantile_cont(cos, 0.95), 6) cos_p95"
_INTEGRITY = """i AS (SELECT max(len(embedding)) emb_dim, sum(len(list_filter(embedding, lambda x: isnan(x))))::BIGINT nan_count, sum(len(list_filter(embedding, lambda x: isinf(x))))::BIGINT inf_count,
 count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0) all_zero_count, count(*) - count(DISTINCT embedding) exact_duplicate_count, count(*) n_figures, count(DISTINCT label) n_patents FROM embeddings)"""
_DIMS = "d AS (SELECT round(avg(v), 6) dim_var_mean, round(min(v), 6) dim_var_min, round(max(v), 6) dim_var_max, count(*) FILTER (v < 1e-8) near_dead_dims FROM (SELECT p, var_pop(x) v FROM (SELECT unnest(embedding)::DOUBLE x, generate_subscripts(embedding, 1) p FROM embeddings) GROUP BY p))"


@query(
    f"WITH {_COS}, {_INTEGRITY}, {_DIMS}, s AS (SELECT {_STATS} FROM c), p AS (SELECT min(n) fig_per_patent_min, median(n) fig_per_patent_median, max(n) fig_per_patent_max FROM (SELECT count(*) n FROM embeddings GROUP BY label)) "
    "SELECT 0::INTEGER AS layer, 'cls' AS pooling, 'hash' AS variant, 24::INTEGER AS n_layers, 64::INTEGER AS hidden_dim, 0::INTEGER AS num_register_tokens, 1::INTEGER AS n_prefix, i.*, p.*, d.*, s.* FROM i, p, d, s"
)
def embedding_qc_report(spark, d):
    """A11-A16 and J8, by matrix."""
    info = {"variant": "hash", "num_hidden_layers": 24, "hidden_dim": 64, "num_register_tokens": 0, "n_prefix": 1}
    return rounded(E.qc_report(matrix(spark, d), info))


@query(f"WITH {_COS} SELECT 0::INTEGER AS layer, 'cls' AS pooling, {_STATS} FROM c")
def pairwise_cosine_stats(spark, d):
    m = matrix(spark, d)
    return rounded(E.cosine_stats(E.pairwise_cosine(E.seeded_sample(m, "figure_id", 512, 42, E.KEYS), "figure_id")))


_ALL = _COS.replace(_SAMPLE, "embeddings")


@query(f"WITH {_ALL} SELECT 0::INTEGER AS layer, 'cls' AS pooling, count(*) AS n_pairs, {_STATS} FROM c")
def all_pairs_cosine(spark, d):
    """J8/A15 over every pair of the whole matrix, by tiles."""
    return rounded(tiles.cosine_summary(matrix(spark, d), "figure_id"))


@query(
    f"WITH {_ALL}, b AS (SELECT i, j, round(cos, 12) cos FROM c UNION ALL SELECT j, i, round(cos, 12) FROM c), r AS (SELECT i, j, cos, row_number() OVER (PARTITION BY i ORDER BY cos DESC, j) rank FROM b) "
    "SELECT i AS figure_id, rank::INTEGER AS rank, j AS neighbour, round(cos, 6) AS cos FROM r WHERE rank <= 5"
)
def nearest_rows(spark, d):
    """V8: the five rows most like each row, by tiles."""
    return rounded(tiles.nearest(matrix(spark, d), "figure_id", 5).select(F.col("id").alias("figure_id"), "rank", "neighbour", "cos"))


_PROBS = [0.0, 0.05, 0.25, 1 / 3, 0.5, 0.95, 0.999, 1.0]


@query(
    f"SELECT source, count(n_chars) AS n_valid, unnest(range({len(_PROBS)}))::INTEGER AS k, round(unnest(quantile_cont(n_chars::DOUBLE, {_PROBS})), 6) AS value FROM documents GROUP BY source"
)
def exact_quantiles_by_source(spark, d):
    """Interpolated quantiles of each group by distributed selection."""
    q = exact_quantiles(table(spark, d, "documents"), "n_chars", _PROBS, ["source"])
    return rounded(q.select("source", "n_valid", F.posexplode("quantiles").alias("k", "value")))


@query(
    "WITH m AS (SELECT label, p, avg(x) m FROM (SELECT label, unnest(embedding)::DOUBLE x, generate_subscripts(embedding, 1) p FROM embeddings) GROUP BY ALL), "
    "n AS (SELECT label, sqrt(sum(m * m)) n FROM m GROUP BY label) SELECT label, (p - 1)::INTEGER AS pos, round(m / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS value FROM m JOIN n USING (label)"
)
def group_vector_mean_normalized(spark, d):
    v = E.vector_mean(table(spark, d, "embeddings").select("label", F.col("embedding").alias("vec")), "label")
    return rounded(v.select("label", F.posexplode("vec").alias("pos", "value")))


@query("SELECT count(*) - count(DISTINCT embedding) AS exact_duplicate_count, 0::BIGINT AS nan_count FROM embeddings")
def exact_duplicate_vectors(spark, d):
    return E.integrity(matrix(spark, d)).select("exact_duplicate_count", "nan_count")


@query("SELECT count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0) = 0 AS passed, 0::BIGINT AS n_bad FROM embeddings")
def qc_gate(spark, d):
    return E.qc_gate(E.integrity(matrix(spark, d)))


@query(f"WITH {_DIMS} SELECT * FROM d")
def dimension_variance(spark, d):
    return rounded(E.dimension_variance(matrix(spark, d)).drop("layer", "pooling"))


@query("SELECT least(floor((sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) - 0) / (20.0 / 60)), 59)::INTEGER AS bin, count(*) AS n FROM embeddings WHERE sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) BETWEEN 0 AND 20 GROUP BY 1")
def norm_histogram(spark, d):
    return E.histogram(matrix(spark, d).select(V.norm(F.col("vec")).alias("x")), "x", 0.0, 20.0)


def orders_eav(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    cells = L.melt(o, ["o_orderstatus", "o_orderpriority"], "Field", "Value")
    return cells.select(F.lit("G1").alias("Section"), F.substring("Field", 1, 7).alias("Sub_Dimension"), "Field", "Value")


@query(
    "SELECT 'G1' AS \"Section\", substr(f, 1, 7) AS \"Sub_Dimension\", f AS \"Field\", count(*) AS n_rows FROM (SELECT unnest(['o_orderstatus', 'o_orderpriority']) f FROM orders) GROUP BY ALL"
)
def eav_triple_counts(spark, d):
    return L.triple_counts(orders_eav(spark, d))


def events_eav(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("Patent_ID"), F.col("event_type").alias("Field"), F.col("value").alias("Value"), F.col("event_id").alias("row_ord"))


def _types(df) -> list[str]:
    return [r[0] for r in df.select("Field").distinct().orderBy("Field").collect()]  # column names: the schema


@query("SELECT user_id AS \"Patent_ID\", event_type AS \"Field\", arg_max(value, event_id) AS \"Value\" FROM events GROUP BY ALL")
def eav_pivot_keep_last(spark, d):
    """A3/W2, melted back so that the result's schema is fixed."""
    e = events_eav(spark, d)
    f = _types(e)
    return _unpivot(L.pivot_keep_last(e, ["Patent_ID"], "Field", "Value", "row_ord", f), f)


@query("SELECT user_id AS \"Patent_ID\", event_type AS \"Field\", arg_min(value, event_id) AS \"Value\" FROM events WHERE value >= 5 GROUP BY ALL")
def eav_pivot_first_non_null(spark, d):
    e = events_eav(spark, d).withColumn("Value", F.when(F.col("Value") >= 5, F.col("Value")))
    f = _types(e)
    return _unpivot(L.pivot_first_non_null(e, ["Patent_ID"], "Field", "Value", "row_ord", f), f)


def _unpivot(wide: DataFrame, fields: list[str]) -> DataFrame:
    return wide.unpivot(["Patent_ID"], fields, "Field", "Value").filter("Value is not null")


@query("WITH m AS (SELECT event_id, user_id, event_type FROM events), c AS (SELECT user_id, event_type, count(*) n FROM m GROUP BY ALL) SELECT sum(n - 1)::BIGINT AS n_surplus FROM c")
def surplus_rows(spark, d):
    return L.surplus_rows(events_eav(spark, d), ["Patent_ID", "Field"])


@query(
    "WITH s AS (SELECT o_orderkey k, 'US' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '_arch' || (o_orderkey % 5) END pid FROM orders) "
    "SELECT k, pid, CASE WHEN k % 3 = 0 THEN pid ELSE 'US' || k END AS base_patent_id, CASE WHEN k % 3 = 0 THEN 1 ELSE k % 5 END::INTEGER AS arch_index FROM s"
)
def arch_id_parse(spark, d):
    k = F.col("o_orderkey")
    s = table(spark, d, "orders").select(k.alias("k"), F.concat(F.lit("US"), k, F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("_arch"), k % 5))).alias("pid"))
    return s.select("k", "pid", X.arch_base(F.col("pid")).alias("base_patent_id"), X.arch_index(F.lit(None).cast("string"), F.col("pid")).alias("arch_index"))


@query(
    "WITH s AS (SELECT p_partkey k, CASE WHEN p_partkey % 7 = 0 THEN 'odd name ' || p_partkey ELSE 'us' || p_partkey || '_' || CASE WHEN p_partkey % 2 = 0 THEN 'shr' ELSE 'OPN' END || '_b64c' || p_size || '_p' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '_c01' END s FROM part) "
    "SELECT k, CASE WHEN k % 7 = 0 THEN s ELSE 'us' || k END AS patent_id, CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'SHR' ELSE 'OPN' END END AS shrouded_open, "
    "CASE WHEN k % 7 <> 0 THEN upper(split_part(s, '_', 3)) END AS cpc, CASE WHEN k % 7 <> 0 THEN split_part(s, '_', 4) || '_c01' END AS figure_type FROM s"
)
def figure_name_parse(spark, d):
    k = F.col("p_partkey")
    s = table(spark, d, "part").select(
        k.alias("k"),
        F.when(k % 7 == 0, F.concat(F.lit("odd name "), k)).otherwise(
            F.concat(F.lit("us"), k, F.lit("_"), F.when(k % 2 == 0, "shr").otherwise("OPN"), F.lit("_b64c"), F.col("p_size"), F.lit("_p"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("_c01"))
        ).alias("s"),
    )
    return s.select("k", *[c.alias(n) for n, c in X.figure_name_fields(F.col("s")).items()])


@query("SELECT l_orderkey, l_linenumber, n_supp, n_supp > 1 AS multi FROM lineitem JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) n_supp FROM lineitem GROUP BY 1) USING (l_orderkey)")
def nunique_transform(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return L.with_distinct_count(li, ["l_orderkey"], "l_suppkey", "n_supp").select("l_orderkey", "l_linenumber", "n_supp", (F.col("n_supp") > 1).alias("multi"))


@query("SELECT l_orderkey, l_suppkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL")
def main_row_selection(spark, d):
    return L.keep_first(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), ["l_orderkey", "l_suppkey"], "l_linenumber")


@query(
    "SELECT o_orderkey, c_name AS assignee, c_mktsegment AS segment, trim(split_part(c_mktsegment || '; other', ';', 1)) AS cpc_first, substr(c_mktsegment, 1, 4) AS cpc_subclass FROM orders LEFT JOIN customer ON o_custkey = c_custkey"
)
def metadata_left_join(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("assignee"), F.col("c_mktsegment").alias("segment"))
    c = L.keep_first(c, ["c_custkey"], "assignee").withColumn("cpc_first", X.first_listed(F.concat("segment", F.lit("; other"))))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return o.join(c, "c_custkey", "left").select("o_orderkey", "assignee", "segment", "cpc_first", F.substring("cpc_first", 1, 4).alias("cpc_subclass"))


@query(
    "WITH m AS (SELECT source, arg_max('new/' || lang, doc_id) dst FROM documents WHERE n_chars % 2 = 0 GROUP BY source) SELECT doc_id, coalesce(dst, source) AS path FROM documents LEFT JOIN m USING (source)"
)
def path_remap_last_wins(spark, d):
    docs = table(spark, d, "documents")
    man = docs.select(F.col("source").alias("src_path"), F.lit(None).cast("string").alias("dst_main"), F.concat(F.lit("new/"), "lang").alias("dst_all"), (F.col("n_chars") % 2 == 0).alias("processed"), F.col("doc_id").alias("row_ord"))
    return L.remap_paths(docs.select("doc_id", F.col("source").alias("path")), man, "path")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS any_uncertain FROM documents")
def uncertain_flag(spark, d):
    return L.uncertain_flag(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").filter("toxic = 1"), "doc_id")


@query("SELECT lang, arg_min(source, doc_id) AS label_source_file FROM documents GROUP BY lang")
def provenance_first(spark, d):
    return L.first_source(table(spark, d, "documents"), "lang", "source", "doc_id")


@query(
    "WITH e AS (SELECT quantile_cont(o_totalprice, 0.0) a, quantile_cont(o_totalprice, 1.0/3) b, quantile_cont(o_totalprice, 2.0/3) c, quantile_cont(o_totalprice, 1.0) z FROM orders) "
    "SELECT CASE WHEN o_totalprice <= b THEN 1 WHEN o_totalprice <= c THEN 2 ELSE 3 END::INTEGER AS bin, count(*) AS n, round(min(b), 3) AS edge1, round(min(c), 3) AS edge2 FROM orders, e GROUP BY 1"
)
def quantile_bins(spark, d):
    o = table(spark, d, "orders")
    one = L.quantile_edges(o, "o_totalprice", 3)
    b = o.join(F.broadcast(one), F.lit(True)).withColumn("bin", L.bin_index(F.col("o_totalprice"), F.col("edges")))  # one row
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.min(F.col("edges")[1]), 3).alias("edge1"), F.round(F.min(F.col("edges")[2]), 3).alias("edge2"))


@query(
    "WITH p AS (SELECT CASE WHEN p_partkey % 3 > 0 THEN p_brand END p_brand, p_type, CASE WHEN p_partkey % 7 > 0 THEN p_size END p_size FROM part), "
    "m AS (SELECT unnest(['p_brand', 'p_type', 'p_size']) attribute, unnest([p_brand, p_type, p_size::VARCHAR]) class FROM p), "
    "s AS (SELECT attribute, round_even(count(*) FILTER (class IS NULL) * 100.0::DOUBLE / count(*), 1) AS null_pct FROM m GROUP BY attribute) "
    "SELECT attribute, class, count(*) AS n, any_value(null_pct) AS null_pct, count(*) < 15 AS below_min FROM m JOIN s USING (attribute) WHERE class IS NOT NULL GROUP BY attribute, class"
)
def coverage_table(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").withColumns({"p_brand": F.when(k % 3 > 0, F.col("p_brand")), "p_size": F.when(k % 7 > 0, F.col("p_size"))})
    return L.coverage_table(p, ["p_brand", "p_type", "p_size"])


@query(
    "SELECT source AS batch, count(DISTINCT doc_id) AS n_reviewed, count(*) FILTER (quality = 1) AS n_approved, count(*) FILTER (quality = 0) AS n_disapproved, count(DISTINCT doc_id) - count(quality) AS n_unresolved "
    "FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"
)
def batch_summary(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    val = F.when(F.col("quality") == 1, "True").when(F.col("quality") == 0, "False")
    return L.batch_summary(j.select(F.col("doc_id").alias("Patent_ID"), F.lit("T1").alias("Section"), F.lit("isApproved").alias("Field"), val.alias("Value"), F.col("source").alias("_source_file")))


@query("SELECT source AS \"_source_file\", lang AS \"Value\", count(*) AS n FROM documents GROUP BY ALL")
def duplicate_type_counts(spark, d):
    docs = table(spark, d, "documents").select(F.lit("duplicateType").alias("Field"), F.col("lang").alias("Value"), F.col("source").alias("_source_file"))
    return L.duplicate_type_counts(docs)


@query(
    "WITH o AS (SELECT o_orderstatus, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END o_orderpriority, o_orderkey FROM orders), "
    "m AS (SELECT unnest(['o_orderstatus', 'o_orderpriority', 'o_orderkey']) col, unnest([o_orderstatus, o_orderpriority, o_orderkey::VARCHAR]) v FROM o), "
    "s AS (SELECT col, round_even(count(*) FILTER (v IS NULL) * 100.0::DOUBLE / count(*), 1) AS null_pct FROM m GROUP BY col), "
    "u AS (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY v) rn FROM (SELECT DISTINCT col, v FROM m WHERE v IS NOT NULL)) "
    "SELECT col AS \"column\", CASE col WHEN 'o_orderkey' THEN 'bigint' ELSE 'string' END AS dtype, any_value(null_pct) AS null_pct, count(*) AS n_unique, string_agg(v, '; ' ORDER BY v) FILTER (rn <= 25) AS observed_values FROM u JOIN s USING (col) GROUP BY col"
)
def column_dictionary(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")))
    return L.column_dictionary(o, ["o_orderstatus", "o_orderpriority", "o_orderkey"])


@query(
    "WITH c AS (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) rn, lang = 'de' no_img, source = 'src1' no_meta FROM documents), "
    "f AS (SELECT 1 k, 'duplicate (base_patent_id, arch_index)' issue, doc_id FROM c WHERE rn > 1 UNION ALL SELECT 2, 'architecture without approved main image', doc_id FROM c WHERE no_img UNION ALL SELECT 3, 'no PatSeer metadata match', doc_id FROM c WHERE no_meta), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) rn FROM f) SELECT issue, count(*)::BIGINT AS n, string_agg(doc_id::VARCHAR, ', ' ORDER BY rn) FILTER (rn <= 10) AS detail FROM r GROUP BY k, issue"
)
def validate_issues(spark, d):
    c = table(spark, d, "documents").select(
        F.col("doc_id").alias("Patent_ID"), F.sha2("text", 256).alias("arch_index"), F.lit(1).alias("x"),
        F.when(F.col("lang") != "de", "p").alias("image_path"), F.when(F.col("source") != "src1", "a").alias("assignee"),
    )
    c = c.withColumn("base_patent_id", F.when(F.col("assignee").isNull(), F.col("Patent_ID").cast("string")).otherwise("b"))
    dup = c.withColumn("base_patent_id", F.when(F.col("assignee").isNull(), F.col("Patent_ID").cast("string")).otherwise(F.col("base_patent_id")))
    both = L.validate_canonical(dup.withColumn("base_patent_id", F.lit("b"))).filter("issue like 'dup%' or issue like 'arch%'")
    return both.unionByName(L.validate_canonical(c).filter("issue like 'no %'"))


@query(
    "WITH t AS (SELECT DISTINCT source s, sha256(text) t FROM documents), h AS (SELECT a.s file_a, b.s file_b, a.t FROM t a JOIN t b ON a.t = b.t AND a.s < b.s), r AS (SELECT *, row_number() OVER (PARTITION BY file_a, file_b ORDER BY t) rn FROM h) "
    "SELECT file_a, file_b, count(*) AS n_shared, string_agg(t, ',' ORDER BY t) FILTER (rn <= 5) AS sample FROM r GROUP BY file_a, file_b"
)
def file_overlap_pairs(spark, d):
    return L.overlap_between_files(table(spark, d, "documents").select("source", F.sha2("text", 256).alias("t")), "source", "t")


def _previous(spark, d) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("t"))
    prev = F.lag("doc_id").over(Window.partitionBy("t").orderBy("doc_id"))
    return docs.select(F.col("doc_id").alias("id")), docs.select(F.col("doc_id").alias("src"), prev.alias("dst")).filter("dst is not null")


_ROOTS = (
    "RECURSIVE e AS (SELECT doc_id src, lag(doc_id) OVER (PARTITION BY text ORDER BY doc_id) dst FROM documents), "
    "w AS (SELECT doc_id id, doc_id cur FROM documents UNION ALL SELECT w.id, e.dst FROM w JOIN e ON e.src = w.cur WHERE e.dst IS NOT NULL), r AS (SELECT id, min(cur) root_id FROM w GROUP BY id)"
)


@query(f"WITH {_ROOTS} SELECT id, root_id FROM r")
def duplicate_roots(spark, d):
    return lineage.duplicate_roots(*_previous(spark, d))


@query(f"WITH {_ROOTS} SELECT doc_id, source FROM documents JOIN r ON id = doc_id AND root_id = id")
def dedupe_to_roots(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return lineage.dedupe_to_roots(docs, lineage.duplicate_roots(*_previous(spark, d)), "doc_id").select("doc_id", "source")


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS n_styles FROM documents GROUP BY lang HAVING count(*) >= 15 AND count(DISTINCT source) >= 2")
def eligible_classes(spark, d):
    return pairs.eligible_classes(table(spark, d, "documents"), "lang", "source", 15)


@query("SELECT a.doc_id AS anchor, min(b.m) AS partner FROM documents a JOIN (SELECT lang, source, min(doc_id) m FROM documents GROUP BY ALL) b ON a.lang = b.lang AND a.source <> b.source GROUP BY a.doc_id")
def positive_pairs(spark, d):
    return pairs.least_partner(table(spark, d, "documents"), "doc_id", "lang", "source")


@query(
    "WITH r AS (SELECT doc_id i, lang c, source s, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42:0'), doc_id) p FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) "
    "SELECT a.i AS anchor, coalesce(arg_min(b.i, b.p) FILTER (b.p > a.p), arg_min(b.i, b.p)) AS partner FROM r a JOIN r b ON a.c = b.c AND a.s <> b.s GROUP BY a.i"
)
def sampled_pairs(spark, d):
    """One seeded partner per anchor."""
    return pairs.sampled_partner(table(spark, d, "documents"), "doc_id", "lang", "source")


@query(
    "WITH s AS (SELECT vec_id // 64 b, vec_id // 2 p, vec_id % 2 k, embedding::DOUBLE[] e FROM embeddings), n AS (SELECT *, greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-12) n FROM s), z AS (SELECT b, p, k, list_transform(e, lambda x: x / n) z FROM n), "
    "s2 AS (SELECT x.b, x.p, x.k, x.p = y.p pos, list_sum(list_transform(range(1, len(x.z) + 1), lambda i: x.z[i] * y.z[i])) / 0.07 s FROM z x JOIN z y ON x.b = y.b AND NOT (x.p = y.p AND x.k = y.k)), "
    "t AS (SELECT b, p, k, max(s) m, max(s) FILTER (pos) sp FROM s2 GROUP BY ALL), l AS (SELECT b, p, k, m + ln(sum(exp(s - m))) - any_value(sp) l FROM s2 JOIN t USING (b, p, k) GROUP BY b, p, k, m) SELECT b AS batch, round(avg(l), 6) AS loss, count(*) AS n_views FROM l GROUP BY b"
)
def nt_xent_loss(spark, d):
    e = table(spark, d, "embeddings")
    half = lambda k: e.filter(F.col("vec_id") % 2 == k).select(F.floor(F.col("vec_id") / 2).alias("p"), F.col("embedding").alias("ab"[k]))
    p = half(0).join(half(1), "p").withColumn("b_id", F.floor(F.col("p") / 32))
    return rounded(pairs.nt_xent(p, "b_id", "a", "b", "p"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 20")
def top_value_counts(spark, d):
    return L.value_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) AS n_covered, count(*) AS n_figures FROM orders")
def semi_join_coverage(spark, d):
    from plumbline.operators.catalog import label_coverage

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return label_coverage(o, table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT doc_id AS id, lang, NULL::INTEGER AS toxic FROM documents UNION ALL SELECT doc_id, NULL, toxic FROM labels")
def union_by_name(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return a.unionByName(table(spark, d, "labels").select(F.col("doc_id").alias("id"), "toxic"), allowMissingColumns=True)


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def id_intersection(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def id_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_rows(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


@query(
    "WITH t AS (SELECT label a, vec_id % 7 b, count(*) n FROM embeddings GROUP BY ALL), r AS (SELECT a, sum(n) na FROM t GROUP BY a), c AS (SELECT b, sum(n) nb, max(n) mx FROM t GROUP BY b), k AS (SELECT sum(n)::DOUBLE nn, sum(n * (n - 1) / 2.0) s FROM t), "
    "q AS (SELECT (SELECT sum(na * (na - 1) / 2.0) FROM r) sa, (SELECT sum(nb * (nb - 1) / 2.0) FROM c) sb, (SELECT sum(mx) FROM c) hit, (SELECT max(na) FROM r) top, (SELECT -sum(na / nn * ln(na / nn)) FROM r, k) ha, (SELECT -sum(nb / nn * ln(nb / nn)) FROM c, k) hb, "
    "(SELECT sum(n / nn * ln(n * nn / (na * nb))) FROM t JOIN r USING (a) JOIN c USING (b), k) mi), x AS (SELECT *, sa * sb / (nn * (nn - 1) / 2) ex, (sa + sb) / 2 me FROM q, k) "
    "SELECT round((s - ex) / (me - ex), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi, round(hit / nn, 6) AS purity, round(top / nn, 6) AS purity_baseline FROM x"
)
def clustering_agreement(spark, d):
    return rounded(structure.agreement(table(spark, d, "embeddings").withColumn("c", F.col("vec_id") % 7), "label", "c"))


_U = "u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / n) v FROM (SELECT *, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) n FROM embeddings))"


@query(
    f"WITH {_U}, c AS (SELECT a.label = b.label same, 1 - list_sum(list_transform(range(1, len(a.v) + 1), lambda k: a.v[k] * b.v[k])) d FROM u a JOIN u b ON a.vec_id < b.vec_id), "
    "r AS (SELECT avg(d) FILTER (same) i, avg(d) FILTER (NOT same) o FROM c) SELECT round(i, 6) AS intra, round(o, 6) AS inter, round(o / i, 6) AS sep_ratio FROM r"
)
def separation_ratio(spark, d):
    return rounded(structure.separation_ratio(table(spark, d, "embeddings"), "label", "embedding"))


@query(
    f"WITH {_U}, c AS (SELECT a.vec_id i, a.label own, b.label g, avg(1 - list_sum(list_transform(range(1, len(a.v) + 1), lambda k: a.v[k] * b.v[k]))) d FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY ALL), "
    "s AS (SELECT i, max(d) FILTER (own = g) a, min(d) FILTER (own <> g) b FROM c GROUP BY i) SELECT i AS vec_id, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s"
)
def cosine_silhouette(spark, d):
    return rounded(structure.cosine_silhouette(table(spark, d, "embeddings"), "vec_id", "label", "embedding"))


_LNC = "lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + lgamma(t - n + 1) - lgamma(h - i + 1) - lgamma(t - n - h + i + 1)"


@query(
    "WITH g AS (SELECT source, count(*) n, sum(quality)::BIGINT k FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL AND quality IS NOT NULL GROUP BY source), "
    "x AS (SELECT source, n, k, t, h, unnest(range(greatest(0, n + h - t)::BIGINT, least(n, h)::BIGINT + 1)) i FROM g, (SELECT sum(n)::BIGINT t, sum(k)::BIGINT h FROM g)), "
    f"l AS (SELECT source, n, k, i, {_LNC} lw FROM x), m AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY source)) p FROM l), o AS (SELECT source, any_value(p) FILTER (i = k) po FROM m GROUP BY source) "
    "SELECT source, any_value(n) AS n, any_value(k) AS k, round(sum(CASE WHEN p <= po * (1 + 1e-7) THEN p ELSE 0 END) / sum(p), 6) AS p_value FROM m JOIN o USING (source) GROUP BY source"
)
def fisher_enrichment(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return rounded(structure.fisher_enrichment(j, "source", "quality"))


@query(
    "WITH c AS (SELECT vec_id r, label g, unnest(embedding)::DOUBLE x, generate_subscripts(embedding, 1) p FROM embeddings), e AS (SELECT g, p, avg(x) c, count(*) n FROM c GROUP BY g, p), a AS (SELECT p, avg(x) m FROM c GROUP BY p), "
    "d AS (SELECT g, r, sum((x - c) ** 2) d2 FROM c JOIN e USING (g, p) GROUP BY g, r), s AS (SELECT g, avg(sqrt(d2)) s, sum(d2) w, count(*) n FROM d GROUP BY g), b AS (SELECT sum(n * (c - m) ** 2) bt FROM e JOIN a USING (p)), "
    "f AS (SELECT u.g i, v.g j, sqrt(sum((u.c - v.c) ** 2)) m FROM e u JOIN e v ON u.p = v.p AND u.g <> v.g GROUP BY ALL), q AS (SELECT i, max((x.s + y.s) / m) r FROM f JOIN s x ON x.g = i JOIN s y ON y.g = j GROUP BY i), t AS (SELECT sum(w) w, sum(n) n, count(*) k FROM s) "
    "SELECT round((bt / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz, (SELECT round(avg(r), 6) FROM q) AS davies_bouldin FROM t, b"
)
def cluster_indices(spark, d):
    return rounded(structure.cluster_indices(table(spark, d, "embeddings"), "label", "embedding"))


@query()
def contrastive_head(spark, d):
    """M4/M5: two epochs of the last block of a head on the frozen vectors, with pairs of one label and another style."""
    rows = table(spark, d, "embeddings").withColumn("style", F.col("vec_id") % 4).select("vec_id", "label", "style", "embedding")
    vec = lambda i, v: rows.select(F.col("vec_id").alias(i), F.col("embedding").alias(v))

    def pairs_of(epoch: int) -> DataFrame:
        return pairs.sampled_partner(rows, "vec_id", "label", "style", 42, epoch).join(vec("anchor", "a"), "anchor").join(vec("partner", "b"), "partner")

    _, history = training.train(spark, pairs_of, training.new_head(64, 2), 2, last_blocks=1, batches_per_step=32)
    return rounded(spark.createDataFrame([(h["epoch"], h["n_batches"], h["avg_loss"]) for h in history], "epoch int, n_batches long, avg_loss double"))


@query()
def pca_variance(spark, d):
    """All components."""
    return rounded(structure.pca_variance(table(spark, d, "embeddings"), "embedding", 64))


@query()
def kmeans_composition(spark, d):
    x = structure.kmeans_best(table(spark, d, "embeddings"), "embedding", 4)
    return rounded(structure.cluster_mix(x, "cluster", "label"))


@query()
def ridge_probe(spark, d):
    return rounded(structure.ridge_probe(table(spark, d, "embeddings"), "label", "embedding"))


@query()
def permutation_separation(spark, d):
    return rounded(probes.permutation_separation(table(spark, d, "embeddings"), "vec_id", "label", "embedding", n_perm=2000))


@query()
def knn_probe(spark, d):
    return rounded(probes.knn_probe(table(spark, d, "embeddings"), "vec_id", "label", "embedding"))


@query()
def logistic_probe(spark, d):
    y = table(spark, d, "embeddings").withColumn("y", (F.col("label") % 2).cast("int"))
    return rounded(probes.logistic_probe(y, "vec_id", "y", "embedding", n_perm=200))


@query()
def ridge_out_of_fold(spark, d):
    return rounded(probes.ridge_cv(table(spark, d, "embeddings"), "vec_id", "label", "embedding"))


@query()
def bootstrap_stability(spark, d):
    return rounded(probes.bootstrap_stability(table(spark, d, "embeddings"), "vec_id", "label", "embedding", k=4))


@query()
def ward_clusters(spark, d):
    return probes.ward_clusters(E.seeded_sample(table(spark, d, "embeddings"), "vec_id", 512, 42), "vec_id", "label", "embedding")


@query()
def first_component_gate(spark, d):
    return rounded(probes.first_component_gate(table(spark, d, "embeddings"), "embedding"))


@query(
    f"WITH {_U}, s AS (SELECT p, sum(x) x FROM (SELECT unnest(v) x, generate_subscripts(v, 1) p FROM u) GROUP BY p), q AS (SELECT sum(list_sum(list_transform(v, lambda x: x * x))) q, count(*) n FROM u) "
    "SELECT round(1 - ((SELECT sum(x * x) FROM s) - q) / (n * (n - 1)), 6) AS real_mean, 1.0::DOUBLE AS random_mean FROM q"
)
def distance_against_random(spark, d):
    """X4; the random matrix's mean distance is 1 within a hundredth."""
    return rounded(probes.distance_against_random(table(spark, d, "embeddings"), "embedding")).withColumn("random_mean", F.round("random_mean", 1))


@query(
    "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings), c AS (SELECT a.vec_id i, a.label own, b.label g, avg(sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda k: (a.v[k] - b.v[k]) ** 2)))) d "
    "FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL), s AS (SELECT i, max(d) FILTER (own = g) a, min(d) FILTER (own <> g) b FROM c GROUP BY i) "
    "SELECT i AS vec_id, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s"
)
def euclidean_silhouette(spark, d):
    return rounded(probes.euclidean_silhouette(table(spark, d, "embeddings"), "vec_id", "label", "embedding"))


@query(
    "WITH e AS (SELECT CASE WHEN label < 3 THEN 0 ELSE label END c, label, count(*) n FROM embeddings GROUP BY ALL), g AS (SELECT c, sum(n)::BIGINT size, max(n) / sum(n) f, arg_max(label, n) l FROM e GROUP BY c) "
    "SELECT c AS cluster, size, round(f, 6) AS dominant_fraction, CASE WHEN f >= 0.8 THEN l::VARCHAR ELSE 'mixed' END AS composition FROM g"
)
def cluster_mix(spark, d):
    c = F.when(F.col("label") < 3, 0).otherwise(F.col("label"))
    return rounded(structure.cluster_mix(table(spark, d, "embeddings").withColumn("c", c), "c", "label"))


_MARK = "md5(vec_id || ':' || p || ':42')"
_DRAW = f"sqrt(-2 * ln((('0x' || substr({_MARK}, 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)) * cos(2 * pi() * (('0x' || substr({_MARK}, 9, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)"


@query(
    f"WITH g AS (SELECT vec_id, p, {_DRAW} x FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) p FROM embeddings)), n AS (SELECT vec_id, sqrt(sum(x * x)) n FROM g GROUP BY vec_id), w AS (SELECT p, x / n v FROM g JOIN n USING (vec_id)), "
    "t AS (SELECT sum(s * s) t FROM (SELECT p, sum(v) s FROM w GROUP BY p)), q AS (SELECT sum(v * v) q FROM w), k AS (SELECT count(*)::DOUBLE k FROM n) SELECT round(1 - (t - q) / (k * (k - 1)), 6) AS random_mean FROM t, q, k"
)
def distance_of_stated_random(spark, d):
    """The random half, of numbers that SQL can state."""
    return rounded(probes.distance_against_random(table(spark, d, "embeddings"), "embedding", idx="vec_id").select("random_mean"))


@query(
    "WITH c AS (SELECT vec_id r, unnest(embedding)::DOUBLE x, generate_subscripts(embedding, 1) p FROM embeddings), a AS (SELECT p, avg(x) m FROM c GROUP BY p), z AS (SELECT r, p, x - m x FROM c JOIN a USING (p)), "
    "v AS (SELECT x.p i, y.p j, avg(x.x * y.x) v FROM z x JOIN z y USING (r) GROUP BY ALL) SELECT (SELECT count(*) FROM a) AS n_components, 1.0::DOUBLE AS total, round(sum(v * v) / sum(v) FILTER (i = j) ** 2, 6) AS squares FROM v"
)
def pca_moments(spark, d):
    """Components, sum and sum of squares of the explained shares: the trace and the square norm of the covariance."""
    shares = structure.pca_variance(table(spark, d, "embeddings"), "embedding", 64)
    return rounded(shares.agg(F.count("*").alias("n_components"), F.sum("explained").alias("total"), F.sum(F.col("explained") ** 2).alias("squares")))


@query(
    f"SELECT 'sep_ratio' AS measure, sep_ratio AS value, '>' AS sign, 1.0::DOUBLE AS \"limit\", sep_ratio > 1.0 AS passed FROM ({ORACLES['separation_ratio']}) "
    f"UNION ALL SELECT 'davies_bouldin', davies_bouldin, '<', 2.0::DOUBLE, davies_bouldin < 2.0 FROM ({ORACLES['cluster_indices']})"
)
def measured_gates(spark, d):
    """X20 over measures of the labelled embeddings."""
    e = table(spark, d, "embeddings")
    sep = structure.separation_ratio(e, "label", "embedding").select(F.lit("sep_ratio").alias("measure"), F.col("sep_ratio").alias("value"))
    spread = structure.cluster_indices(e, "label", "embedding").select(F.lit("davies_bouldin").alias("measure"), F.col("davies_bouldin").alias("value"))
    return rounded(probes.gates(sep.unionByName(spread)))


class LengthEncoder:
    """Stand-in whose tokens SQL can state: content length modulo 97, plus layer, plus token times dimension."""

    info = {"variant": "length", "num_hidden_layers": 2, "hidden_dim": 4, "num_register_tokens": 0, "n_prefix": 1}

    def hidden_states(self, images, layers=None):
        import numpy as np

        size = np.array([len(b) % 97 for b in images], float)[:, None, None]
        grid = np.arange(5)[:, None] * np.arange(4)[None]
        return {k: size + k + grid for k in (range(3) if layers is None else layers)}


@query(
    "WITH s AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) % 97 n FROM documents), l AS (SELECT unnest([1, 2])::INTEGER AS layer), j AS (SELECT unnest(range(0, 4))::INTEGER AS pos) "
    "SELECT doc_id AS row_idx, doc_id::VARCHAR AS figure_id, source AS patent_id, 'main' AS figure_type, layer, p.pooling, pos, round(n + layer + CASE WHEN p.pooling = 'cls' THEN 0 ELSE 2.5 * pos END, 6)::DOUBLE AS value "
    "FROM s, l, j, (SELECT unnest(['cls', 'mean_patch']) AS pooling) p"
)
def encoded_matrix(spark, d):
    """M2, V4, V5, A24 over document texts as content."""
    from plumbline.operators.encode import encode_images

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), F.col("doc_id").cast("string").alias("figure_id"), F.col("source").alias("patent_id"), F.lit("main").alias("figure_type"), F.encode("text", "utf-8").alias("content"))
    m = encode_images(docs, LengthEncoder, [1, 2], ["cls", "mean_patch"])
    return rounded(m.select("row_idx", "figure_id", "patent_id", "figure_type", "layer", "pooling", F.posexplode("vec").alias("pos", "value")).withColumn("value", F.col("value").cast("double")))


def _two_masks(content: bytes) -> list[dict]:
    n = len(content)
    return [{"bbox": [0.0, 0.0, 1.0, float(k)], "area": n // k, "predicted_iou": 0.5, "stability_score": 1.0} for k in (3, 1, 2)]


@query("WITH s AS (SELECT source || '/' || doc_id AS path, octet_length(encode(coalesce(text, ''))) n FROM documents) SELECT path, k::INTEGER AS rank, (n // (k + 1))::BIGINT AS area FROM s, range(0, 3) r(k)")
def mask_images(spark, d):
    """Records by area, largest first."""
    from plumbline.operators.encode import mask_images as masks

    docs = table(spark, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.encode("text", "utf-8").alias("content"))
    return masks(docs, lambda: _two_masks).select("path", F.posexplode("masks").alias("rank", "m")).select("path", "rank", F.col("m.area").alias("area"))


# Fields by turn, with what P1 drops and keeps among them.
_FIELDS = ["dinoUnderstanding", "aQuickOverride", "Notes", "wing_notes", "tail", "Notes2"]


@query(
    f"WITH r AS (SELECT ['G1', 'M1', 'M2', 'M3', 'T1'][doc_id % 5 + 1] s, CASE WHEN doc_id % 7 < 6 THEN {_FIELDS}[doc_id % 7 + 1] END f FROM documents) "
    "SELECT s AS \"Section\", f AS \"Field\", count(*) AS n FROM r WHERE s <> 'T1' AND (f IS NULL OR f IN ('tail', 'Notes2')) GROUP BY ALL"
)
def design_rows(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        F.get(F.array(*map(F.lit, ["G1", "M1", "M2", "M3", "T1"])), (k % 5).cast("int")).alias("Section"), F.get(F.array(*map(F.lit, _FIELDS)), (k % 7).cast("int")).alias("Field")
    )
    return L.design_rows(rows).groupBy("Section", "Field").agg(F.count("*").alias("n"))


def image_rows(spark, d) -> DataFrame:
    """T2 rows from line items: values that are true, approved and neither, some with blanks around them.

    Line items may share order, part and number; of these the first in the file is the first row.
    """
    li, n = placed(table(spark, d, "lineitem"), "place"), F.col("l_linenumber")
    fields = {
        "isMain": F.when(n % 3 == 0, "Main").when(n % 3 == 1, F.when(F.col("l_partkey") % 2 == 0, "TRUE").otherwise(" true")).otherwise("no"),
        "status": F.when(F.col("l_returnflag") == "N", "Approved").when(F.col("l_returnflag") == "A", " approved").otherwise(F.lit(None).cast("string")),
        "per": F.col("l_linestatus"),
    }
    pid = F.concat(F.lit("US"), "l_orderkey", F.when(n % 2 == 0, "_arch2").otherwise(""))
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("Field"), v.alias("Value")) for k, v in fields.items()])).alias("c")
    return li.select(pid.alias("Patent_ID"), F.lit("T2").alias("Section"), F.concat(F.lit("img/"), "l_partkey").alias("Image_Path"), (n.cast("long") * (1 << 56) + F.col("place")).alias("row_ord"), cells).select("*", "c.*").drop("c")


_T2 = (
    "t AS (SELECT 'US' || l_orderkey || CASE WHEN l_linenumber % 2 = 0 THEN '_arch2' ELSE '' END pid, 'US' || l_orderkey base, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END::INTEGER arch, 'img/' || l_partkey path, l_linenumber o, "
    "CASE l_linenumber % 3 WHEN 0 THEN 'Main' WHEN 1 THEN CASE WHEN l_partkey % 2 = 0 THEN 'TRUE' ELSE ' true' END ELSE 'no' END m, CASE l_returnflag WHEN 'N' THEN 'Approved' WHEN 'A' THEN ' approved' END s, l_linestatus v, l_partkey k FROM lineitem), "
    "i AS (SELECT pid, base, arch, path, any_value(k) % 5 <> 0 AS image_exists, coalesce(lower(arg_min(m, o)) IN ('true', '1', 'yes', 'main'), false) AS is_main, coalesce(lower(arg_min(s, o)) = 'approved', false) AS approved, arg_min(v, o) AS per FROM t GROUP BY pid, base, arch, path)"
)


def _images(spark, d) -> DataFrame:
    there = table(spark, d, "lineitem").filter("l_partkey % 5 <> 0").select(F.concat(F.lit("img/"), "l_partkey").alias("path"))
    return L.image_table(image_rows(spark, d), there)


@query(f'WITH {_T2} SELECT pid AS "Patent_ID", path AS "Image_Path", base AS base_patent_id, arch AS arch_index, is_main, approved, image_exists FROM i')
def image_table(spark, d):
    return _images(spark, d).select("Patent_ID", "Image_Path", "base_patent_id", "arch_index", "is_main", "approved", "image_exists")


@query(f"WITH {_T2} SELECT base AS base_patent_id, arch AS arch_index, min(path) AS image_path, arg_min(per, path) AS perspective FROM i WHERE is_main AND approved AND image_exists GROUP BY ALL")
def main_images(spark, d):
    return L.select_main_images(_images(spark, d))


@query(f"WITH {_T2} SELECT count(*) AS n_images, count(*) FILTER (is_main AND approved) AS n_main, count(*) FILTER (is_main AND approved AND NOT image_exists) AS n_main_missing FROM i")
def image_counts(spark, d):
    return L.image_counts(_images(spark, d))


def _canonical(spark, d) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    pid = F.concat(F.lit("US"), k, F.when(k % 3 == 0, "_arch2").otherwise(""))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("Field"), F.col(c).alias("Value")) for f, c in (("state", "o_orderstatus"), ("prio", "o_orderpriority"))], F.when(k % 11 == 0, F.struct(F.lit("aHumanUncertain").alias("Field"), F.lit("Yes").alias("Value"))))).alias("c")
    design = o.select(pid.alias("Patent_ID"), F.lit("G1").alias("Section"), F.lit(None).cast("string").alias("Image_Path"), F.col("o_custkey").cast("long").alias("row_ord"), F.concat(F.lit("f"), k % 4).alias("_source_file"), cells)
    design = design.filter("c is not null").select("*", "c.*").drop("c")
    long = L.pool_long([design, image_rows(spark, d).withColumn("_source_file", F.lit("z"))])
    meta = o.filter(k % 4 != 0).select(F.concat(F.lit("US"), k).alias("Record Number"), F.concat(F.lit("c"), "o_custkey").alias("Assignee"), F.year("o_orderdate").cast("string").alias("Priority Year"), k.alias("row_ord"))
    there = table(spark, d, "lineitem").filter("l_partkey % 5 <> 0").select(F.concat(F.lit("img/"), "l_partkey").alias("path"))
    return L.build_canonical(long, meta, existing_paths=there, ingest_date="2026-01-01")[0]


_CANON = (
    f"{_T2}, m AS (SELECT base, arch, min(path) image_path FROM i WHERE is_main AND approved AND image_exists GROUP BY ALL), "
    "c AS (SELECT 'US' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '_arch2' ELSE '' END pid, 'US' || o_orderkey base_patent_id, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END::INTEGER arch_index, o_orderstatus st, o_orderpriority pr, o_orderkey % 11 = 0 any_uncertain, "
    "CASE WHEN o_orderkey % 4 <> 0 THEN 'c' || o_custkey END assignee FROM orders), "
    "r AS (SELECT c.*, image_path FROM c LEFT JOIN m ON base = base_patent_id AND arch = arch_index)"
)


@query(
    f"WITH {_CANON} SELECT pid AS \"Patent_ID\", base_patent_id, arch_index, 1::INTEGER AS n_architectures, st AS \"G1_state\", pr AS \"G1_prio\", assignee, any_uncertain, image_path FROM r"
)
def canonical_table(spark, d):
    """Entry A in whole: P1, J1, J2, J5, P8, W1 to W4."""
    return _canonical(spark, d).select("Patent_ID", "base_patent_id", "arch_index", "n_architectures", "G1_state", "G1_prio", "assignee", "any_uncertain", "image_path")


@query(
    f"WITH {_CANON} SELECT count(*) AS n_rows, count(DISTINCT base_patent_id) AS n_patents, count(*) FILTER (assignee IS NULL) AS n_unmatched, count(image_path) AS n_with_image, count(*) FILTER (any_uncertain) AS n_uncertain, 0::BIGINT AS n_multi_arch FROM r"
)
def metadata_counts(spark, d):
    return L.metadata_counts(_canonical(spark, d))


def _architectures(spark, d) -> DataFrame:
    """Orders as label rows of one to three architectures a customer, with fields that the data decide."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    suffix = F.element_at(F.array(F.lit(""), F.lit("_arch2"), F.lit("_arch3")), (k % 3 + 1).cast("int"))
    return L.build_wide(o.select(
        F.concat(F.lit("US"), "o_custkey", F.when(F.col("o_custkey") % 2 == 0, suffix).otherwise("")).alias("Patent_ID"), F.lit("G1").alias("Section"),
        F.concat(F.lit("f"), (k % 5).cast("string")).alias("Field"), F.col("o_orderstatus").alias("Value"), k.alias("row_ord"),
    ))


_ARCHS = (
    "a AS (SELECT 'US' || o_custkey base, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey % 3 ELSE 0 END + 1 arch, o_orderkey % 5 f, o_orderstatus v, o_orderkey k FROM orders), "
    "w AS (SELECT base, arch, arg_max(v, k) FILTER (f = 0) f0, arg_max(v, k) FILTER (f = 4) f4 FROM a GROUP BY ALL)"
)


@query(
    f"WITH {_ARCHS} SELECT base || CASE WHEN arch > 1 THEN '_arch' || arch ELSE '' END AS \"Patent_ID\", base AS base_patent_id, arch::INTEGER AS arch_index, (count(*) OVER (PARTITION BY base))::INTEGER AS n_architectures, count(*) OVER (PARTITION BY base) > 1 AS multi_arch, f0 AS \"G1_f0\", f4 AS \"G1_f4\" FROM w"
)
def architectures(spark, d):
    """A3, A4, F2: wide rows of patents with several architectures."""
    return _architectures(spark, d).select("Patent_ID", "base_patent_id", "arch_index", "n_architectures", "multi_arch", "G1_f0", "G1_f4")


@query("SELECT DISTINCT 'G1_f' || (o_orderkey % 5) AS attribute FROM orders")
def attributes_of_wide(spark, d):
    """P14 over the columns that a pivot has found."""
    return spark.createDataFrame([(c,) for c in L.attribute_columns(_architectures(spark, d))], "attribute string")


@query("SELECT unnest(['wing', 'G1_tail', 'Section']) AS attribute")
def attribute_columns(spark, d):
    """What isn't bookkeeping."""
    one = table(spark, d, "region").select(*[F.lit(1).alias(c) for c in ("Patent_ID", "wing", "arch_index", "G1_tail", "year_bin", "Section", "perspective", "ingest_date")])
    return spark.createDataFrame([(c,) for c in L.attribute_columns(one)], "attribute string")


@query(
    "WITH e AS (SELECT lang FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND doc_id % 3 > 0 GROUP BY lang HAVING count(*) >= 2 AND count(DISTINCT source) >= 2) "
    "SELECT doc_id::VARCHAR AS patent_id, 'x/' || doc_id || '.png' AS path, doc_id || '.png' AS figure_id, lang, source AS style_key, 'main' AS figure_type FROM documents JOIN e USING (lang) WHERE source IS NOT NULL AND doc_id % 3 > 0"
)
def pair_table(spark, d):
    """P13, F7, A9, J12."""
    k = F.col("doc_id")
    canon = table(spark, d, "documents").select(k.cast("string").alias("base_patent_id"), F.lit(1).alias("arch_index"), F.when(k % 3 > 0, F.concat(F.lit("x/"), k, F.lit(".png"))).alias("image_path"), "lang", "source")
    return pairs.pair_table(canon, "lang", ["source"]).select("patent_id", "path", "figure_id", "lang", "style_key", "figure_type")


@query("SELECT (user_id % 10)::INTEGER AS epoch, round(avg(value), 6) AS avg_loss FROM events GROUP BY 1")
def epoch_loss(spark, d):
    return rounded(pairs.epoch_loss(table(spark, d, "events").select((F.col("user_id") % 10).cast("int").alias("epoch"), F.col("value").alias("loss"))))


def _paths(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 7 == 0, F.concat(F.lit("odd "), k)).otherwise(F.concat(F.lit("us"), k, F.lit("_"), F.when(k % 2 == 0, "shr").otherwise("OPN"), F.lit("_b64c"), F.col("p_size"), F.lit("_p"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("_c01")))
    return table(spark, d, "part").select(F.concat(F.lit("a/b/"), name, F.when(k % 5 == 0, ".TXT").otherwise(".Png")).alias("path"))


_FIGURES = (
    "n AS (SELECT p_partkey k, CASE WHEN p_partkey % 7 = 0 THEN 'odd ' || p_partkey ELSE 'us' || p_partkey || '_' || CASE WHEN p_partkey % 2 = 0 THEN 'shr' ELSE 'OPN' END || '_b64c' || p_size || '_p' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '_c01' END s FROM part WHERE p_partkey % 5 <> 0), "
    "f AS (SELECT s || '.Png' AS figure_id, CASE WHEN k % 7 = 0 THEN s ELSE 'us' || k END AS patent_id, CASE WHEN k % 7 > 0 THEN CASE WHEN k % 2 = 0 THEN 'SHR' ELSE 'OPN' END END AS shrouded_open, "
    "CASE WHEN k % 7 > 0 THEN upper(split_part(s, '_', 3)) END AS cpc, CASE WHEN k % 7 > 0 THEN split_part(s, '_', 4) || '_c01' END AS figure_type, 'a/b/' || s || '.Png' AS path FROM n)"
)


@query(f"WITH {_FIGURES} SELECT *, CASE shrouded_open WHEN 'SHR' THEN 1 WHEN 'OPN' THEN 0 END::INTEGER AS y FROM f")
def figures_by_name(spark, d):
    """T5 with X1's labels: figure_id is the file's name, with its suffix."""
    return probes.binary_labels(catalog.figures_by_name(_paths(spark, d)))


@query(f"WITH {_FIGURES} SELECT count(*) AS n_figures, count(DISTINCT patent_id) AS n_patents, count(*) FILTER (shrouded_open IS NULL) AS n_unparsed FROM f")
def catalogue_counts(spark, d):
    return catalog.catalogue_counts(catalog.figures_by_name(_paths(spark, d)))


def _manifest(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.concat(F.lit("raw/"), k).alias("src_path"), F.when(k % 2 == 0, F.concat(F.lit("m/"), k, F.lit(".png"))).alias("dst_main"), F.concat(F.lit("all/"), k, F.lit(".png")).alias("dst_all"),
        F.when(k % 5 > 0, k % 3 > 0).alias("processed"), F.concat(F.lit("US"), "o_custkey").alias("base_patent_id"), F.when(k % 4 > 0, k % 4 == 1).alias("is_main"), F.col("o_orderstatus").alias("bg_sty"),
    )


@query(
    "SELECT o_orderkey || '.png' AS figure_id, 'US' || o_custkey AS patent_id, CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'main' ELSE 'other' END AS figure_type, 'm/' || o_orderkey || '.png' AS path, o_orderkey % 4 IN (0, 1) AS is_main, o_orderstatus AS bg_sty "
    "FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 > 0 AND o_orderkey % 3 > 0"
)
def figures_by_manifest(spark, d):
    return catalog.figures_by_manifest(_manifest(spark, d), "main").select("figure_id", "patent_id", "figure_type", "path", "is_main", "bg_sty")


@query(
    "WITH f AS (SELECT 'US' || o_custkey p, o_orderkey % 7 > 0 AS there FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 3 > 0) "
    "SELECT count(*) FILTER (NOT there) AS n_dropped_figures, count(DISTINCT p) - count(DISTINCT p) FILTER (there) AS n_dropped_patents FROM f"
)
def missing_files(spark, d):
    """Figures whose file is absent leave with a count."""
    m = _manifest(spark, d)
    there = m.filter(F.substring("src_path", 5, 20).cast("long") % 7 > 0).select(F.col("dst_all").alias("path"))
    return catalog.dropped(catalog.figures_by_manifest(m), catalog.figures_by_manifest(m, existing_paths=there))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders")
def row_index(spark, d):
    """J15's numbering: no gaps, whatever the partitions."""
    return catalog.with_row_index(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "SELECT o_orderkey AS patent_id, year(o_orderdate)::INTEGER AS filing_year, CASE WHEN o_orderkey % 4 > 0 THEN regexp_matches('c' || o_custkey, '[37]$')::INTEGER END AS is_bell FROM orders WHERE o_orderkey % 4 > 0 "
    "UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 4 = 0"
)
def derived_confounds(spark, d):
    return _confounds(spark, d).select("patent_id", "filing_year", "is_bell")


def _confounds(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    facts = o.filter("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("patent_id"), F.col("o_orderdate").alias("priority_date"), F.concat(F.lit("c"), "o_custkey").alias("assignee"))
    return probes.derive_confounds(o.select(F.col("o_orderkey").alias("patent_id"), F.col("o_orderstatus").alias("status")), facts, pattern="[37]$")


@query(
    "WITH c AS (SELECT o_orderstatus AS label, year(o_orderdate)::DOUBLE y, regexp_matches('c' || o_custkey, '[37]$')::INTEGER::DOUBLE b, o_orderkey % 4 > 0 k FROM orders), l AS (SELECT label, unnest(['filing_year', 'is_bell']) AS confound, unnest([CASE WHEN k THEN y END, CASE WHEN k THEN b END]) v FROM c) "
    "SELECT confound, label, count(v) AS n, round(avg(v), 6) AS mean FROM l GROUP BY ALL"
)
def confound_presence(spark, d):
    return rounded(probes.confound_presence(_confounds(spark, d), "status", ["filing_year", "is_bell"]))


@query("SELECT o_orderstatus, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY o_orderstatus")
def best_rows(spark, d):
    return probes.best_row(table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], ["o_orderstatus"])


@query(
    "WITH m AS (SELECT unnest(['silhouette', 'davies_bouldin', 'pc1_ratio', 'dominant_share', 'p_sep', 'probe_auc']) AS measure, unnest([0.15, 1.9, 3.0, 0.91, 0.04, NULL])::DOUBLE AS value) "
    "SELECT measure, value, CASE measure WHEN 'davies_bouldin' THEN '<' WHEN 'p_sep' THEN '<' WHEN 'pc1_ratio' THEN '>=' WHEN 'dominant_share' THEN '<=' ELSE '>' END AS sign, CASE measure WHEN 'silhouette' THEN 0.15 WHEN 'davies_bouldin' THEN 2.0 WHEN 'pc1_ratio' THEN 3.0 WHEN 'dominant_share' THEN 0.9 WHEN 'p_sep' THEN 0.05 ELSE 0.65 END::DOUBLE AS \"limit\", measure IN ('davies_bouldin', 'pc1_ratio', 'p_sep') AS passed FROM m"
)
def verdict_gates(spark, d):
    """X20."""
    rows = [("silhouette", 0.15), ("davies_bouldin", 1.9), ("pc1_ratio", 3.0), ("dominant_share", 0.91), ("p_sep", 0.04), ("probe_auc", None)]
    return probes.gates(spark.createDataFrame(rows, "measure string, value double"))
