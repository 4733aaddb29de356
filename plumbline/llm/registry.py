"""The thin queries of this subpackage, one per operator, and the SQL for those that SQL can express."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, fim, langid, media, minhash, mixing, ngram, oracles, pii, secrets, simhash, suffixdup, toxicity, whitening
from plumbline.llm.common import Scratch, read, remainder

#: For trying the query out where PLUMBLINE_PII_KEY is not set: known to all, so its pseudonyms hide nothing.
PUBLIC_KEY = b"plumbline development key"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of a benchmark item's five-word shingles."""
    return decontaminate.containment(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonyms are only as secret as the key in PLUMBLINE_PII_KEY; without one the query says so."""
    key = os.environ.get("PLUMBLINE_PII_KEY", "").encode()
    if not key:
        warnings.warn("PLUMBLINE_PII_KEY is not set: pseudonyms are made with a public key and can be inverted by anyone", stacklevel=2)
    return pii.pseudonymised(read(spark, sf_dir, "documents"), key or PUBLIC_KEY)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(mixing.sizes(docs)).select("doc_id", "source", "size", "source_size", "target", "taken")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.components(read(spark, sf_dir, "documents"), shingle=3, tau=2)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    train = toxicity.labelled(docs.filter(remainder("doc_id", 4) != 2), read(spark, sf_dir, "labels"))
    lex = toxicity.learn(train, Scratch(spark, "toxicity"))
    got = toxicity.score(docs, lex)
    return got.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op6_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder("doc_id", 5) == 1
    model = ngram.learn(docs.filter(~held), Scratch(spark, "ngram"))
    got = ngram.score(docs, model)
    return got.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text")
    found, _ = secrets.scan(versions)
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        F.col("path").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans")
    )


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdup.deduplicate(read(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.filter(remainder("doc_id", 3) != 1), Scratch(spark, "langid"))
    got = langid.predict(docs, model)
    return got.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as images: the tables have no media column, so each page's visible text is rendered whole."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("content"))
    return media.copies(pages, media.render).withColumnRenamed("id", "page_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid vector on the first 32 components. A deviation beyond 64 bits is null."""
    vecs = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vecs)
    white = whitening.whitened(vecs, model, components=32)
    each = white.select("vec_id", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, model.explained or [0.0])), F.col("at")).alias("explained"), F.lit(whitening.identity_error(white)).cast("double").alias("identity_error"),
    )


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=5, percent=85)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the outputs and of the texts that are read back from them."""
    got = fim.transformed(read(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_pii, op3_mixing, op4_simhash, op5_toxicity, op6_ngram, op7_secrets, op8_suffix, op9_langid, op10_media, op11_whitening, op12_minhash, op13_fim)
}
ORACLES = {"op1_decontaminate": oracles.OP1, "op3_mixing": oracles.OP3, "op7_secrets": oracles.OP7, "op12_minhash": oracles.OP12, "op13_fim": oracles.OP13}
