"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of ``docs``. Models and side tables come from ``sf_dir``; texts are those of ``docs``.
SQL can't express the learned and fingerprint stages, so ORACLE_SQL is None. The tests hold near duplicates,
decontamination, redaction and mixing against brute force, and the lexicon's scores against planted terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, mixing, secrets, simhash, toxicity
from plumbline.llm.common import Scratch, read, remainder

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go. The lexicon is learned from the labelled rows of ``docs`` outside the held-out fold."""
    train = toxicity.labelled(docs.filter(remainder("doc_id", 4) != 2), read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, toxicity.learn(train, Scratch(spark, "stage-toxicity")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word-shingle similarity 0.8 stays: SimHash links, verified, and the pairs they miss."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item go."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay; each secret in a text is replaced by a mark."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their size, their source's size and target, and the words taken."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
