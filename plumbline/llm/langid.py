"""Language identification by nearest centroids of TF-IDF character n-gram vectors.

Texts are lower-cased, everything but letters becomes one space, and the UTF-8 bytes' trigrams are hashed
into ``DIM`` cells. Document frequencies are counted over all training rows. Each language's vectors are
clustered into several centroids (spherical k-means) on at most ``fit_rows`` of its rows, the least by a hash
of the id, so that every part of the table has its share.
The nearest centroid by cosine gives the language; a text farther from it than nearly all of the cluster's
own rows is flagged as rejected.

A null text or one without a letter is ``und`` with score 0 and rejected. Rows with a null language aren't
learned from; with none to learn from every text is ``und``. Ties go to the first language in order.
Repeated rows and other columns have no effect on one another.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, arrow, id_kind, rows_of

DIM = 4096
_NOT_LETTER = re.compile(r"[\W\d_]+")


def counts(text: str) -> np.ndarray:
    b = np.frombuffer((" " + _NOT_LETTER.sub(" ", text.lower()) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(DIM, np.float32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(DIM - 1), minlength=DIM).astype(np.float32)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(np.stack([counts(t) for t in texts])) * idf
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


@dataclasses.dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray


def _frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for t in rows_of(b, "text"):
                if t:
                    df += counts(t) > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(np.append(df, n))], names=["cell", "n"])

    got = train.select("text").transform(arrow(run, "cell long, n long")).groupBy("cell").agg(F.sum("n").alias("n")).collect()  # DIM + 1 rows
    out = np.zeros(DIM + 1, np.int64)
    for c, n in got:
        out[c] = n
    return int(out[DIM]), out[:DIM]


def _cluster(x: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds; empty clusters go."""
    pick = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(pick) < min(k, len(x)):
        pick.append(int(np.argmin((x @ x[pick].T).max(axis=1))))
    c = x[pick]
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[at == i].sum(axis=0) for i in np.unique(at)])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    s = x @ c.T
    at = np.argmax(s, axis=1)
    least = np.array([np.quantile(s[at == i, i], 0.005) if (at == i).any() else 0.0 for i in range(len(c))])
    return c, least


def learn(train: DataFrame, scratch: Scratch, clusters: int = 4, fit_rows: int = 1000) -> Model:
    """From ``train(doc_id, text, lang)``; document frequencies use every row, centroids a bounded sample per language."""
    rows = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    n, df = _frequencies(rows)
    idf = (np.log((1 + n) / (1 + df)) + 0.05).astype(np.float32)
    langs = sorted(sizes)
    if not langs:
        return Model([], idf, np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(0))
    share = F.create_map(*[v for k in langs for v in (F.lit(k), F.lit(min(1.0, 1.5 * fit_rows / sizes[k])))])
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.withColumn("u", u).filter(F.col("u") < share[F.col("lang")])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "doc_id"]).head(fit_rows)
        c, least = _cluster(vectors(pdf["text"].tolist(), idf), clusters)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "c": list(c.astype(np.float64)), "least": least})

    got = sample.select("doc_id", "text", "lang", "u").groupBy("lang").applyInPandas(fit, "lang string, c array<double>, least double").collect()
    got.sort(key=lambda r: r.lang)
    return Model(langs, idf, np.array([r.c for r in got], np.float32), np.array([langs.index(r.lang) for r in got]), np.array([r.least for r in got]))


def predict(docs: DataFrame, model: Model, keep: str | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                texts = rows_of(part, "text")
                ok = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
                lang, score, far = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                if ok.any() and model.langs:
                    at = np.flatnonzero(ok)
                    s = vectors([texts[j] for j in at], model.idf) @ model.centroids.T
                    best = s.argmax(axis=1)
                    score[at] = np.clip(s.max(axis=1), 0, 1)
                    far[at] = score[at] < model.least[best] - 1e-6
                    for j, k in zip(at, best):
                        lang[j] = model.langs[model.owner[k]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score), pa.array(far)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").transform(arrow(run, f"doc_id {id_kind(docs)}, lang_pred string, score double, rejected boolean"))
