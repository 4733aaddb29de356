"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding lower-cases, applies compatibility forms, maps homoglyphs to Latin letters and undoes digit and sign
substitutions before a letter. Weights are learned from all labelled training rows: a first pass counts
tokens by document, a second counts the distinct contexts (word before, word after) of the candidates by
class, so that copies of one text, however many, count as one. Exception phrases are two-word contexts of a
term that occur mostly in clean texts; their hits take the term's weight back. No term or phrase that passes
the tests is left out. A logistic link on three features is fitted on about ``fit_rows`` rows, chosen by a hash
of the id. The driver holds the lexicon, which is the model, and those rows' features.

Null and empty texts have no hit and get the score of such texts. Repeated labels of a document count once,
toxic if any is; documents without a label only get scores. Empty tables give an empty result; with no
labelled row every score is 0.5 before the link's prior, 0 hits and prediction by the same threshold.
"""

from __future__ import annotations

import dataclasses
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_IDS, Scratch, arrow, docs_view, id_kind, rows_of

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "ѕ": "s", "ј": "j", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "ս": "u", "օ": "o",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
_DROPPED = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)))
_TABLE = str.maketrans(HOMOGLYPHS | dict.fromkeys(_DROPPED))
_MAPPED = re.compile("[" + "".join(HOMOGLYPHS) + _DROPPED + "]")
_SIGN = re.compile(r"[013457@$!|8]{1,2}(?=[a-z])")
_TOKEN = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    t = (text or "").lower()
    if not t.isascii():
        if not unicodedata.is_normalized("NFKC", t):
            t = unicodedata.normalize("NFKC", t)
        if _MAPPED.search(t):
            t = t.translate(_TABLE)

    def letters(m: re.Match) -> str:
        if m.start() and t[m.start() - 1] in "0123456789$@!|":
            return m[0]
        return "".join(SIGNS[c] for c in m[0])

    return _SIGN.sub(letters, t)


def tokens(text: str | None) -> list[str]:
    """Letter runs of the folded text."""
    out = []
    for w in fold(text).split():
        if w.isalpha():
            out.append(w)
        else:
            out += _TOKEN.findall(w)
    return out


@dataclasses.dataclass
class Lexicon:
    terms: dict[str, float]
    exceptions: dict[str, float]
    mean: list[float]
    scale: list[float]
    coef: list[float]
    bias: float

    def automaton(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for k, w in self.terms.items():
            a.add_word(k, (len(k), w))
        for k, w in self.exceptions.items():
            a.add_word(k, (len(k), -w))
        if not len(a):
            return None
        a.make_automaton()
        return a

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - np.array(self.mean)) / np.array(self.scale) @ np.array(self.coef) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(text: str | None, automaton) -> tuple[float, float, float]:
    """(any hit, log of the summed weight, log of the weight per hundred words), over whole-word hits."""
    if automaton is None or not text:
        return 0.0, 0.0, 0.0
    t, total = fold(text), 0.0
    n = len(t)
    for end, (size, w) in automaton.iter(t):
        a = end - size
        if (a < 0 or not t[a].isalpha()) and (end + 1 >= n or not t[end + 1].isalpha()):
            total += w
    if total <= 0:
        return 0.0, 0.0, 0.0
    return 1.0, math.log1p(total), math.log1p(100 * total / (1 + text.count(" ")))


def _log_odds(a: str, b: str, na: float, nb: float):
    """(smoothed log-odds, signed root of the likelihood ratio) of counts a of na against b of nb."""
    w = F.log((F.col(a) + 0.5) / (na + 1)) - F.log((F.col(b) + 0.5) / (nb + 1))
    both = F.col(a) + F.col(b)
    part = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * (na + nb) / (both * n))).otherwise(0.0)
    return w, F.signum(w) * F.sqrt(F.greatest(2 * (part(a, na) + part(b, nb)), F.lit(0.0)))


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, pos, neg) documents by class; the empty token counts words."""
    count: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = {k for k, _ in count}
        cols = [pa.array(list(keys), pa.string()), *[pa.array([count[k, y] for k in keys], pa.int64()) for y in (1, 0)]]
        count.clear()
        return pa.RecordBatch.from_arrays(cols, names=["token", "pos", "neg"])

    for b in batches:
        for t, y in zip(rows_of(b, "text"), rows_of(b, "y")):
            words = tokens(t)
            count.update((w, y) for w in set(words))
            count["", y] += len(words)
            if len(count) > 150_000:
                yield flush()
    yield flush()


def learn(train: DataFrame, scratch: Scratch, fit_rows: int = 50_000) -> Lexicon:
    """Lexicon from ``train(doc_id, text, y)``."""
    n = {y: k for y, k in train.groupBy("y").count().collect()}
    if not n.get(1) or not n.get(0):
        prior = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
        return Lexicon({}, {}, [0.0] * 3, [1.0] * 3, [0.0] * 3, math.log(prior / (1 - prior)))
    counts = scratch.keep(train.select("text", "y").transform(arrow(_token_counts, "token string, pos long, neg long")).groupBy("token").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "tokens")
    words = counts.filter("token = ''").first()
    w, z = _log_odds("pos", "neg", n[1], n[0])
    # by size of effect too: significance alone admits ever more common words as the corpus grows
    cand = counts.filter("token <> '' and pos >= 3").select("token", w.alias("w"), z.alias("z")).filter("z >= 2.5 and w >= 0.5")
    wanted = {r.token for r in cand.collect()}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = set()
            for t, y in zip(rows_of(b, "text"), rows_of(b, "y")):
                ws = ["", *tokens(t), ""]
                out.update((x, ws[i - 1], ws[i + 1], y) for i, x in enumerate(ws) if x in wanted)
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in cols[:3]], pa.array(cols[3], pa.int64())], names=["token", "before", "after", "y"])

    scratch.drop("tokens")
    seen = scratch.keep(train.select("text", "y").transform(arrow(contexts, "token string, before string, after string, y long")).distinct(), "contexts")
    by = [F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")]
    w, z = _log_odds("pos", "neg", words["pos"], words["neg"])
    kept = scratch.keep(seen.groupBy("token").agg(*by).filter("pos >= 3").select("token", w.alias("w"), z.alias("z")).filter("z >= 4 and w >= 0.7"), "terms")
    terms = {r.token: r.w for r in kept.collect()}
    sides = seen.select("token", "y", F.explode(F.array(F.concat_ws(" ", "before", "token"), F.concat_ws(" ", "token", "after"))).alias("phrase"), "before", "after")
    clean = sides.join(F.broadcast(kept.select("token")), "token", "left_semi").groupBy("token", "phrase").agg(*by).select("token", "phrase", w.alias("w"), "neg").filter("neg >= 5 and w < 0 and trim(phrase) like '% %'")
    exceptions = {r.phrase: terms[r.token] for r in clean.collect()}
    scratch.drop("contexts")
    lex = Lexicon(terms, exceptions, [0.0] * 3, [1.0] * 3, [0.0] * 3, 0.0)
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30)) < int(min(1.0, fit_rows / sum(n.values())) * (1 << 30))
    x = _featured(train.filter(chance), lex, keep="y").collect()  # about fit_rows rows of three numbers
    f, y = np.array([r.f for r in x]), np.array([r.y for r in x], float)
    mean, scale = f.mean(axis=0), np.where(f.std(axis=0) > 1e-9, f.std(axis=0), 1.0)
    a = np.c_[(f - mean) / scale, np.ones(len(f))]
    beta = np.zeros(4)
    ridge = np.diag([1.0, 1.0, 1.0, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return dataclasses.replace(lex, mean=mean.tolist(), scale=scale.tolist(), coef=beta[:3].tolist(), bias=float(beta[3]))


def _featured(df: DataFrame, lex: Lexicon, keep: str | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lex.automaton()
        for b in batches:
            f = pa.array([list(features(t, a)) for t in rows_of(b, "text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), f, *([b.column(2).cast(pa.int64())] if keep else [])], names=["doc_id", "f", *([keep] if keep else [])])

    return df.select("doc_id", "text", *([keep] if keep else [])).transform(arrow(run, f"doc_id {id_kind(df)}, f array<double>" + (f", {keep} long" if keep else "")))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, y) of labelled documents; the label table is broadcast only while its counted rows are few."""
    y = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("y"))
    few = labels.count() <= BROADCAST_IDS
    return docs_view(docs).join(F.broadcast(y) if few else y, "doc_id").select("doc_id", "text", "y")


def score(docs: DataFrame, lex: Lexicon, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lex.automaton()
        for b in batches:
            s = lex.score(np.array([features(t, a) for t in rows_of(b, "text")]).reshape(-1, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs_view(docs).transform(arrow(run, f"doc_id {id_kind(docs)}, score double, predicted int"))


def keep_clean(docs: DataFrame, lex: Lexicon, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` below the threshold, all columns kept; nothing but the two columns goes to Python and no join follows."""
    names = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lex.automaton()
        for b in batches:
            s = lex.score(np.array([features(t, a) for t in rows_of(b, "text")]).reshape(-1, 3))
            yield b.filter(pa.array(s < threshold))

    return docs.select("doc_id", "text", *names).transform(arrow(run, docs.select("doc_id", "text", *names).schema)).select(*docs.columns)
