"""Secret scans with an incremental ledger of content-addressed blobs. DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. A blob is scanned once under a version
of the rules: pairs that the ledger holds are skipped, the others scanned and added, and findings are joined
back to all paths. Spans are code-point offsets: the text is split at a rule's matches, and the lengths of
pieces and matches are added up, which is the regular expression's leftmost non-overlapping walk.

Null text is empty text; blobs without a finding are in the ledger too (with no span); repeated rows share a
blob; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_IDS, Scratch


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# Rules in their order. (kind, pattern, least length of the checked group, that group, what a matching text must contain)
ASSIGN = "(" + "|".join(map(_either, ["password", "passwd", "secret", "token", "api_?key"])) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = [
    ("assign", ASSIGN, 8, 2, ("password", "passwd", "secret", "token", "api_key", "apikey")),
    ("access", r"AKIA[A-Z0-9]+", 16, 0, ("AKIA",)),
    ("hex", r"[0-9a-f]+", 32, 0, None),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, ("PRIVATE KEY-----",)),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 40, 0, ("gh",)),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15, 0, ("xox",)),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0, ("eyJ",)),
]
BASE = ("assign", "access", "hex")
RULE_VERSION = "2"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _could(kind: str, needs: tuple[str, ...] | None) -> Column:
    """A plain substring test that every matching text passes, so most texts meet no regular expression."""
    if needs is None:
        return F.col("text").rlike("[0-9a-f]{32}")
    t = F.lower("text") if kind == "assign" else F.col("text")
    out = F.lit(False)
    for n in needs:
        out = out | F.contains(t, F.lit(n))
    return out


def rule_spans(rank: int) -> Column:
    """Spans of one rule in ``text``, in order."""
    kind, pattern, least, group, needs = RULES[rank]
    if kind == "hex":  # a maximal run of 32 or more is where the plain pattern's long matches are
        pattern = "[0-9a-f]{32,}"
    pieces = F.split("text", pattern, -1)
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    checked = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else whole
    steps = F.arrays_zip(F.transform(pieces, lambda p: F.length(p)).alias("gap"), F.transform(whole, lambda m: F.length(m)).alias("hit"), F.transform(checked, lambda m: F.length(m)).alias("len"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(acc, s):
        at = acc["at"] + s["gap"]
        end = at + F.coalesce(s["hit"], F.lit(0))
        one = F.array(F.struct(at.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")))
        ok = s["hit"].isNotNull() & (s["len"] >= least)
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.when(_could(kind, needs), F.aggregate(steps, start, step)["found"]).otherwise(F.array().cast(SPAN))


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, spans) from (blob, text): every rule, ordered by start, then rule."""
    return blobs.select("blob", F.array_sort(F.concat(*[rule_spans(i) for i in range(len(RULES))])).alias("spans"))


def address(versions: DataFrame) -> DataFrame:
    """(path, version, blob, text): content address of each version."""
    return versions.select("path", "version", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: str = RULE_VERSION, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger rows to append) for (path, version, text).

    ``ledger(blob, rule_version, spans)`` holds what was scanned before. Copies are cut to one text per map
    task before the shuffle by blob, so a blob that a third of the rows share costs no more than another.
    """
    paths = address(versions)
    hits, new = scan_unseen(paths.select("blob", "text"), ledger, rules, scratch or Scratch(versions.sparkSession, "secrets"))
    findings = paths.select("path", "version", "blob").join(hits, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))
    return findings, new


def scan_unseen(blobs: DataFrame, ledger: DataFrame | None, rules: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(blobs with findings as (blob, spans), ledger rows to append) for (blob, text), each blob scanned once.

    Most blobs have no finding: only those that have are worth a join, the rest are empty by definition.
    """
    if ledger is not None:
        ledger = ledger.filter(F.col("rule_version") == rules).select("blob", "rule_version", "spans")
        blobs = blobs.join(ledger.select("blob").distinct(), "blob", "left_anti")
    found = scan_blobs(blobs.groupBy("blob").agg(F.first("text").alias("text")))
    new = scratch.keep(found.select("blob", F.lit(rules).alias("rule_version"), "spans"), "ledger")
    known = new if ledger is None else new.unionByName(ledger)
    return known.filter(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"]), new


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans are one replacement."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        keep = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(fresh, F.concat(acc["out"], keep, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def redacted(docs: DataFrame, ledger: DataFrame | None = None, rules: str = RULE_VERSION) -> DataFrame:
    """``docs`` with each secret of ``text`` replaced; rows and columns stay, and null stays null.

    Findings meet the rows by content address, never by id, so rows without an id or with a shared one are
    redacted by their own text. The blobs with findings, few, are broadcast while counted as such.
    """
    scratch = Scratch(docs.sparkSession, "redact")
    blob = F.unhex(F.sha2("text", 256))
    texts = docs.filter("text is not null").select(blob.alias("blob"), "text")
    hits, _ = scan_unseen(texts, ledger, rules, scratch)
    hits, seen = scratch.keep_with(hits.select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans")), "hits", F.count("*").alias("n"))
    joined = docs.withColumn("_at", blob).join(F.broadcast(hits) if seen["n"] <= BROADCAST_IDS else hits, F.col("_at") == F.col("_blob"), "left")
    text = F.when(F.col("_blob").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col("_spans")))
    return joined.withColumn("text", text).select(*docs.columns)
