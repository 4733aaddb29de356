"""Fill-in-the-middle: a document's units are cut in three and written prefix, suffix, middle or suffix, prefix, middle.

The Split pre-tokenizer of the tokenizers library isolates every match of the unit pattern and gives each one's
offsets in code points; nothing is trained. The length of the offset array is the number of units n, two draws
from the id's hash are ranks in that array, and the offsets at these ranks are where the text is sliced.

Null texts count as empty; an empty text, and one that contains a sentinel, stays plain. A null id draws as the
empty string. Repeated rows give repeated results, an empty table an empty one. Texts are taken whole, one batch
of bounded bytes at a time. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow, docs_view, id_kind, rows_of

LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four 32-bit numbers of the sha256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """No sentinel may begin inside another, else an output could be read in two ways."""
    if len(set(sentinels)) < 3 or any(not s for s in sentinels) or any(a[0] in b[1:] for a in sentinels for b in sentinels):
        raise ValueError(f"sentinels must be three different strings whose first characters occur nowhere else in them, not {sentinels}")


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = LINES, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): ``rate`` of 100 documents are cut, ``spm`` of 100 of those suffix first.

    ``unit`` is a pattern whose matches cover a text without gaps (lines by default).
    """
    check_sentinels(sentinels)
    p, s, m = sentinels

    def cut(split, text: str, h: tuple[int, int, int, int]):
        ends = [0, *(end for _, (_, end) in split.pre_tokenize_str(text))]
        n = len(ends) - 1
        if not text or any(x in text for x in sentinels) or h[2] % 100 >= rate:
            return n, "plain", None, None, text
        first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b = ends[first], ends[second]
        head, mid, tail = text[:a], text[a:b], text[b:]
        if h[3] % 100 < spm:
            return n, "spm", a, b - a, f"{s}{tail}{p}{head}{m}{mid}"
        return n, "psm", a, b - a, f"{p}{head}{s}{tail}{m}{mid}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex, pre_tokenizers

        split = pre_tokenizers.Split(Regex(unit), behavior="isolated")
        for b in batches:
            h = zip(*[rows_of(b, f"h{i}") for i in range(4)])
            rows = [cut(split, t or "", x) for t, x in zip(rows_of(b, "text"), h)]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    drawn = docs_view(docs).select("doc_id", "text", *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))])
    return drawn.transform(arrow(run, f"doc_id {id_kind(docs)}, n long, form string, prefix_chars long, middle_chars long, output string"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text an output was made from. Each sentinel occurs once in a cut output, so it splits at them."""
    parts = F.split(output, "|".join(re.escape(x) for x in sentinels), -1)
    head = F.when(form == "psm", F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2)))
    tail = F.when(form == "psm", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).otherwise(F.concat(head, F.get(parts, F.lit(3)), tail))
