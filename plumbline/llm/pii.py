"""Format-preserving pseudonyms for personal data by a keyed Feistel network.

Found and validated: card numbers (Luhn), IBANs (mod 97), national ids of the form ddd-dd-dddd, telephone
numbers, IPv4 addresses, calendar dates and e-mail addresses. Each value is mapped within its own format: the
characters that may vary are read as one mixed-radix number, permuted by a Feistel network over exactly that
domain (cycle walking), and written back, with check digits made anew. Equal values get equal pseudonyms in
every document, separators and letter case stay, and who holds the key can invert it. Where a card or IBAN fails
validation, shorter ones at its start are tried and the search goes on just after that start; other numbers that
fail validation are left alone. A longer number that fails may by chance be valid once a part of it is replaced,
so such a text is inverted by its spans' values, not always by a second search.

Null text stays null; empty text has no span. A value is a match of the leftmost kind in the order below;
repeated rows give equal results; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import arrow, docs_view, id_kind, rows_of

ROUNDS = 10
KINDS = ("email", "iban", "date", "ipv4", "card", "ssn", "phone")
# Formats in their order of precedence.
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<date>(?<![0-9/.-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.](?:19|20)[0-9]{2})(?![0-9/-]))"
    r"|(?P<ipv4>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))"
    r"|(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<phone>(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9+])\+[0-9]{8,14}(?![0-9]))"
)
_HINT = re.compile(r"[0-9][ .-]?[0-9]|@")  # every match of PATTERN holds one of these
# Kinds of varying length, whole; a shorter form must end where no such character follows.
_CUT = {
    "iban": (re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"), re.compile(r"[A-Za-z0-9]")),
    "card": (re.compile(r"[0-9](?:[ -]?[0-9]){12,18}"), re.compile(r"[0-9]")),
}
_DAY0, _DAYS = dt.date(1900, 1, 1), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days


class Feistel:
    """A keyed permutation of range(n) for any n, and its inverse."""

    def __init__(self, key: bytes):
        self.key = key

    def _f(self, i: int, n: int, label: bytes, r: int, mod: int) -> int:
        size = (mod.bit_length() + 7) // 8 + 8
        data = b"%b|%d|%d|%d" % (label, n, i, r)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=min(64, size)).digest(), "big") % mod

    def _once(self, x: int, n: int, label: bytes, back: bool) -> int:
        a = math.isqrt(n - 1) + 1
        left, right = divmod(x, a)  # left below b, right below a, and a * b covers n
        b = (n + a - 1) // a
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._f(i, n, label, left, a)) % a
            else:
                left = (left + sign * self._f(i, n, label, right, b)) % b
        return left * a + right

    def permute(self, x: int, n: int, label: bytes = b"", back: bool = False) -> int:
        if n < 2:
            return x
        while True:
            x = self._once(x, n, label, back)
            if x < n:
                return x


def luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def luhn_digit(body: str) -> str:
    t = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        t += d - 9 if d > 9 else d
    return str(-t % 10)


def iban_check(country: str, body: str) -> str:
    n = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - n % 97:02d}"


def _vary(f: Feistel, s: str, label: bytes, back: bool) -> str:
    """All ASCII letters and digits of ``s`` permuted as one number; each keeps its class, the rest its place."""
    alphabets = [("0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isascii() and c.isalnum() else None for c in s]
    x, n = 0, 1
    for c, a in zip(s, alphabets):
        if a:
            x, n = x * len(a) + a.index(c), n * len(a)
    x = f.permute(x, n, label, back)
    out = []
    for c, a in zip(reversed(s), reversed(alphabets)):
        if a:
            x, r = divmod(x, len(a))
            out.append(a[r])
        else:
            out.append(c)
    return "".join(reversed(out))


def _fill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def pseudonym(kind: str, value: str, f: Feistel, back: bool = False) -> str | None:
    """The pseudonym, or None where the value isn't valid. ``back`` inverts it."""
    label = kind.encode()
    plain = re.sub(r"[^A-Za-z0-9]", "", value)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{_vary(f, local, label, back)}@{_vary(f, host, b'host', back)}.{top}"
    if kind == "card":
        if not luhn(plain) or len(set(plain)) == 1:
            return None
        body = _vary(f, plain[:-1], b"card%d" % len(plain), back)
        return _fill(value, body + luhn_digit(body))
    if kind == "iban":
        if iban_check(plain[:2], plain[4:]) != plain[2:4]:
            return None
        body = _vary(f, plain[4:], b"iban" + plain[:2].encode(), back)
        return _fill(value, plain[:2] + iban_check(plain[:2], body) + body)
    if kind == "ipv4":
        parts = value.split(".")
        if any(int(p) > 255 or (p != "0" and p[0] == "0") for p in parts):
            return None
        x = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, label, back)
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "date":
        iso = value[4] == "-"
        y, m, d = (value[:4], value[5:7], value[8:]) if iso else (value[6:], value[3:5], value[:2])
        month_first = not iso and int(m) > 12
        if month_first:
            m, d = d, m
        try:
            day = dt.date(int(y), int(m), int(d))
        except ValueError:
            return None
        while True:  # dates that read only as month first stay such dates
            day = _DAY0 + dt.timedelta(days=f.permute((day - _DAY0).days, _DAYS, label, back))
            if not month_first or day.day > 12:
                break
        one, two = (day.month, day.day) if month_first else (day.day, day.month)
        return day.isoformat() if iso else f"{one:02d}{value[2]}{two:02d}{value[5]}{day.year}"
    if kind == "ssn":
        area, group, serial = int(plain[:3]), int(plain[3:5]), int(plain[5:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = 898  # 1 to 899 without 666
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(f.permute(x, areas * 99 * 9999, label, back), 9999)
        area, group = divmod(x, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"
    cc = re.match(r"\+[0-9]{1,3}(?=[ .(-])", value)
    head = cc[0] if cc else value[:2] if value[0] == "+" else ""
    return head + _vary(f, value[len(head) :], b"phone", back)


def _ends(text: str, m: re.Match) -> Iterator[int]:
    """Ends of the values that may start where ``m`` does, longest first."""
    yield m.end()
    if m.lastgroup in _CUT:
        whole, more = _CUT[m.lastgroup]
        for end in range(m.end() - 1, m.start() + 12, -1):
            if not more.match(text, end) and whole.fullmatch(text, m.start(), end):
                yield end


def pseudonymise(text: str | None, f: Feistel, back: bool = False, cache=None) -> tuple[str | None, list[tuple[str, int, int]]]:
    """(text, spans of the original as kind, start, end in code points)."""
    if not text or not _HINT.search(text):
        return text, []
    out, spans, at, pos = [], [], 0, 0
    make = cache or (lambda k, v: pseudonym(k, v, f, back))
    while m := PATTERN.search(text, pos):
        pos = m.start() + 1
        for end in _ends(text, m):
            new = make(m.lastgroup, text[m.start() : end])
            if new is not None:
                out += [text[at : m.start()], new]
                spans.append((m.lastgroup, m.start(), end))
                at = pos = end
                break
    return "".join(out) + text[at:], spans


def pseudonymised(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """(doc_id, n_spans, spans, text): one pass, no shuffle; spans as kind:start:end, comma-joined."""
    key = hashlib.blake2b(key, digest_size=32).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        cache = functools.lru_cache(100_000)(lambda k, v: pseudonym(k, v, f, back))
        for b in batches:
            got = [pseudonymise(t, f, back, cache) for t in rows_of(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for _, s in got], pa.int64()), pa.array([",".join(f"{k}:{a}:{z}" for k, a, z in s) for _, s in got], pa.string()),
                 pa.array([t for t, _ in got], pa.string())],
                names=["doc_id", "n_spans", "spans", "text"],
            )

    return docs_view(docs).transform(arrow(run, f"doc_id {id_kind(docs)}, n_spans long, spans string, text string"))
