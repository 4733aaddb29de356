"""Interpolated modified Kneser-Ney trigram model, counted in Spark, stored as sorted hash arrays.

Words are addressed by 64-bit hashes; their ranks in the sorted vocabulary are their ids. Triples (t, u, w) of
consecutive words are counted by task and dealt by the middle word u, so that one bucket sees whole contexts
(t, u) and all that precedes (u, w): one shuffle gives the counts, the contexts' totals and the continuation
counts. A frequent middle word has parts of bounded size: its triples are dealt once by t, for counts and
contexts, and once by w, for continuation. Buckets are merged one at a time and written as sorted arrays of
hashed keys beside small counts; contexts that occur once are keys alone. Scoring tasks memory-map these files:
no part of the model passes through the driver but the frequent words' totals and the counts of counts.

p3(w | t u) = max(c(t u w) - D(c), 0) / c(t u) + g(t u) p2(w | u), where p2 and p1 discount the numbers of
distinct words before (u w) and w likewise, and p1 interpolates with 1 / (V + 1), one place being the unknown
word's. Every text starts after two begin marks and ends with an end token, which counts. An unseen context
leaves the lower order. Pairs and triples are known by 64-bit hashes, of which tables keep enough that an unseen
one passes for a seen one about once in 2^27 lookups.

Null text is empty text: its only token is the end. An empty table gives an empty result; with nothing to
learn from, every token has probability 1. Repeated rows count as often as they occur; ids of any type only name
the rows of the result. Other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared
from plumbline.llm.common import Scratch, arrow, dealt, docs_view, id_kind, rows_of

END, BEGIN = b" end", b" begin"  # no word holds a space
STEP = 256  # documents tokenised at a time
SCORED = 1024  # documents scored at a time, at most the bytes of an Arrow batch: each bucket is opened once for all of them
FLUSH = 3_000_000  # triples a task counts before it packs what it has
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class Places(dict):
    """Word to its place among the words met so far, with their hashes in order; forgets all once it is large."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []
        self.turn = 0  # how often all was forgotten

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return at

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(places of all words with an end after each text, tokens per text)."""
        if len(self.hashes) > 300_000:
            self.clear()
            self.hashes = []
            self.turn += 1
        out, n = [], []
        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").lower().split()
            words.append(END)
            out += [self[w] for w in words]
            n.append(len(words))
        return np.array(out, np.int64), np.array(n, np.int64)


def slices(b: pa.RecordBatch, step: int = STEP) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(b), step):
        yield b.slice(i, step)


def before(x: np.ndarray, n: np.ndarray, begin: int) -> np.ndarray:
    """What stands before each token."""
    u = np.empty_like(x)
    u[1:] = x[:-1]
    u[np.cumsum(n) - n] = begin
    return u


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit words that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))


def triple_key(t: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mixed(pair_key(t, u) + (w.astype(np.uint64) + np.uint64(1)) * _M3)


def _heads(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new value of the columns begins."""
    if not len(sorted_columns[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(sorted_columns[0]), bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _summed(n: np.ndarray, head: np.ndarray) -> np.ndarray:
    return np.add.reduceat(n.astype(np.int64), head) if len(head) else np.empty(0, np.int64)


def _merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(n) and n.min() == n.max() == 1:
        keys = np.sort(keys)
        head = _heads(keys)
        return keys[head], np.diff(np.append(head, len(keys)))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    head = _heads(keys)
    return keys[head], _summed(n, head)


def count_triples(u: np.ndarray, t: np.ndarray, w: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """The distinct triples with their summed counts, by (u, t, w). Three narrow ids are sorted as one word."""
    width = int(max(u.max(initial=0), t.max(initial=0), w.max(initial=0))).bit_length()
    if 3 * width <= 64:
        a, b = np.uint64(2 * width), np.uint64(width)
        key, c = _merged((u.astype(np.uint64) << a) | (t.astype(np.uint64) << b) | w.astype(np.uint64), c)
        low = np.uint64((1 << width) - 1)
        return [(key >> a).astype(np.uint32), ((key >> b) & low).astype(np.uint32), (key & low).astype(np.uint32), c]
    order = np.lexsort((w, t, u))
    u, t, w, c = u[order], t[order], w[order], c[order]
    head = _heads(u, t, w)
    return [u[head], t[head], w[head], _summed(c, head)]


def squeezed(columns: list[np.ndarray]) -> bytes:
    """Columns of 32-bit numbers as differences, by byte place, compressed: sorted ids cost a few bytes a row."""
    planes = [np.diff(c.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unsqueezed(data: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // (4 * columns)
    return [np.cumsum(np.ascontiguousarray(p.reshape(4, n).T).view(np.uint32).ravel(), dtype=np.uint32) for p in raw.reshape(columns, 4 * n)] if n else [np.empty(0, np.uint32)] * columns


def _grouped(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by bucket, sorted buckets, heads); narrow numbers are sorted by radix."""
    narrow = bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket
    order = np.argsort(narrow, kind="stable")
    b = bucket[order]
    return order, b, _heads(b)


def _rows(bucket: np.ndarray, kind: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(bucket, kind, a): one row a bucket, the columns squeezed; the order within a bucket stays."""
    order, b, head = _grouped(bucket)
    for i, j in zip(head, np.append(head[1:], len(b))):
        at = order[i:j]
        yield pa.RecordBatch.from_arrays([pa.array([int(b[i])], pa.int32()), pa.array([kind], pa.int32()), pa.array([squeezed([c[at] for c in columns])], pa.binary())], names=["bucket", "kind", "a"])


PACKED = "bucket int, kind int, a binary"


def one_at_a_time(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, dict[int, list[np.ndarray]]]]:
    """(bucket, columns by kind) of rows sorted by bucket: only one bucket is held."""
    at, parts = None, {}

    def whole():
        return {k: [np.concatenate(c) for c in zip(*[unsqueezed(d, columns) for d in ds])] for k, ds in parts.items()}

    for b in batches:
        for bucket, kind, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if bucket != at and parts:
                yield at, whole()
                parts = {}
            at = bucket
            parts.setdefault(kind, []).append(a.as_py())
    if parts:
        yield at, whole()


def _count_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == i).sum()) for i in (1, 2, 3, 4)]


def _by_size(n: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Per group: the sum, and how many are 1, 2 and more."""
    return np.stack([_summed(a, head) for a in (n, n == 1, n == 2, n >= 3)], axis=1) if len(head) else np.zeros((0, 4), np.int64)


def _small(a: np.ndarray) -> np.ndarray:
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.int64)


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D1, D2, D3+ of the counts of counts; where one is zero the discount falls back to the last known share."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
    return [min(max(x, 0.0), i + 1.0) for i, x in enumerate(d)]


@dataclasses.dataclass
class Model:
    base: str
    bits: int  # of the bucket number
    n_tokens: int
    vocab: int
    offsets: np.ndarray  # first word id of each bucket
    hot: np.ndarray  # ids of the frequent words, sorted; the begin mark's is vocab
    parts: np.ndarray  # into how many parts their triples are dealt
    hot_stat: np.ndarray  # their totals as contexts of pairs
    d: dict[int, list[float]]  # discounts by order
    total_word: int
    floor: float

    def place(self, u: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Bucket of rows with middle word u; those of a frequent word are dealt by ``other`` too."""
        u = u.astype(np.uint64)
        part = np.zeros(len(u), np.uint64)
        if len(self.hot):
            at = shared.find(self.hot, u.astype(np.int64))
            many = np.flatnonzero(at >= 0)
            part[many] = _mixed(other[many].astype(np.uint64) + _M3) % self.parts[at[many]].astype(np.uint64) + np.uint64(1)
        return (_mixed((u << np.uint64(32)) + part) >> np.uint64(64 - self.bits)).astype(np.int32)


class Lookup:
    """Memory-mapped model of one worker, with what it has looked up of the words met so far."""

    def __init__(self, m: Model):
        self.m, self.open, self.places, self.turn = m, {}, Places(), 0
        self.ids, self.stat = np.empty(0, np.int64), np.empty((0, 2), np.int64)

    def file(self, name: str) -> np.ndarray:
        if name not in self.open:
            self.open[name] = shared.get(self.m.base, name) if shared.has(self.m.base, name) else np.empty(0, np.uint64)
        return self.open[name]

    def gather(self, bucket: np.ndarray, keys: np.ndarray, table: str, *values: tuple[str, int]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(found, values by (array, width)) of keys in their buckets; buckets that no key needs stay closed."""
        found = np.zeros(len(keys), bool)
        out = [np.zeros((len(keys), k), np.int64) for _, k in values]
        order, b, head = _grouped(bucket)
        for i, j in zip(head, np.append(head[1:], len(b))):
            at = order[i:j]
            where = shared.in_table(self.file(f"{table}-{b[i]}-at"), self.file(f"{table}-{b[i]}"), keys[at])
            at, where = at[where >= 0], where[where >= 0]
            found[at] = True
            for o, (name, k) in zip(out, values):
                o[at] = self.file(f"{name}-{b[i]}")[where].reshape(-1, k)
        return found, out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(place of each token among the words met, tokens per text); ``ids`` (or -1) and ``stat`` (count,
        continuation) are brought up to date, each new word being looked up once."""
        x, n = self.places.tokens(texts)
        if self.places.turn != self.turn:
            self.ids, self.stat, self.turn = self.ids[:0], self.stat[:0], self.places.turn
        new = np.array(self.places.hashes[len(self.ids) :], np.uint64)
        order = np.argsort(new)
        h, ids, stat = new[order], np.full(len(new), -1, np.int64), np.zeros((len(new), 2), np.int64)
        bucket = (h >> np.uint64(64 - self.m.bits)).astype(np.int64)
        head = _heads(bucket)
        for i, j in zip(head, np.append(head[1:], len(h))):
            at = shared.find(self.file(f"word-{bucket[i]}"), h[i:j])
            hit = np.flatnonzero(at >= 0)
            to = order[i + hit]
            ids[to] = at[hit] + self.m.offsets[bucket[i]]
            for col, name in enumerate(("count", "cont")):
                a = self.file(f"{name}-{bucket[i]}")
                if len(a):
                    stat[to, col] = a[at[hit]]
        self.ids, self.stat = np.concatenate([self.ids, ids]), np.concatenate([self.stat, stat])
        return x, n

    def scores(self, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 base probability, log10 model probability, known) of each token."""
        m, stat = self.m, self.stat
        d = {k: np.array([0.0, *v]) for k, v in m.d.items()}
        kept = lambda c, k: np.maximum(c - d[k][np.minimum(c, 3)], 0)
        left = lambda s, k: s[:, 1:] @ d[k][1:]
        base = np.log10((stat[:, 0] + 0.5) / (m.n_tokens + 0.5 * (m.vocab + 1)))[x]
        p = (kept(stat[:, 1], 1) / max(m.total_word, 1) + m.floor)[x]
        w = self.ids[x]
        u = before(w, n, m.vocab)
        t = before(u, n, m.vocab)

        # pairs: the middle word's totals, then the number of words before (u, w)
        mid, to = np.unique(u, return_inverse=True)
        total = np.zeros((len(mid), 4), np.int64)
        known = np.flatnonzero(mid >= 0)
        bucket = m.place(mid[known], np.zeros(len(known), np.int64))
        order, b, head = _grouped(bucket)
        for i, j in zip(head, np.append(head[1:], len(b))):
            at = order[i:j]
            where = shared.find(self.file(f"mid-{b[i]}"), mid[known[at]])
            total[known[at[where >= 0]]] = self.file(f"midstat-{b[i]}")[where[where >= 0]].reshape(-1, 4)
        if len(m.hot):
            at = shared.find(m.hot, mid)
            total[at >= 0] = m.hot_stat[at[at >= 0]]
        rest = left(total, 2) / np.maximum(total[:, 0], 1)
        p *= np.where(total[:, 0] > 0, rest, 1.0)[to]
        has = np.flatnonzero((total[to, 0] > 0) & (w >= 0))
        _, (c,) = self.gather(m.place(u[has], w[has]), pair_key(u[has], w[has]), "pair", ("paircont", 1))
        p[has] += kept(c[:, 0], 2) / total[to[has], 0]

        # triples: contexts that occur once, or with their totals; then the counts
        ok = np.flatnonzero((t >= 0) & (u >= 0))
        key, bucket = pair_key(t[ok], u[ok]), m.place(u[ok], t[ok])
        s = np.zeros((len(ok), 4), np.int64)
        once, _ = self.gather(bucket, key, "once")
        s[once] = (1, 1, 0, 0)
        more = np.flatnonzero(~once)
        _, (s[more],) = self.gather(bucket[more], key[more], "ctx", ("ctxstat", 4))
        seen = s[:, 0] > 0
        ok, s, bucket = ok[seen], s[seen], bucket[seen]
        p[ok] *= left(s, 3) / s[:, 0]
        at = np.flatnonzero(w[ok] >= 0)
        has = ok[at]
        _, (c,) = self.gather(bucket[at], triple_key(t[has], u[has], w[has]), "triple", ("count3", 1))
        p[has] += kept(c[:, 0], 3) / s[at, 0]
        return base, np.log10(p), w >= 0


def learn(train: DataFrame, scratch: Scratch, bucket_tokens: int = 4_000_000) -> Model:
    """Counts ``train(doc_id, text)`` into a model in the shared folder."""
    base = shared.folder(scratch, "model")
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, int(size / 6 / bucket_tokens).bit_length())
    n_buckets, hot_tokens = 1 << bits, max(1, bucket_tokens // 4)
    texts = train.select("text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, count = Places(), np.empty(0, np.int64)

        def flush():
            k, c = _merged(np.array(places.hashes, np.uint64), count)
            yield from _rows((k >> np.uint64(64 - bits)).astype(np.int32), 0, [(k >> np.uint64(32)).astype(np.uint32), k.astype(np.uint32), c])

        for b in batches:
            for part in slices(b):
                if len(places.hashes) > 300_000:  # before they are forgotten
                    yield from flush()
                    count = count[:0]
                x, _ = places.tokens(rows_of(part, "text"))
                now = np.bincount(x, minlength=len(places.hashes))
                now[: len(count)] += count
                count = now
        if len(count):
            yield from flush()

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, kinds in one_at_a_time(batches, 3):
            high, low, c = kinds[0]
            k, c = _merged((high.astype(np.uint64) << np.uint64(32)) | low, c)
            shared.put(base, f"word-{b}", k)
            shared.put(base, f"count-{b}", _small(c))
            often = np.flatnonzero(c > hot_tokens)
            cols = [pa.array([b], pa.int32()), pa.array([len(k)]), pa.array([int(c.sum())]), pa.array([often.tolist()], pa.list_(pa.int64())), pa.array([c[often].tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "n", "total", "often", "times"])

    sizes, n_tokens, often = np.zeros(n_buckets, np.int64), 0, []
    found = dealt(texts.transform(arrow(words, PACKED)), n_buckets).transform(arrow(vocabulary, "bucket int, n long, total long, often array<long>, times array<long>"))
    for b, n, total, at, times in found.collect():  # one row a bucket, and a number for each hot_tokens tokens at most
        sizes[b] = n
        n_tokens += total
        often += [(b, i, c) for i, c in zip(at, times)]
    vocab, offsets = int(sizes.sum()), np.cumsum(sizes) - sizes
    often = [(int(offsets[b] + i), c) for b, i, c in often]
    n_docs = train.count()
    often = sorted(often + [(vocab, n_docs)] * (n_docs > hot_tokens))
    hot = np.array([i for i, _ in often], np.int64)
    parts = np.array([-(-c // hot_tokens) for _, c in often], np.int64)
    draft = Model(base, bits, n_tokens, vocab, offsets, hot, parts, np.zeros((len(hot), 4), np.int64), {k: [0.0] * 3 for k in (1, 2, 3)}, 0, 1.0)
    if not vocab:
        return draft
    if vocab >= (1 << 32) - 1:
        raise ValueError("ids of over four billion distinct words do not fit the packed columns")

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, held, size = Lookup(draft), [], 0

        def flush():
            u, t, w, c = count_triples(*[np.concatenate(x) for x in zip(*held)])
            frequent = shared.find(hot, u.astype(np.int64)) >= 0
            for kind, at, by in ((0, np.flatnonzero(~frequent), t), (1, np.flatnonzero(frequent), t), (2, np.flatnonzero(frequent), w)):
                if len(at):
                    yield from _rows(draft.place(u[at], by[at]), kind, [u[at], t[at], w[at], c[at]])

        for b in batches:
            for part in slices(b):
                x, n = look.encode(rows_of(part, "text"))
                w = look.ids[x]
                u = before(w, n, vocab)
                held.append([a.astype(np.uint32) for a in (u, before(u, n, vocab), w, np.ones(len(w), np.uint32))])
                size += len(w)
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    span = -(-vocab // n_buckets)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, kinds in one_at_a_time(batches, 4):
            none = [np.empty(0, np.uint32)] * 4
            plain, by_t, by_w = (kinds.pop(k, none) for k in (0, 1, 2))
            u, t, w, c = count_triples(*[np.concatenate(x) for x in zip(plain, by_t)])
            key = triple_key(t, u, w)
            order = np.argsort(key)
            shared.put_table(base, f"triple-{b}", key[order])
            shared.put(base, f"count3-{b}", _small(c[order]))
            n3 = _count_of_counts(c)
            head = _heads(u, t)
            stat, key = _by_size(c, head), pair_key(t[head], u[head])
            order = np.argsort(key)
            stat, key = stat[order], key[order]
            once = stat[:, 0] == 1
            shared.put_table(base, f"once-{b}", key[once])
            shared.put_table(base, f"ctx-{b}", key[~once])
            shared.put(base, f"ctxstat-{b}", _small(stat[~once]))
            del t, c, key, order, stat, once

            frequent = shared.find(hot, u.astype(np.int64)) >= 0
            u2, _, w2, _ = count_triples(*by_w) if len(by_w[0]) else none
            pair, cont = _merged(np.concatenate([(a.astype(np.uint64) << np.uint64(32)) | z for a, z in ((u[~frequent], w[~frequent]), (u2, w2))]), np.ones(int((~frequent).sum()) + len(u2), np.uint32))
            u, w = (pair >> np.uint64(32)).astype(np.uint32), pair.astype(np.uint32)
            key = pair_key(u, w)
            order = np.argsort(key)
            shared.put_table(base, f"pair-{b}", key[order])
            shared.put(base, f"paircont-{b}", _small(cont[order]))
            head = _heads(u)
            stat, mid = _by_size(cont, head), u[head].astype(np.int64)
            at = shared.find(hot, mid)
            shared.put(base, f"mid-{b}", mid[at < 0])
            shared.put(base, f"midstat-{b}", _small(stat[at < 0]))
            note = [n3, _count_of_counts(cont), at[at >= 0].tolist(), stat[at >= 0].ravel().tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([b""]), *[pa.array([x], pa.list_(pa.int64())) for x in note]], names=["bucket", "kind", "a", "n3", "n2", "hot", "stat"])
            seen, times = np.unique(w, return_counts=True)
            for r in _rows((seen // np.uint32(span)).astype(np.int32), 0, [seen, times]):
                yield pa.RecordBatch.from_arrays([*r.columns, *[pa.array([None], pa.list_(pa.int64()))] * 4], names=["bucket", "kind", "a", "n3", "n2", "hot", "stat"])

    notes = dealt(texts.transform(arrow(triples, PACKED)), n_buckets).transform(arrow(buckets, PACKED + ", n3 array<long>, n2 array<long>, hot array<long>, stat array<long>"))
    notes = scratch.keep(notes, "continuations")
    n3, n2, hot_stat = np.zeros(4, np.int64), np.zeros(4, np.int64), np.zeros((len(hot), 4), np.int64)
    for r in notes.filter("bucket < 0").select("n3", "n2", "hot", "stat").collect():  # one row a bucket, with the frequent words' parts in it
        n3 += r.n3
        n2 += r.n2
        np.add.at(hot_stat, np.array(r.hot, np.int64), np.array(r.stat, np.int64).reshape(-1, 4))

    def continuations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, kinds in one_at_a_time(batches, 2):
            w, times = kinds[0]
            n = np.bincount(w.astype(np.int64) - r * span, weights=times, minlength=min(span, vocab - r * span)).astype(np.int64)
            shared.put(base, f"range-{r}", _small(n))
            yield pa.RecordBatch.from_arrays([pa.array([_count_of_counts(n)], pa.list_(pa.int64())), pa.array([int(n.sum())]), pa.array([int((n > 2).sum())])], names=["n", "total", "more"])

    n1, total_word, more = np.zeros(4, np.int64), 0, 0
    ranges = dealt(notes.filter("bucket >= 0").select("bucket", "kind", "a"), n_buckets).transform(arrow(continuations, "n array<long>, total long, more long"))
    for n, total, m in ranges.collect():  # one row a range
        n1 += np.array(n)
        total_word += total
        more += m
    scratch.drop("continuations")

    # continuation counts under the vocabulary's buckets, so that both are read by the same offsets
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                lo, hi = int(offsets[k]), int(offsets[k] + sizes[k])
                parts = [np.empty(0, np.uint8)]
                for r in range(lo // span, -(-hi // span)):
                    a = shared.get(base, f"range-{r}") if shared.has(base, f"range-{r}") else np.zeros(span, np.uint8)
                    parts.append(a[max(lo - r * span, 0) : hi - r * span])
                shared.put(base, f"cont-{k}", np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64())], names=["id"])

    train.sparkSession.range(0, n_buckets, 1, min(n_buckets, 64)).transform(arrow(aligned, "id long")).count()
    d = {k: discounts(*map(int, n)) for k, n in ((1, n1), (2, n2), (3, n3))}
    left = d[1][0] * int(n1[0]) + d[1][1] * int(n1[1]) + d[1][2] * more
    return dataclasses.replace(draft, d=d, hot_stat=hot_stat, total_word=int(total_word), floor=left / total_word / (vocab + 1))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(model)
        for b in batches:
            for part in slices(b, SCORED):
                x, n = look.encode(rows_of(part, "text"))
                base, p, known = look.scores(x, n)
                at = np.cumsum(n) - n
                cols = [part.column(0), pa.array(n), *[pa.array(np.add.reduceat(a, at)) for a in (known.astype(np.int64), base, p)]]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs_view(docs).transform(arrow(run, f"doc_id {id_kind(docs)}, n_tokens long, n_known long, base_score double, score double"))
