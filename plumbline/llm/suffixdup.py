"""Exact removal of repeated byte strings by blockwise suffix sorting over a difference cover.

A byte goes if it lies in a ``length``-byte string that also starts elsewhere, in any text. Let v and D be a
difference cover: any two positions have an offset d < v at which both, moved by d, fall on positions whose
residue modulo v is in D. So two equal strings share a cover position with the same offset in both, and
from there at least length - v + 1 equal bytes. That bounds what must be sorted:

1. Cover sample: the names (64-bit hashes) of the strings of length - v + 1 bytes at cover positions, a tenth
   of all, are dealt to buckets by name, and each bucket is sorted alone. A position whose name is unique
   proves that no string around it repeats; only repeated names, ranks of the cover sample, go on.
2. Long ties: at those positions the whole neighbourhood (v - 1 bytes before, length after) is named and
   sorted within the rank. Equal neighbourhoods are resolved at once: all strings inside repeat. Of each
   distinct neighbourhood whose rank has unresolved members, one representative remains.
3. Suffix buckets: only the strings near unresolved positions and representatives are named whole, dealt to
   buckets by name, and sorted one bucket at a time.

Texts are first packed into blocks; tasks hash a block at a time, buckets hold names of the block's
positions as packed arrays, and answers are bits in the shared folder, of which the block that asked reads its own.
Memory is bounded by a block and by a bucket, whose number grows with the input; a task holds one bucket.
Strings are ordered by their names, not by their bytes: names keep 56 bits beside the bucket's, and equal names
are taken for equal strings, so one of n unlike strings in a bucket is taken for a repeat with a chance of n / 2^56. A string that a third of
all texts share gives its rank one representative per distinct neighbourhood, not one per text.

Null text has no bytes; texts shorter than ``length`` keep theirs; exact copies lose all bytes where they
are long enough; repeated rows are copies; an empty table gives an empty result. Ids are whole numbers or null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared
from plumbline.llm.common import Scratch, arrow, dealt, docs_view

#: Positions that are hashed at a time.
SLICE = 1 << 16
#: Row groups and pages of the blocks' table end after each block that fills them; by default Parquet looks only after
#: 100 rows, so that a task held all its texts in one page.
SMALL_GROUPS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
_MIX1, _MIX2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def difference_cover(v: int) -> np.ndarray:
    """A small set of residues whose differences give every residue: a run and a stride, by Colbourn and Ling's idea.

    {0..r-1} and the multiples of r up to v cover all differences; r near the square root of v / 2 keeps it
    small. Greedy removal of residues that aren't needed then thins it.
    """
    r = max(1, round((v / 2) ** 0.5))
    cover = sorted(set(range(r + 1)) | set(range(0, v // 2 + r + 1, r)))

    def covers(c: list[int]) -> bool:
        a = np.array(c)
        return len(np.unique((a[:, None] - a[None, :]) % v)) == v

    assert covers(cover)
    for x in sorted(cover, reverse=True):
        rest = [y for y in cover if y != x]
        if covers(rest):
            cover = rest
    return np.array(cover)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class Names:
    """Prefix sums of a block; the name of any of its substrings is a difference, moved to the origin."""

    _codes = np.random.default_rng(20240229).integers(0, (1 << 64) - 1, 256, dtype=np.uint64)
    _power = _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        cls = type(self)
        if len(cls._power) <= n:
            cls._power, cls._inverse = (np.full(n + 1, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
            for x in (cls._power, cls._inverse):
                x[0] = 1
                np.cumprod(x, out=x)
        self.sums = np.zeros(n + 1, np.uint64)
        for i in range(0, n, SLICE):
            j = min(i + SLICE, n)
            np.cumsum(self._codes[data[i:j]] * self._power[i:j], out=self.sums[i + 1 : j + 1])
            self.sums[i + 1 : j + 1] += self.sums[i]

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        for i in range(0, len(start), SLICE):
            s = start[i : i + SLICE]
            out[i : i + SLICE] = _mixed((self.sums[s + length] - self.sums[s]) * self._inverse[s])
        return out


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(g, ids, sizes, data): texts packed in the order a task reads them; one text is never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        ids, parts, held = [], [], 0

        def out():
            g = (task << 32) + k
            return pa.RecordBatch.from_arrays(
                [pa.array([g]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())), pa.array([b"".join(parts)], pa.binary())],
                names=["g", "ids", "sizes", "data"],
            )

        for b in batches:
            for i in range(0, len(b), 64):
                s = b.slice(i, 64)
                for d, t in zip(s.column(0).to_pylist(), s.column(1).to_pylist()):
                    p = (t or "").encode("utf-8", "surrogatepass")
                    ids.append(d)
                    parts.append(p)
                    held += len(p)
                    if held >= block_bytes:
                        yield out()
                        ids, parts, held, k = [], [], 0, k + 1
        if ids:
            yield out()

    return docs_view(docs).transform(arrow(run, "g long, ids array<long>, sizes array<long>, data binary"))


class Block:
    """A block's texts with each byte's distance to its text's start and end."""

    def __init__(self, sizes: list[int], data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        self.sizes = np.array(sizes, np.int64)
        self.stop = np.cumsum(self.sizes)
        self.start = self.stop - self.sizes

    def cover(self, v: int, d: np.ndarray, need: int) -> np.ndarray:
        """Positions whose residue within their text is in the cover and which have ``need`` bytes ahead."""
        out = [s + np.add.outer(np.arange(0, n - need + 1, v), d).ravel() for s, n in zip(self.start, self.sizes) if n >= need]
        if not out:
            return np.empty(0, np.int64)
        p = np.concatenate(out)
        return p[p + need <= self.stop[self.owner(p)]]

    def owner(self, p: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.stop, p, side="right")


def _deal(g: int, names: list[np.ndarray], bits: int) -> tuple[np.ndarray, pa.RecordBatch | None]:
    """(order, rows): rows (bucket, g, packed arrays) dealt by the first array's top bits; 7 bytes of it remain."""
    bucket = (names[0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(names[0]), np.int64)
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    if not len(b):
        return order, None
    head = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    tail = np.append(head[1:], len(b))
    cols = [pa.array(b[head].astype(np.int32)), pa.array(np.full(len(head), g))]
    for a in names:
        raw = np.ascontiguousarray(a[order]).view(np.uint8).reshape(-1, 8)[:, :7]
        cols.append(pa.array([raw[i:j].tobytes() for i, j in zip(head, tail)], pa.binary()))
    return order, pa.RecordBatch.from_arrays(cols, names=["bucket", "g", *"ab"[: len(names)]])


def _unpack(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 7)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :7] = raw
    return out.view(np.uint64).ravel()


def _repeated(x: np.ndarray) -> np.ndarray:
    """Whether each value occurs twice or more."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(x), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _ties(rank: np.ndarray, hood: np.ndarray) -> np.ndarray:
    """Per position: 1 if its neighbourhood repeats within its rank, 2 if it must go on to the suffix buckets.

    ``hood`` 0 stands for a neighbourhood that its text cuts off, which is equal to no other.
    """
    order = np.lexsort((hood, rank))
    r, h = rank[order], hood[order]
    same = (r[1:] == r[:-1]) & (h[1:] == h[:-1]) & (h[1:] != 0)
    solved = np.zeros(len(r), bool)
    solved[1:] |= same
    solved[:-1] |= same
    first = np.append(True, ~same) if len(r) else np.empty(0, bool)  # of each distinct neighbourhood
    head = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.empty(0, np.int64)
    open_ = np.repeat(np.logical_or.reduceat(~solved, head), np.diff(np.append(head, len(r)))) if len(r) else np.empty(0, bool)
    code = solved.astype(np.uint8) | ((open_ & first).astype(np.uint8) << 1)
    out = np.empty(len(r), np.uint8)
    out[order] = code
    return out


def _answer(base: str, step: str, judge, n_arrays: int):
    """Buckets one at a time, from rows sorted by bucket and g: judged, and the answers written by block."""

    def whole(bucket: int, gs: list[int], parts: list[list[bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(p) // 7 for p in parts[0]])
        arrays = []
        while parts:  # each packed form goes as soon as it is open
            arrays.append(_unpack(parts.pop(0)))
        code = judge(*arrays).astype(np.uint8)
        shared.put(base, f"{step}-{bucket}-g", np.array(gs, np.int64))
        shared.put(base, f"{step}-{bucket}-at", np.append(0, np.cumsum(sizes)))
        shared.put(base, f"{step}-{bucket}", np.packbits(np.unpackbits(code[:, None], axis=1, bitorder="little")[:, :2].ravel(), bitorder="little"))
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(code)])], names=["bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gs, parts = None, [], []
        for b in batches:
            for i, (bucket, g) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if bucket != at:
                    if gs:
                        yield whole(at, gs, parts)
                    at, gs, parts = bucket, [], [[] for _ in range(n_arrays)]
                gs.append(g)
                for k in range(n_arrays):
                    parts[k].append(b.column(2 + k)[i].as_py())
        if gs:
            yield whole(at, gs, parts)

    return run


def _answers(base: str, step: str, g: int, names: np.ndarray, bits: int, files: dict) -> np.ndarray:
    """The codes for a block's names, in their own order."""
    bucket = (names >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(names), np.int64)
    order = np.argsort(bucket, kind="stable")
    got = []
    for k in np.unique(bucket):
        key = f"{step}-{k}"
        if key not in files or files[key][0] != g >> 32:  # of each bucket the places of the blocks that one task packed
            gs, at = (shared.get(base, f"{key}-{x}", mapped=False) for x in ("g", "at"))
            lo, hi = np.searchsorted(gs, [g >> 32 << 32, (g >> 32) + 1 << 32])
            files[key] = (g >> 32, gs[lo:hi].copy(), at[lo : hi + 1].copy())
        _, gs, at = files[key]
        i = int(np.searchsorted(gs, g))
        a, z = int(at[i]), int(at[i + 1])
        lo, hi = a // 4, -(-z // 4)
        two = np.unpackbits(shared.part(base, key, lo, hi), bitorder="little").reshape(-1, 2)[a - lo * 4 : z - lo * 4]
        got.append(two[:, 0] | (two[:, 1] << 1))
    out = np.zeros(len(names), np.uint8)
    if got:
        out[order] = np.concatenate(got)
    return out


def deduplicate(docs: DataFrame, length: int = 200, v: int = 133, block_bytes: int = 4 << 20, bucket_bytes: int = 48 << 20, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept BINARY]) of every row."""
    v = min(v, max(1, length // 2))
    d, need, reach = difference_cover(v), length - v + 1, v - 1
    scratch = Scratch(docs.sparkSession, "suffix")
    base = shared.folder(scratch, "answers")
    packed = scratch.keep(blocks(docs, block_bytes), "blocks", **SMALL_GROUPS)
    total = packed.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    bits = max(2, int(total * len(d) / v * 7 * 3 / bucket_bytes).bit_length())  # sorting takes about three times a bucket
    n = 1 << bits

    def sampled(block: Block, names: Names, g: int, files: dict):
        """Cover positions with repeated names, their ranks and neighbourhoods."""
        p = block.cover(v, d, need)
        rank = names.at(p, need)
        p, rank = (x[_answers(base, "sample", g, rank, bits, files) > 0] for x in (p, rank))
        own = block.owner(p)
        whole = (p - reach >= block.start[own]) & (p + length <= block.stop[own])
        hood = np.zeros(len(p), np.uint64)
        hood[whole] = names.at(p[whole] - reach, length + reach) | np.uint64(1 << 55)  # never 0 in the seven bytes kept
        return p, rank, hood, whole

    def near(block: Block, p: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Starts of the strings around the positions that go on, each once."""
        edge = np.zeros(len(block.data) + 1, np.int32)
        at = p[code >= 2]
        own = block.owner(at)
        lo, hi = np.maximum(at - reach, block.start[own]), np.minimum(at, block.stop[own] - length) + 1
        ok = lo < hi
        np.add.at(edge, lo[ok], 1)
        np.add.at(edge, hi[ok], -1)
        return np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int32) > 0)

    def step(which: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files: dict = {}
            for b in batches:
                for i in range(len(b)):
                    g, _, sizes, data = (c[i].as_py() for c in b.columns)
                    block = Block(sizes, data)
                    names = Names(block.data)
                    if which == "sample":
                        _, out = _deal(g, [names.at(block.cover(v, d, need), need)], bits)
                    else:
                        p, rank, hood, _ = sampled(block, names, g, files)
                        if which == "tie":
                            _, out = _deal(g, [rank, hood], bits)
                        else:
                            code = _answers(base, "tie", g, rank, bits, files)
                            _, out = _deal(g, [names.at(near(block, p, code), length)], bits)
                    if out is not None:
                        yield out

        return run

    for which, arrays, judge in (("sample", 1, _repeated), ("tie", 2, _ties), ("suffix", 1, _repeated)):
        cols = "bucket int, g long, a binary" + ", b binary" * (arrays > 1)
        packed.transform(arrow(step(which), cols)).transform(lambda x: dealt(x, n, "g")).transform(arrow(_answer(base, which, judge, arrays), "bucket int, n long")).agg(F.sum("n")).collect()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for b in batches:
            for i in range(len(b)):
                g, ids, sizes, data = (c[i].as_py() for c in b.columns)
                block = Block(sizes, data)
                names = Names(block.data)
                p, rank, _, whole = sampled(block, names, g, files)
                code = _answers(base, "tie", g, rank, bits, files)
                s = near(block, p, code)
                s = s[_answers(base, "suffix", g, names.at(s, length), bits, files) > 0]
                edge = np.zeros(len(block.data) + 1, np.int32)
                solved = p[(code & 1 > 0) & whole]
                for lo, hi in ((solved - reach, solved + length), (s, s + length)):
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, hi, -1)
                gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
                rows = []
                for x, a, z in zip(ids, block.start, block.stop):
                    m = gone[a:z]
                    kept = block.data[a:z][~m].tobytes()
                    spans = int(m[0]) + int((m[1:] & ~m[:-1]).sum()) if len(m) else 0
                    rows.append((x, z - a, int(m.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                cols = list(zip(*rows))
                types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(types)])

    return packed.transform(arrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text))
