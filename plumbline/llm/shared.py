"""Arrays in the shared folder: written once by a task, renamed into place, memory-mapped by others.

The folder in spark.checkpoint.dir must be mounted where executors run (a file:// path). A retried or
speculative task writes the same bytes under another temporary name, so a lost executor does no harm.
"""

from __future__ import annotations

import mmap
import os
import uuid

import numpy as np

from plumbline.llm.common import Scratch


def folder(scratch: Scratch, name: str) -> str:
    path = f"{scratch.path}/{name}"
    if not path.startswith(("file:", "/")):
        raise RuntimeError(f"memory-mapped arrays need a mounted shared folder; spark.checkpoint.dir gives {path}")
    return "/" + path.removeprefix("file:").lstrip("/")


def put(base: str, name: str, a: np.ndarray) -> None:
    os.makedirs(base, exist_ok=True)
    tmp = f"{base}/.{name}.{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        np.save(f, a)
    os.replace(tmp, f"{base}/{name}.npy")


def get(base: str, name: str, mapped: bool = True) -> np.ndarray:
    """The array; mapped without keeping its file open, so that any number of arrays may be mapped at once."""
    path = f"{base}/{name}.npy"
    if not mapped:
        return np.load(path)
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, _, kind = read(f)
        n = int(np.prod(shape))
        if not n:
            return np.empty(shape, kind)
        at = f.tell()
        m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    return np.frombuffer(m, kind, n, at).reshape(shape)


def part(base: str, name: str, lo: int, hi: int) -> np.ndarray:
    """Bytes lo to hi - 1 of an array of bytes, read alone: maps of whole files would count as a task's memory."""
    with open(f"{base}/{name}.npy", "rb", buffering=0) as f:
        head = f.read(10)
        f.seek(10 + int.from_bytes(head[8:10], "little") + lo)  # the header's length, as np.save writes it
        return np.frombuffer(f.read(hi - lo), np.uint8)


def has(base: str, name: str) -> bool:
    return os.path.exists(f"{base}/{name}.npy")


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value in the sorted ``keys``, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    i = np.searchsorted(keys, wanted)
    i[i == len(keys)] = 0
    return np.where(keys[i] == wanted, i, -1)


def put_table(base: str, name: str, keys: np.ndarray) -> None:
    """Sorted 64-bit hashes in cells of about 32 by their top bits, 32 further bits kept of each: see ``in_table``."""
    bits = max(1, (len(keys) // 32).bit_length())
    edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    put(base, f"{name}-at", edges.astype(np.uint32 if len(keys) < 1 << 32 else np.uint64))
    put(base, name, (keys >> np.uint64(32 - bits)).astype(np.uint32))


def in_table(edges: np.ndarray, low: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each hash in a table, or -1. About 32 + log2(n / 32) bits are compared, so that an absent hash
    passes for a present one about once in 2^27 times whatever the table's size."""
    if not len(low):
        return np.full(len(wanted), -1, np.int64)
    bits = int(len(edges) - 1).bit_length() - 1
    cell = (wanted >> np.uint64(64 - bits)).astype(np.int64)
    v = (wanted >> np.uint64(32 - bits)).astype(np.uint32)
    lo, end = edges[cell].astype(np.int64), edges[cell + 1].astype(np.int64)
    for k in reversed(range(int((end - lo).max(initial=0)).bit_length())):
        probe = lo + ((1 << k) - 1)
        less = np.take(low, probe, mode="clip") < v
        less &= probe < end
        lo += less.astype(np.int64) << k
    at = np.minimum(lo, len(low) - 1)
    return np.where((lo < end) & (low[at] == v), at, -1)
