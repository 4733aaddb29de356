"""npy matrices as a data source: a reader that opens only wanted files and rows, and a writer whose tasks each write a slice.

Files are opened by path, so the folder must be one that every executor can see.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from plumbline.sources.pushdown import FILTERED, Pushed

NAME = re.compile(r"emb_layer(\d+)_(\w+)\.npy")


def matrix_name(layer: int, pooling: str) -> str:
    return f"emb_layer{layer}_{pooling}.npy"


class _Slice(InputPartition):
    def __init__(self, path: str, layer: int, pooling: str, first: int, end: int):
        self.path, self.layer, self.pooling, self.first, self.end = path, layer, pooling, first, end


class NpyReader(DataSourceReader):
    """Filters on layer and pooling choose files, those on row_idx choose rows; a file that is not chosen is not opened."""

    def __init__(self, options: dict):
        self.options, self.pushed = options, Pushed()

    def partitions(self):
        base, step = self.options["path"].removeprefix("file://"), int(self.options.get("rows", 65536))
        parts = []
        for name in sorted(os.listdir(base)):  # missing matrices are skipped
            m = NAME.fullmatch(name)
            if not m or not self.pushed.passes(layer=int(m[1]), pooling=m[2]):
                continue
            path = os.path.join(base, name)
            first, end = self.pushed.span("row_idx", 0, np.load(path, mmap_mode="r").shape[0])
            parts += [_Slice(path, int(m[1]), m[2], i, min(i + step, end)) for i in range(first, end, step)]
        return parts or [_Slice("", 0, "", 0, 0)]

    def read(self, part):
        if not part.path:
            return
        block = np.ascontiguousarray(np.load(part.path, mmap_mode="r")[part.first : part.end], np.float32)
        n, dim = block.shape
        vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(block.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first, part.end)), pa.array(np.full(n, part.layer, np.int32)), pa.array([part.pooling] * n), vec], names=["row_idx", "layer", "pooling", "vec"])


class FilteredNpyReader(NpyReader):
    def pushFilters(self, filters):
        yield from self.pushed.take(filters, ("layer", "pooling"), also=("row_idx",))


@dataclass
class Written(WriterCommitMessage):
    rows: dict[str, int]


class NpyWriter(DataSourceArrowWriter):
    """Tasks write their rows at the rows' own places of one hidden file a matrix; the commit adds the header and renames it.

    A row's place follows from row_idx, so a retried or speculative task writes the same bytes again. Until the
    commit no file has a matrix's name; an abort removes the hidden ones. Rows must come sorted by matrix and row_idx.
    """

    def __init__(self, options: dict):
        self.base = options["path"].removeprefix("file://")
        self.shapes = {k: tuple(v) for k, v in json.loads(options["shapes"]).items()}
        self.token = uuid.uuid4().hex
        os.makedirs(self.base, exist_ok=True)

    def header(self, name: str) -> bytes:
        out = io.BytesIO()
        np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": self.shapes[name]})
        return out.getvalue()

    def hidden(self, name: str) -> str:
        return os.path.join(self.base, f".{name}.{self.token}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        rows: dict[str, int] = {}
        last = None
        with contextlib.ExitStack() as files:
            handles: dict[str, tuple[int, int]] = {}
            for b in iterator:
                layer, pooling, at = (b.column(b.schema.get_field_index(c)) for c in ("layer", "pooling", "row_idx"))
                names = [matrix_name(x, p) for x, p in zip(layer.to_pylist(), pooling.to_pylist())]
                at, vec = at.to_numpy(), b.column(b.schema.get_field_index("vec"))
                edge = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1] or at[i] != at[i - 1] + 1), len(names)]
                for a, z in zip(edge, edge[1:]):
                    if a == z:
                        continue
                    name = names[a]
                    n, dim = self.shapes[name]
                    if last is not None and last[0] == name and at[a] <= last[1]:
                        raise ValueError(f"{name}: row {at[a]} comes twice or out of order")
                    if at[a] < 0 or at[z - 1] >= n:
                        raise ValueError(f"{name}: rows {at[a]}..{at[z - 1]} lie outside 0..{n - 1}")
                    part = vec.slice(a, z - a)
                    if part.null_count or pc.unique(pc.list_value_length(part)).to_pylist() != [dim]:
                        raise ValueError(f"{name}: a vector is missing or has another length than {dim}")
                    if name not in handles:
                        fd = os.open(self.hidden(name), os.O_RDWR | os.O_CREAT, 0o644)
                        files.callback(os.close, fd)
                        handles[name] = fd, len(self.header(name))
                    fd, start = handles[name]
                    data, to = memoryview(part.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()), start + int(at[a]) * dim * 4
                    while len(data):
                        done = os.pwrite(fd, data, to)
                        data, to = data[done:], to + done
                    rows[name] = rows.get(name, 0) + z - a
                    last = name, at[z - 1]
            for fd, _ in handles.values():
                os.fsync(fd)
        return Written(rows)

    def commit(self, messages) -> None:
        for name, (n, _) in self.shapes.items():
            got = sum(m.rows.get(name, 0) for m in messages if m)
            if got != n:
                self.abort(messages)
                raise ValueError(f"{name}: {got} rows came, not {n}")
        for name, (n, dim) in self.shapes.items():
            head = self.header(name)
            with open(self.hidden(name), "r+b") as f:
                f.write(head)
                f.truncate(len(head) + n * dim * 4)
                os.fsync(f.fileno())
        for name in self.shapes:
            os.replace(self.hidden(name), os.path.join(self.base, name))

    def abort(self, messages) -> None:
        for name in self.shapes:
            with contextlib.suppress(FileNotFoundError):
                os.remove(self.hidden(name))


class NpySource(DataSource):
    """Options: path (folder); reading: rows per partition; writing: shapes (JSON, by file name)."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "row_idx long, layer int, pooling string, vec array<float>"

    def reader(self, schema):
        return (FilteredNpyReader if FILTERED in self.options else NpyReader)(dict(self.options))

    def writer(self, schema, overwrite):
        return NpyWriter(dict(self.options))
