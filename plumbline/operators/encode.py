"""Images to vectors and mask records through pluggable models.

The model is opaque: any object with ``info`` and ``hidden_states(list[bytes])``. It is built once per
Python worker, and one forward pass fans out to every configured layer and pooling. A resource profile gives
the stage, and no other, a device a task; weights come from ``plumbline.sources.weights``.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.embeddings import validate_layers
from plumbline.session import cut
from plumbline.sources.weights import Weights

MATRIX = "row_idx long, figure_id string, patent_id string, figure_type string, layer int, pooling string, vec array<float>"
MASKS = "path string, masks array<struct<bbox:array<double>,area:bigint,predicted_iou:double,stability_score:double>>"


class Encoder(Protocol):
    info: dict

    def hidden_states(self, images: list[bytes], layers: list[int] | None = None) -> dict[int, np.ndarray]:
        """Layer to tokens, shaped (images, tokens, dim), of the wanted layers or all; the first n_prefix tokens aren't patches."""


class HashEncoder:
    """Deterministic stand-in for a vision model: tokens are seeded by layer, token and content."""

    def __init__(self, dim: int = 16, layers: int = 24, registers: int = 0, patches: int = 4):
        self.dim, self.patches = dim, patches
        self.info = {
            "model_name": "hash", "variant": "hash", "num_hidden_layers": layers, "hidden_dim": dim,
            "num_register_tokens": registers, "n_prefix": 1 + registers, "device": "cpu",
        }

    def hidden_states(self, images: list[bytes], layers: list[int] | None = None) -> dict[int, np.ndarray]:
        n = self.info["n_prefix"] + self.patches

        def one(b: bytes, layer: int) -> np.ndarray:
            seed = int.from_bytes(hashlib.blake2b(b, digest_size=8, salt=layer.to_bytes(8, "little")).digest(), "little")
            return np.random.default_rng(seed).standard_normal((n, self.dim), dtype=np.float32)

        return {k: np.stack([one(b, k) for b in images]) for k in (range(self.info["num_hidden_layers"] + 1) if layers is None else layers)}


def histogram_weights(path: str) -> dict[str, np.ndarray]:
    with np.load(path) as z:
        return {k: z[k] for k in z.files}


class HistogramEncoder:
    """A small frozen model with real weights: the content in ``patches`` parts, a token for each, the part's byte histogram
    times the layer's matrix ``w<layer>`` (256 x dim) of an npz checkpoint; the first token is their mean."""

    def __init__(self, weights: Weights, patches: int = 4, device: str = "cpu"):
        self.w, self.patches = weights.load(histogram_weights), patches
        dim = next(iter(self.w.values())).shape[1]
        self.info = {
            "model_name": "histogram", "variant": weights.digest[:12], "num_hidden_layers": len(self.w) - 1, "hidden_dim": dim,
            "num_register_tokens": 0, "n_prefix": 1, "device": device,
        }

    def hidden_states(self, images: list[bytes], layers: list[int] | None = None) -> dict[int, np.ndarray]:
        parts = [np.array_split(np.frombuffer(b, np.uint8), self.patches) for b in images]
        h = np.array([[np.bincount(p, minlength=256) / max(len(p), 1) for p in row] for row in parts])
        h = np.concatenate([h.mean(axis=1, keepdims=True), h], axis=1)
        return {k: (h @ self.w[f"w{k}"]).astype(np.float32) for k in (range(len(self.w)) if layers is None else layers)}


def device_profile(resource: str = "gpu", amount: float = 1.0, cpus: int = 1) -> ResourceProfile:
    """M3: a task of the stage that gets it takes ``amount`` of a device and ``cpus`` cores; other stages keep the session's."""
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cpus).resource(resource, amount)).build


def task_device(resource: str = "gpu") -> str:
    """The device that Spark gave this task, as ``cuda:<address>``; ``cpu`` where it gave none."""
    task = TaskContext.get()
    given = task.resources().get(resource) if task else None
    return f"cuda:{given.addresses[0]}" if given else "cpu"


def _built(make: Callable[..., Encoder]) -> Encoder:
    """The model, on this task's device if its maker takes one."""
    return make(device=task_device()) if "device" in inspect.signature(make).parameters else make()


def _dealt(rows: DataFrame, shards: int | list[float]) -> DataFrame:
    """Rows in contiguous shards by row_idx, equal or in the proportions given, a task each, each in order."""
    share = np.cumsum([1.0] * shards if isinstance(shards, int) else shards)
    rows = cut(rows)
    n = rows.agg(F.max("row_idx")).first()[0]
    ends = [int(round((n + 1) * x / share[-1])) for x in share[:-1]] if n is not None else []
    shard = sum((F.when(F.col("row_idx") >= e, 1).otherwise(0) for e in ends), F.lit(0)).cast("int")
    return rows.withColumn("shard", shard).repartitionById(len(share), F.col("shard")).sortWithinPartitions("row_idx").drop("shard")


def pool(tokens: np.ndarray, how: str, n_prefix: int) -> np.ndarray:
    return tokens[:, 0] if how == "cls" else tokens[:, n_prefix:].mean(axis=1)


def encode_images(
    figures: DataFrame, make: Callable[..., Encoder], layers: list[int], poolings: list[str], batch_size: int = 16,
    shards: int | list[float] | None = None, profile: ResourceProfile | None = None, num_hidden_layers: int | None = None,
) -> DataFrame:
    """T11 from (row_idx, figure_id, patent_id, figure_type, content BINARY). Empty input gives an empty frame.

    ``shards`` deals the rows to so many tasks, or to tasks in the given proportions, contiguous by row_idx (M3);
    ``profile`` is the stage's own, one device a task. ``row_idx`` keeps the order of rows, so merging is no more
    than sorting by it (``merged``). ``num_hidden_layers`` spares the driver a model of its own.
    """
    validate_layers(layers, poolings, _built(make).info["num_hidden_layers"] if num_hidden_layers is None else num_hidden_layers)
    meta = ["row_idx", "figure_id", "patent_id", "figure_type"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in frames:
            model = model or _built(make)
            for i in range(0, len(pdf), batch_size):
                part = pdf.iloc[i : i + batch_size]
                states = model.hidden_states([bytes(b or b"") for b in part["content"]], layers)
                for layer in layers:
                    for how in poolings:
                        v = pool(states[layer], how, model.info["n_prefix"]).astype(np.float32)
                        yield part[meta].assign(layer=layer, pooling=how, vec=list(v))

    rows = figures.select(*meta, "content")
    return (_dealt(rows, shards) if shards else rows).mapInPandas(run, MATRIX, profile=profile)


def merged(matrix: DataFrame, figures: DataFrame) -> DataFrame:
    """M3: the shards' rows in the figures' order; a matrix that lacks or repeats a row raises."""
    matrix = cut(matrix)
    n = figures.agg(F.count("*"), F.count_distinct("row_idx")).first()
    for r in matrix.groupBy("layer", "pooling").agg(F.count("*").alias("n"), F.count_distinct("row_idx").alias("d")).collect():  # one row a matrix
        if (r.n, r.d) != tuple(n):
            raise ValueError(f"layer {r.layer}, {r.pooling}: {r.n} rows ({r.d} different) for {n[0]} figures")
    return matrix.orderBy("layer", "pooling", "row_idx")


def mask_images(images: DataFrame, make: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """Mask records per image, largest area first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = None
        for pdf in frames:
            gen = gen or make()
            rows = [sorted(gen(bytes(b or b"")), key=lambda m: -m["area"]) for b in pdf["content"]]
            keys = ("bbox", "area", "predicted_iou", "stability_score")
            yield pd.DataFrame({"path": pdf["path"], "masks": [[{k: m[k] for k in keys} for m in r] for r in rows]})

    return images.select("path", "content").mapInPandas(run, MASKS)
