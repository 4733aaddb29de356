"""Contrastive training of a head on frozen vectors (M4, M5, K8): NT-Xent gradients made by tasks, steps on the driver.

The head is a stack of residual blocks and a final norm; the last blocks and the norm can be trained, the rest is
frozen. An epoch deals its pairs to batches in a seeded order and drops the last, incomplete one. A step takes some
batches: each is one task's work, gradients are added in a tree of fixed shape and order, and AdamW moves the
parameters on the driver, which holds the model and never the rows. Equal seeds give equal bits, so a run that is
resumed from a checkpoint ends as the unbroken one.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.ranks import running_total
from plumbline.session import written

FAN = 16
Params = dict[str, np.ndarray]


def new_head(dim: int, blocks: int, seed: int = 42) -> Params:
    """Residual blocks ``x + tanh(x W + b) V`` that begin as the identity, and a norm with gain and shift."""
    r = np.random.default_rng(seed)
    out: Params = {}
    for i in range(blocks):
        out |= {f"block{i}.w": r.normal(0, dim**-0.5, (dim, dim)), f"block{i}.b": np.zeros(dim), f"block{i}.v": np.zeros((dim, dim))}
    return out | {"norm.gain": np.ones(dim), "norm.shift": np.zeros(dim)}


def trainable(params: Params, last_blocks: int) -> list[str]:
    """M4: names of the last blocks' and the norm's parameters; more blocks than there are raises."""
    n = sum(k.endswith(".w") for k in params)
    if not 0 <= last_blocks <= n:
        raise ValueError(f"{last_blocks} blocks are to be trained, but the head has {n}")
    return sorted(k for k in params if k.startswith("norm.") or int(k[5:].split(".")[0]) >= n - last_blocks)


def forward(params: Params, x: np.ndarray) -> tuple[np.ndarray, list]:
    """(unit vectors, what the way back needs)."""
    kept = []
    for i in range(sum(k.endswith(".w") for k in params)):
        h = np.tanh(x @ params[f"block{i}.w"] + params[f"block{i}.b"])
        kept.append((x, h))
        x = x + h @ params[f"block{i}.v"]
    centred = x - x.mean(axis=1, keepdims=True)
    sd = np.sqrt((centred**2).mean(axis=1, keepdims=True) + 1e-6)
    y = centred / sd * params["norm.gain"] + params["norm.shift"]
    size = np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    return y / size, [kept, centred / sd, sd, y, size]


def loss_and_gradient(params: Params, names: list[str], a: np.ndarray, b: np.ndarray, temperature: float) -> tuple[float, Params]:
    """NT-Xent of a batch of pairs, all views but itself against the partner, and its gradient by the named parameters."""
    x = np.stack([a, b], axis=1).reshape(2 * len(a), -1)
    z, (kept, unit, sd, y, size) = forward(params, x)
    s = z @ z.T / temperature
    np.fill_diagonal(s, -np.inf)
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    n = len(z)
    to = np.arange(n) ^ 1
    loss = -np.log(np.maximum(p[np.arange(n), to], 1e-300)).mean()
    p[np.arange(n), to] -= 1
    g = (p + p.T) @ z / (temperature * n)
    g = np.where(np.linalg.norm(y, axis=1, keepdims=True) > 1e-12, (g - z * (g * z).sum(axis=1, keepdims=True)) / size, g / size)
    grad: Params = {"norm.gain": (g * unit).sum(axis=0), "norm.shift": g.sum(axis=0)}
    g = g * params["norm.gain"]
    g = (g - g.mean(axis=1, keepdims=True) - unit * (g * unit).mean(axis=1, keepdims=True)) / sd
    least = min((int(k[5:].split(".")[0]) for k in names if k.startswith("block")), default=len(kept))
    for i in reversed(range(least, len(kept))):
        x, h = kept[i]
        back = g @ params[f"block{i}.v"].T * (1 - h * h)
        grad |= {f"block{i}.v": h.T @ g, f"block{i}.w": x.T @ back, f"block{i}.b": back.sum(axis=0)}
        g = g + back @ params[f"block{i}.w"].T
    return float(loss), {k: grad[k] for k in names}


@dataclass
class AdamW:
    """Decoupled weight decay; the state of a parameter is its two moments."""

    rate: float = 1e-3
    decay: float = 0.01
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    steps: int = 0
    first: Params = field(default_factory=dict)
    second: Params = field(default_factory=dict)

    def step(self, params: Params, grad: Params) -> None:
        self.steps += 1
        b1, b2 = self.betas
        for k, g in grad.items():
            m = self.first[k] = b1 * self.first.get(k, 0.0) + (1 - b1) * g
            v = self.second[k] = b2 * self.second.get(k, 0.0) + (1 - b2) * g * g
            moved = m / (1 - b1**self.steps) / (np.sqrt(v / (1 - b2**self.steps)) + self.eps)
            params[k] = params[k] * (1 - self.rate * self.decay) - self.rate * moved


def batches_of(pairs: DataFrame, size: int, seed: int, epoch: int) -> tuple[DataFrame, int]:
    """(batch, place, a, b) of ``pairs(anchor, a, b)`` in this epoch's seeded order, and the number of whole batches."""
    order = F.md5(F.concat_ws(":", F.col("anchor").cast("string"), F.lit(str(seed)), F.lit(str(epoch)), F.lit("batch")))
    rows = running_total(pairs.withColumns({"_h": order, "_one": F.lit(1)}), ["_h", "anchor"], "_one", "_at")
    n = pairs.count() // size
    rows = rows.select(F.floor((F.col("_at") - 1) / size).cast("int").alias("batch"), F.col("_at").alias("place"), F.col("a").cast("array<double>").alias("a"), F.col("b").cast("array<double>").alias("b"))
    return rows.filter(F.col("batch") < n), n


def _packed(grad: Params, names: list[str]) -> bytes:
    return np.concatenate([grad[k].ravel() for k in names]).tobytes()


def gradients(batches: DataFrame, params: Params, names: list[str], temperature: float, first: int, end: int) -> tuple[float, int, np.ndarray]:
    """(sum of losses, batches, sum of gradients) of the batches first to end - 1: a batch a group of rows, sums in a tree.

    The tree's shape follows from the batches' numbers, not from tasks, so the sum has the same bits at every run.
    """

    def work(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        number = None

        def out() -> pa.RecordBatch:
            a, b = (np.array([r[k] for r in held]) for k in (0, 1))
            loss, grad = loss_and_gradient(params, names, a, b, temperature)
            return pa.RecordBatch.from_arrays([pa.array([number - first], pa.int32()), pa.array([loss]), pa.array([1]), pa.array([_packed(grad, names)], pa.binary())], names=["node", "loss", "n", "g"])

        for r in some:
            for k, x, y in zip(r.column(0).to_pylist(), r.column(2).to_pylist(), r.column(3).to_pylist()):
                if k != number and held:
                    yield out()
                    held = []
                number = k
                held.append((x, y))
        if held:
            yield out()

    def add(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, loss, n, g = None, 0.0, 0, 0.0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([loss]), pa.array([n]), pa.array([g.tobytes()], pa.binary())], names=["node", "loss", "n", "g"])

        for r in some:
            for k, x, m, v in zip(*[c.to_pylist() for c in r.columns]):
                if k // FAN != node:
                    if node is not None:
                        yield out()
                    node, loss, n, g = k // FAN, 0.0, 0, 0.0
                loss, n, g = loss + x, n + m, g + np.frombuffer(v)
        if node is not None:
            yield out()

    schema, left = "node int, loss double, n long, g binary", end - first
    rows = batches.filter(F.col("batch").between(first, end - 1)).repartitionById(left, F.col("batch") - first).sortWithinPartitions("batch", "place")
    sums = rows.select("batch", "place", "a", "b").mapInArrow(work, schema)
    while left > FAN:
        left = -(-left // FAN)
        sums = sums.repartitionById(left, F.floor(F.col("node") / FAN).cast("int")).sortWithinPartitions("node").mapInArrow(add, schema)
    top = sorted(sums.collect(), key=lambda r: r.node)  # FAN rows of the model's size at most
    return sum(r.loss for r in top), sum(r.n for r in top), sum((np.frombuffer(r.g) for r in top), np.zeros(sum(params[k].size for k in names)))


def _unpacked(flat: np.ndarray, params: Params, names: list[str]) -> Params:
    cuts = np.cumsum([params[k].size for k in names])[:-1]
    return {k: part.reshape(params[k].shape) for k, part in zip(names, np.split(flat, cuts))}


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def save_checkpoint(spark: SparkSession, path: str, params: Params, optimiser: AdamW, history: list[dict], settings: dict) -> None:
    """K8: parameters, optimiser and history in one npz; written beside and renamed, so a checkpoint is whole or absent."""
    state = {f"p:{k}": v for k, v in params.items()} | {f"m:{k}": v for k, v in optimiser.first.items()} | {f"v:{k}": v for k, v in optimiser.second.items()}
    out = io.BytesIO()
    np.savez(out, **state, about=np.array(json.dumps({"steps": optimiser.steps, "history": history, "settings": settings})))
    part, fs = _path(spark, f"{path}.part")
    f = fs.create(part, True)
    f.write(bytearray(out.getvalue()))
    f.close()
    to, _ = _path(spark, path)
    fs.delete(to, False)
    if not fs.rename(part, to):
        raise OSError(f"could not rename {part} to {path}")


def load_checkpoint(spark: SparkSession, path: str) -> tuple[Params, AdamW, list[dict], dict] | None:
    """What ``save_checkpoint`` wrote, or None."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    with np.load(io.BytesIO(bytes(data))) as z:
        about = json.loads(str(z["about"]))
        params, first, second = ({k[2:]: z[k] for k in z.files if k.startswith(s)} for s in ("p:", "m:", "v:"))
    return params, AdamW(steps=about["steps"], first=first, second=second), about["history"], about["settings"]


def train(
    spark: SparkSession, pairs_of_epoch, params: Params, epochs: int, *, last_blocks: int, batch_size: int = 64, batches_per_step: int = 8, temperature: float = 0.07,
    rate: float = 1e-3, decay: float = 0.01, seed: int = 42, checkpoints: str | None = None, every: int = 1,
) -> tuple[Params, list[dict]]:
    """M5: (parameters, history of epoch, n_batches, avg_loss). ``pairs_of_epoch(epoch)`` gives (anchor, a, b).

    With ``checkpoints`` each ``every``-th epoch and the last are saved as epoch_NNN.npz and last.npz, and a run goes
    on from last.npz if one is there, under the same settings or not at all. An epoch with fewer pairs than a batch
    makes no step; its loss is NaN. Parameters that aren't trained keep their bits.
    """
    names = trainable(params, last_blocks)
    settings = {"last_blocks": last_blocks, "batch_size": batch_size, "batches_per_step": batches_per_step, "temperature": temperature, "rate": rate, "decay": decay, "seed": seed}
    params, optimiser, history = {k: v.copy() for k, v in params.items()}, AdamW(), []
    if checkpoints and (found := load_checkpoint(spark, f"{checkpoints}/last.npz")):
        params, optimiser, history, old = found
        if old != settings:
            raise ValueError(f"the checkpoint was made with {old}, not {settings}")
    optimiser.rate, optimiser.decay = rate, decay
    for epoch in range(len(history) + 1, epochs + 1):
        batches, n = batches_of(pairs_of_epoch(epoch), batch_size, seed, epoch)
        losses, seen = 0.0, 0
        batches = batches.withColumn("step", F.floor(F.col("batch") / batches_per_step).cast("int"))
        with written(batches.repartitionByRange("step").sortWithinPartitions("step"), "step") as ordered:  # a step opens the files of its folder alone
            for first in range(0, n, batches_per_step):
                loss, k, flat = gradients(ordered.filter(F.col("step") == first // batches_per_step), params, names, temperature, first, min(first + batches_per_step, n))
                optimiser.step(params, _unpacked(flat / k, params, names))
                losses, seen = losses + loss, seen + k
        history.append({"epoch": epoch, "n_batches": seen, "avg_loss": losses / seen if seen else float("nan")})
        if checkpoints and (epoch % every == 0 or epoch == epochs):
            for name in (f"epoch_{epoch:03d}.npz", "last.npz"):
                save_checkpoint(spark, f"{checkpoints}/{name}", params, optimiser, history, settings)
    return params, history


def projected(df: DataFrame, vec: str, params: Params, out: str = "z") -> DataFrame:
    """Unit vectors of the head for every row."""
    fields = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(b.schema.get_field_index(vec)).to_pylist()
            some = [i for i, v in enumerate(given) if v]
            z = dict(zip(some, forward(params, np.array([given[i] for i in some], float))[0].tolist())) if some else {}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([z.get(i) for i in range(len(given))], pa.list_(pa.float64()))], names=[*b.schema.names, out])

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields) + f", `{out}` array<double>")
