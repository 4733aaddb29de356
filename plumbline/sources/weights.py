"""Model weights on the executors (S18): a file is distributed once, checked by digest, and loaded once a Python worker."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark import SparkFiles
from pyspark.sql import SparkSession

_LOADED: dict[tuple[str, str], Any] = {}


def digest_of(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


@dataclass(frozen=True)
class Weights:
    """A published file: the name it has on the executors, and its sha256."""

    name: str
    digest: str

    def local(self) -> str:
        """The file's place on this executor; a copy that isn't the published one is an error."""
        path = SparkFiles.get(self.name)
        if (got := digest_of(path)) != self.digest:
            raise ValueError(f"{self.name} has digest {got} here, not {self.digest}")
        return path

    def load(self, parse: Callable[[str], Any]) -> Any:
        """``parse`` of the file, kept by this worker for the tasks that follow."""
        from plumbline.sources.weights import _LOADED as loaded  # the worker's own module: a class sent along has globals of its own

        key = (self.digest, f"{parse.__module__}.{parse.__qualname__}")
        if key not in loaded:
            loaded[key] = parse(self.local())
        return loaded[key]


def publish(spark: SparkSession, path: str, sha256: str | None = None) -> Weights:
    """Hands a checkpoint of the driver to all executors, which fetch it once each.

    A missing file, or one that isn't ``sha256``, raises here, before any task starts. The name on the executors
    begins with the digest, so a file that changed is another file.
    """
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no checkpoint at {path}")
    digest = digest_of(path)
    if sha256 and digest != sha256.lower():
        raise ValueError(f"{path} has digest {digest}, not {sha256}")
    name = f"{digest[:24]}-{os.path.basename(path)}"
    if not any(f.endswith(f"/{name}") for f in spark.sparkContext.listFiles):
        copy = os.path.join(tempfile.mkdtemp(prefix="plumbline-weights-"), name)  # served by the driver, not read by executors
        shutil.copyfile(path, copy)
        spark.sparkContext.addFile(copy)
    return Weights(name, digest)
