"""YAML configuration (S13, T19): environment variables and ``~`` expanded, relative paths under the root."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

import yaml

PLACEHOLDER = "EDIT-ME"


def load_env(path: Path) -> None:
    """KEY=VALUE lines; what is already set wins."""
    if path.exists():
        for line in path.read_text().splitlines():
            k, eq, v = line.partition("=")
            if eq and not k.lstrip().startswith("#"):
                os.environ.setdefault(k.strip(), v.strip().strip("\"'"))


def load_config(path: str | os.PathLike, root: str | os.PathLike | None = None) -> dict:
    """Placeholders are refused before paths are resolved, where they can still be told apart."""
    path = Path(path)
    root = Path(root or path.parent)
    load_env(root / ".env")
    cfg = yaml.safe_load(path.read_text()) or {}
    for k, v in (cfg.get("paths") or {}).items():
        if v is None or PLACEHOLDER in str(v):
            cfg["paths"][k] = None
            continue
        p = Path(os.path.expandvars(str(v))).expanduser()
        cfg["paths"][k] = str(p if p.is_absolute() else root / p)
    return cfg


def config_digest(cfg: dict) -> str:
    """Names a cached result, so that a stale one is never reused."""
    return hashlib.sha256(json.dumps(cfg, sort_keys=True, default=str).encode()).hexdigest()[:16]
