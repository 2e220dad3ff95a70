"""Settings: defaults, then environment variables, then overrides, merged key by key."""

from __future__ import annotations

import copy
import os
from collections.abc import Mapping
from typing import Any

DEFAULTS: dict[str, Any] = {
    "window": {"type": "date", "size": 7, "stride": 1},
    "sampling": {"seed": 42, "texts_per_event": 1},
    "model": {"engine": "stub", "name": "", "limit": 8000, "max_tokens": 500, "temperature": 0.7},
    "clustering": {"cap": 10},
    "budget": {"share": 0.8, "base": 8000},
}
TASKS, WINDOWS = ("clustering", "summarization", "temporal_qa"), ("date", "sliding", "tumbling", "count", "incremental", "topic")


def merged(base: Mapping, over: Mapping) -> dict:
    """A new nested dict; neither argument changes."""
    out = copy.deepcopy(dict(base))
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else copy.deepcopy(value)
    return out


class Config:
    """Environment variables are TIDEMARK_ and the path with double underscores, as TIDEMARK_WINDOW__SIZE; values keep the default's type."""

    def __init__(self, overrides: Mapping | None = None, environ: Mapping[str, str] = os.environ) -> None:
        self.values = copy.deepcopy(DEFAULTS)
        for name, raw in environ.items():
            if name.startswith("TIDEMARK_"):
                path = name.removeprefix("TIDEMARK_").lower().replace("__", ".")
                held = self.get(path)
                self.set(path, type(held)(raw) if isinstance(held, (int, float)) and not isinstance(held, bool) else raw)
        self.values = merged(self.values, overrides or {})

    def get(self, path: str, default: Any = None) -> Any:
        at: Any = self.values
        for key in path.split("."):
            if not isinstance(at, Mapping) or key not in at:
                return default
            at = at[key]
        return at

    def set(self, path: str, value: Any) -> None:
        *parents, last = path.split(".")
        at = self.values
        for key in parents:
            at = at.setdefault(key, {})
        at[last] = value


def validate(task: str, window: str, size: int, stride: int, engine: str, engines: tuple[str, ...]) -> None:
    """Raises ValueError for what a run can't do; cumulative windows are for clustering only."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}")
    if window not in WINDOWS:
        raise ValueError(f"unknown window {window!r}")
    if window == "incremental" and task != "clustering":
        raise ValueError("incremental windows are for clustering")
    if size <= 0 or stride <= 0:
        raise ValueError("size and stride must be positive")
    if engine not in engines:
        raise ValueError(f"unknown engine {engine!r}")
