"""Narrative reviews by a backend that the caller gives: any function from two prompts to a text.

Nothing is called over a network from here. Each repository's prompts go through the backend once, on the executors; a
failure or an empty answer leaves a null narrative and says why, and the other repositories go on.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Backend = Callable[[str, str], str]


def backend_of(name: str) -> Backend:
    """The function that "module:function" names."""
    module, _, function = name.partition(":")
    found = getattr(importlib.import_module(module), function, None) if module and function else None
    if not callable(found):
        raise ValueError(f"{name!r} isn't module:function of a backend")
    return found


def narrated(prompts: DataFrame, backend: Backend, name: str = "custom") -> DataFrame:
    """repo, narrative, meta (JSON: backend, characters asked and answered, failure) of prompts (repo, system, user)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str | None, str]] = []
            for system, user in zip(b.column("system").to_pylist(), b.column("user").to_pylist(), strict=True):
                said, failure = None, None
                try:
                    said = backend(system, user)
                    if not isinstance(said, str) or not said.strip():
                        said, failure = None, "the answer is empty"
                except Exception as e:  # noqa: BLE001 - a backend may fail in any way
                    failure = f"{type(e).__name__}: {e}"
                asked = len(system or "") + len(user or "")
                out.append((said, json.dumps({"answered": len(said or ""), "asked": asked, "backend": name, "failure": failure}, sort_keys=True)))
            yield pa.RecordBatch.from_arrays([b.column("repo"), pa.array([n for n, _ in out], pa.string()), pa.array([m for _, m in out], pa.string())], ["repo", "narrative", "meta"])

    return prompts.select("repo", "system", "user").mapInArrow(run, "repo string, narrative string, meta string")
