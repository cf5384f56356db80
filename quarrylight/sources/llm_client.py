"""Summarisers: pluggable callables that answer prompts, with retries.

Nothing here opens a connection by itself; a caller passes the function that
does, or registers one.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTTP status codes worth another attempt.
TRANSIENT = {429, 500, 502, 503, 504}
ATTEMPTS, FIRST_DELAY = 3, 2.0
_registered: dict[str, Callable[[str], str]] = {}


def register_summarizer(fn: Callable[[str], str], name: str = "default") -> None:
    _registered[name] = fn


def summarizer(name: str = "default") -> Callable[[str], str]:
    if name not in _registered:
        raise ValueError(f"no summarizer '{name}' is registered")
    return _registered[name]


def choose_model(available: list[str], preferred: list[str], override: str | None = None) -> str | None:
    """The override if it is available, else the first preferred one that is."""
    if override:
        return override if override in available else None
    return next((p for p in preferred for a in available if a == p or a.startswith(p + ":")), None)


def with_retry(fn: Callable[[str], str], prompt: str, attempts: int = ATTEMPTS, delay: float = FIRST_DELAY, sleep=time.sleep) -> str:
    """Calls fn; a failure whose ``status`` is transient is tried again, after
    twice the time each time."""
    for k in range(attempts):
        try:
            return fn(prompt)
        except Exception as problem:
            if getattr(problem, "status", None) not in TRANSIENT or k == attempts - 1:
                raise
            sleep(delay * 2**k)
    raise AssertionError


def answers(batches: DataFrame, fn: Callable[[str], str], prompt: str, group: str, payload: str) -> DataFrame:
    """group, answer, error: one call a batch of payloads, on the executors. A
    batch that fails is reported and skipped."""
    lists = batches.groupBy(group).agg(F.array_sort(F.collect_list(payload)).alias("payloads"))
    kind = dict(lists.dtypes)[group]

    def run(parts):
        for part in parts:
            out, errors = [], []
            for items in part.column(1).to_pylist():
                try:
                    out.append(with_retry(fn, prompt + "\n[" + ", ".join(items) + "]"))
                    errors.append(None)
                except Exception as problem:  # noqa: BLE001
                    out.append(None)
                    errors.append(f"{type(problem).__name__}: {problem}"[:300])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), pa.array(errors, pa.string())], [group, "answer", "error"])

    return lists.mapInArrow(run, f"`{group}` {kind}, answer string, error string")
