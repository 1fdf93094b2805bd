"""What operators share inside Python workers and around their inputs."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_STORES: dict[str, dict] = {}


def store(owner: str) -> dict:
    """What a reused worker keeps from task to task for ``owner``. A worker that comes from
    another operator first drops what that one kept."""
    others = [name for name in _STORES if name != owner]
    if others:
        for name in others:
            del _STORES[name]
        gc.collect()
        pa.default_memory_pool().release_unused()
    return _STORES.setdefault(owner, {})


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what Python makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shielded(docs: DataFrame, *used: str, made: Iterable[str] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with every column but the ``used`` ones under a name that no operator has inside,
    without those called like a column that is ``made``; and the way back."""
    docs = docs.drop(*[c for c in made if c not in used])
    names = {c: f"passed through {i}" for i, c in enumerate(docs.columns) if c not in used}
    back = {v: k for k, v in names.items()}
    return docs.withColumnsRenamed(names), lambda out: out.withColumnsRenamed(back)
