"""Results row by row on the driver: iteration and folds, one partition at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row

from ..plans.client import Engine


def iterate(engine: Engine, model: str, args: dict | None = None, prefetch: bool = False) -> Iterator[Row]:
    """findMany's rows in its order; the driver holds one partition at most (two with ``prefetch``)."""
    yield from engine.query(model, "findMany", args).toLocalIterator(prefetchPartitions=prefetch)


def fold(engine: Engine, model: str, args: dict | None, init: Any, on_row: Callable[[Any, Row], Any], finalize: Callable[[Any], Any] | None = None) -> Any:
    """Folds findMany's rows, one pass, in order; ``init`` may be a function that makes the start."""
    state = init() if callable(init) else init
    for row in iterate(engine, model, args):
        state = on_row(state, row)
    return finalize(state) if finalize else state


def tree_fold(df: DataFrame, zero: Any, on_row: Callable[[Any, Row], Any], merge: Callable[[Any, Any], Any], depth: int = 2) -> Any:
    """An associative fold on the executors; only partial states meet on the driver."""
    return df.rdd.treeAggregate(zero, on_row, merge, depth)
