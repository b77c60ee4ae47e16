"""Several queries at once: named batches, counts fused into one scan a model, sequential read transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError, UnsupportedQuery
from ..operators import paging
from ..operators.predicates import col
from ..sources.tables import scan
from .client import METHODS, Engine

ISOLATION = ("ReadCommitted", "RepeatableRead", "Serializable")


def batch(engine: Engine, queries: dict[str, tuple[str, str, dict]]) -> dict[str, DataFrame]:
    """Independent queries (model, method, args) by name."""
    return {name: engine.query(*q) for name, q in queries.items()}


def batch_row(engine: Engine, queries: dict[str, tuple[str, str, dict]]) -> DataFrame:
    """One row with a column to each query: an array of rows for findMany and groupBy, else one row or null.

    Order is that of the query: rows are collected with their places in it and sorted by these. Each result becomes one
    value, so it has to be small: queries of many rows take ``take``, or ``batch``, which gives frames.
    """
    if not queries:
        raise QueryError("an empty batch")
    parts = []
    for name, (model, method, args) in queries.items():
        df = engine.query(model, method, args)
        row = F.struct(F.monotonically_increasing_id().alias("at"), F.struct(*[col(c) for c in df.columns]).alias("row"))
        rows = F.transform(F.array_sort(F.collect_list("__row"), lambda a, b: F.signum(a["at"] - b["at"]).cast("int")), lambda x: x["row"])
        packed = df.select(row.alias("__row")).agg(rows.alias(name))
        parts.append(packed if method in ("findMany", "groupBy") else packed.select(F.get(name, F.lit(0)).alias(name)))
    return reduce(lambda a, b: a.crossJoin(b), parts)  # of single rows


def fused_counts(engine: Engine, queries: list[tuple[str, dict]]) -> DataFrame:
    """One row with columns count_0, count_1, ...: plain counts of a model share one scan of it."""
    plain: dict[str, list[int]] = {}
    parts: list[DataFrame] = []
    for k, (model, args) in enumerate(queries):
        if set(args) <= {"where"}:
            plain.setdefault(model, []).append(k)
        else:
            parts.append(engine.query(model, "count", args).select(F.col("_count._all").alias(f"count_{k}")))
    for model, which in plain.items():
        m = engine.catalog.model(model)
        df, tests = scan(engine.tables, m), []
        for k in which:
            df, test = engine.predicates.condition(df, m, queries[k][1].get("where"), ("where",))
            tests.append(F.count_if(test).alias(f"count_{k}"))
        parts.append(df.agg(*tests))
    if not parts:
        raise QueryError("an empty batch")
    return reduce(lambda a, b: a.crossJoin(b), parts).select(*[f"count_{k}" for k in range(len(queries))])  # of single rows


def batch_count(engine: Engine, queries: list[dict]) -> list[int]:
    """Counts of [{model, method: "count", args}], in order."""
    for k, q in enumerate(queries):
        if q.get("method", "count") != "count":
            raise UnsupportedQuery("a count batch has counts only", (k,))
        paging.take_of(q.get("args") or {}, negative=False)
    return list(fused_counts(engine, [(q["model"], q.get("args") or {}) for q in queries]).first()) if queries else []


def transaction(engine: Engine, queries: list[dict], isolation: str | None = None, timeout: float | None = None) -> list[list]:
    """Runs reads one after the other over the same files and gives their rows; ``timeout``: seconds for all.

    Parquet files don't change, so every isolation level reads one snapshot.
    """
    import threading

    if isolation is not None and isolation not in ISOLATION:
        raise QueryError(f"isolation is one of {', '.join(ISOLATION)}")
    for k, q in enumerate(queries):
        if q.get("method") not in METHODS:
            raise UnsupportedQuery(f"a transaction reads; {q.get('method')} does not", (k,))
    context = engine.spark.sparkContext
    group = f"lattiq-{id(queries)}"
    timer = threading.Timer(timeout, context.cancelJobGroup, [group]) if timeout else None
    if timer:
        context.setJobGroup(group, "read transaction", interruptOnCancel=True)
        timer.start()
    try:
        return [engine.query(q["model"], q["method"], q.get("args")).collect() for q in queries]
    finally:
        if timer:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
