"""Statistics of relations: how many related rows a row has."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.predicates import col
from ..sources.tables import scan
from .client import Engine


def fan_out(engine: Engine, model: str, relation: str) -> DataFrame:
    """One row: parents with children, average, maximum and quantiles of children to a parent, and coverage."""
    m = engine.catalog.model(model)
    r = m.relation(relation)
    child, parent = engine.catalog.model(r.model), scan(engine.tables, m)
    keys = [f"k{i}" for i in range(len(r.child))]
    counts = scan(engine.tables, child).groupBy(*[col(c).alias(k) for c, k in zip(r.child, keys, strict=True)]).agg(F.count("*").alias("n"))
    counts = counts.where(" and ".join(f"{k} is not null" for k in keys))
    out = counts.agg(F.count("*").alias("parents"), F.avg("n").alias("average"), F.max("n").alias("maximum"), F.expr("percentile(n, 0.95)").alias("p95"), F.expr("percentile(n, 0.99)").alias("p99"))
    total = parent.agg(F.count("*").alias("total"))
    return out.crossJoin(total).withColumn("coverage", F.col("parents") / F.greatest("total", F.lit(1)))  # of single rows


def collect(engine: Engine, path: str | None = None) -> dict:
    """Statistics of all to-many relations, by model and relation; written as JSON if a path is given."""
    out: dict = {}
    for m in engine.catalog.models.values():
        for r in m.relations.values():
            if r.many:
                out.setdefault(m.name, {})[r.name] = fan_out(engine, m.name, r.name).first().asDict()
    if path:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(out, f, indent=1)
    return out


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
