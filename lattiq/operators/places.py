"""Rows' places in an order, found without a task that sees all of them.

A bounded set of the rows' keys, always the same one for the same rows, cuts the order into buckets. A row's place is the
number of rows in the buckets before its own, which are counted, and its place in its bucket. Every row takes part; the
set only decides where the cuts are.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .ordering import Key

#: Steps of the search for a row's bucket; there are at most 2 ** STEPS buckets. Every step is a projection over the one
#: before: with many of them, plans that join the rows afterwards take long to optimize.
STEPS = 8
#: Keys that the cuts are taken from.
SAMPLE = 4096


def _runs(order: list[Key]) -> list[tuple[Column, bool]]:
    """A struct to each run of keys of one direction, and whether it descends: structs compare as the keys do, nulls least."""
    out = []
    for down, run in groupby(order, key=lambda k: k.down):
        parts = [part for k in run for part in ([k.value.isNull(), k.value] if k.first == down else [k.value])]
        out.append((F.struct(*[p.alias(f"v{i}") for i, p in enumerate(parts)]), down))
    return out


def _behind(pairs: list[tuple[Column, Column, bool]]) -> Column:
    (row, bound, down), *rest = pairs
    further = row < bound if down else row > bound
    return further | ((row == bound) & _behind(rest)) if rest else further


def bucketed(df: DataFrame, order: list[Key], unique: bool) -> DataFrame:
    """``df`` with __bucket, a number that never falls along the order; rows with equal keys share one."""
    runs = _runs(order)
    names = [f"__run{i}" for i in range(len(runs))]
    df = df.withColumns({n: run for n, (run, _) in zip(names, runs, strict=True)})
    keys = df.select(*names) if unique else df.select(*names).distinct()
    keys = keys.orderBy(F.xxhash64(*names), *names).limit(SAMPLE)
    sort = Window.orderBy(*[F.col(n).desc() if down else F.col(n).asc() for n, (_, down) in zip(names, runs, strict=True)])
    tiles = keys.select(F.ntile(2**STEPS).over(sort).alias("tile"), F.row_number().over(sort).alias("n"), F.struct(*names).alias("key"))  # few rows
    cuts = tiles.groupBy("tile").agg(F.max_by("key", "n").alias("key"))
    bounds = cuts.agg(F.sort_array(F.collect_list(F.struct("tile", "key")))).scalar()
    df = df.withColumn("__bucket", F.lit(0))
    at = F.col("__bucket")
    for step in (2**k for k in reversed(range(STEPS))):
        df = df.withColumn("__bound", F.get(bounds, at + (step - 1))["key"])  # null beyond the last
        behind = _behind([(F.col(n), F.col("__bound")[n], down) for n, (_, down) in zip(names, runs, strict=True)])
        df = df.withColumn("__bucket", F.when(behind, at + step).otherwise(at))
    return df.drop("__bound", *names)


def placed(df: DataFrame, order: list[Key], name: str, unique: bool = True) -> DataFrame:
    """``df`` in order, with each row's place from 1 on in the column ``name``.

    ``unique``: no two rows have the same keys. The rows must be the same whenever they are read. The exchange by ranges of
    buckets and the window's sort leave them in order, so there is no second sort.
    """
    rows = bucketed(df, order, unique)
    counts = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.union(df.sparkSession.range(2**STEPS).select(F.col("id").cast("int"), F.lit(0).cast("bigint")))  # all buckets
    counts = counts.groupBy(F.col("__bucket").alias("bucket")).agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.struct("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")).alias("start"))  # a row a bucket
    starts = starts.agg(F.sort_array(F.collect_list("start"))).scalar()
    within = Window.partitionBy("__bucket").orderBy(*[k.sort() for k in order])
    rows = rows.repartitionByRange("__bucket").withColumn(name, F.row_number().over(within))
    return rows.withColumn(name, F.get(starts, F.col("__bucket"))["start"] + F.col(name)).drop("__bucket")
