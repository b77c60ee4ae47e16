"""take, skip, cursor and distinct."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..catalog import Catalog, Model
from ..config import limits
from ..errors import QueryError
from ..functions.values import count_of, literal
from .ordering import Key, with_tiebreak
from .places import placed
from .predicates import col


def take_of(args: dict, negative: bool = True) -> int | None:
    if args.get("take") is None:
        return None
    return count_of(args["take"], "take", ("take",), limits().negative_take if negative else 0, limits().limit_offset)


def skip_of(args: dict) -> int:
    return 0 if args.get("skip") is None else count_of(args["skip"], "skip", ("skip",), 0, limits().limit_offset)


def distinct_fields(model: Model, value, path: tuple = ("distinct",)) -> list[str]:
    names = [value] if isinstance(value, str) else value
    if not isinstance(names, (list, tuple)) or not names or any(not isinstance(n, str) for n in names):
        raise QueryError("distinct is a list of fields", path)
    if len(set(names)) < len(names):
        raise QueryError("distinct names a field twice", path)
    for n in names:
        model.scalar(n, path)
    return list(names)


def distinct(df: DataFrame, model: Model, names: list[str], order: list[Key]) -> DataFrame:
    """The first row of each combination, in the given order and then that of the primary key."""
    w = Window.partitionBy(*[col(n) for n in names]).orderBy(*[k.sort() for k in with_tiebreak(order, model)])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def flat_cursor(model: Model, cursor, path: tuple = ("cursor",)) -> dict:
    """Field values of a cursor; those of a compound key are one object named by its fields."""
    if not isinstance(cursor, dict) or not cursor:
        raise QueryError("a cursor is an object of fields", path)
    out: dict = {}
    for name, value in cursor.items():
        if isinstance(value, dict) and name not in model.fields and "_".join(value) == name:
            out |= value
        else:
            out[name] = value
    for name, value in out.items():
        model.scalar(name, (*path, name))
        if value is None:
            raise QueryError("a cursor has no nulls", (*path, name))
    return out


def _after(key: Key, cursor: Column) -> Column:
    """Rows strictly behind the cursor by one key."""
    value = key.value
    further = value < cursor if key.down else value > cursor
    if key.first:
        return F.when(cursor.isNull(), value.isNotNull()).otherwise(F.coalesce(further, F.lit(False)))
    return F.when(cursor.isNull(), F.lit(False)).otherwise(F.coalesce(further, F.lit(False)) | value.isNull())


def from_cursor(df: DataFrame, model: Model, catalog: Catalog, cursor: dict, order: list[Key]) -> tuple[DataFrame, list[Key]]:
    """The rows from the cursor's row on, that row first, and the order with the cursor's fields in it.

    Without an order, or with one by the cursor's only field, a comparison does; the cursor's row need not exist. Else the
    row is looked up and joined in (it is one row), and rows before it by the keys' order go; no row, no result.
    """
    values = {n: literal(v, model.fields[n], catalog, ("cursor", n)) for n, v in cursor.items()}
    order = order + [Key(n) for n in cursor if n not in {k.column for k in order}]
    if len(cursor) == 1 and len(order) == 1 and not order[0].values:
        name, lit = next(iter(values.items()))
        return df.where(col(name) <= lit if order[0].down else col(name) >= lit), order
    at = reduce(lambda a, b: a & b, [col(n) == v for n, v in values.items()])
    row = df.where(at).limit(1).select(*[k.value.alias(f"__cursor{i}") for i, k in enumerate(order)])
    here = [F.col(f"__cursor{i}") for i in range(len(order))]
    same = lambda i: order[i].value.eqNullSafe(here[i])
    chain = [reduce(lambda a, b: a & b, [*map(same, range(i)), _after(order[i], here[i])]) for i in range(len(order))]
    chain.append(reduce(lambda a, b: a & b, map(same, range(len(order)))))
    rest = df.crossJoin(F.broadcast(row)).where(reduce(lambda a, b: a | b, chain))  # one row at most
    return rest.drop(*[f"__cursor{i}" for i in range(len(order))]), order


#: A page that ends within so many rows of its order is found by a bounded heap a task, a longer one by rows' places.
HELD = 10_000


def page(df: DataFrame, order: list[Key], take: int | None, skip: int, apart: tuple[str, ...] = (), unique: bool = True, place: str | None = None) -> DataFrame:
    """Sort, offset and limit; a negative take counts from the end and gives rows in the order asked for.

    ``apart``: fields that tell rows apart, fully if ``unique``; without them rows are sorted and counted off by one task.
    ``place``: a column for the rows' places in the page.
    """
    back = take is not None and take < 0
    keys = [k.reversed() for k in order] if back else order
    bounded = take is not None and (skip + abs(take) <= HELD or not keys and not skip)
    if not apart or bounded or not skip and take is None and place is None:
        if keys:
            df = df.orderBy(*[k.sort() for k in keys])
        if skip:
            df = df.offset(skip)
        df = df if take is None else df.limit(abs(take))
        if back:
            df = df.orderBy(*[k.sort() for k in order])
        return df.coalesce(1).withColumn(place, F.monotonically_increasing_id() + 1) if place else df
    keys = keys + [Key(n) for n in apart if n not in {k.column for k in keys}]
    df = placed(df, keys, "__place", unique)
    df = df.where(F.col("__place") > skip) if skip else df
    df = df if take is None else df.where(F.col("__place") <= skip + abs(take))
    if place and not back:
        return df.withColumn(place, F.col("__place") - skip).drop("__place")
    df = df.drop("__place").orderBy(*[k.sort() for k in (order if back else keys)])
    return df.coalesce(1).withColumn(place, F.monotonically_increasing_id() + 1) if place else df  # a negative take is small
