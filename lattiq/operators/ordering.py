"""``orderBy`` arguments as sort keys with explicit places for nulls."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, Model
from ..config import limits
from ..errors import LimitExceeded, QueryError
from ..sources.tables import scan
from .predicates import col

_number = itertools.count()


@dataclass(frozen=True)
class Key:
    """``column`` of the frame; enum values in order sort by their place."""

    column: str
    down: bool = False
    nulls_first: bool | None = None  # None: last when ascending, first when descending
    values: tuple[str, ...] = ()

    @property
    def first(self) -> bool:
        return self.down if self.nulls_first is None else self.nulls_first

    @property
    def value(self) -> Column:
        if not self.values:
            return col(self.column)
        return F.nullif(F.array_position(F.array(*map(F.lit, self.values)), col(self.column)), F.lit(0).cast("bigint"))

    def sort(self) -> Column:
        v = self.value
        if self.down:
            return v.desc_nulls_first() if self.first else v.desc_nulls_last()
        return v.asc_nulls_first() if self.first else v.asc_nulls_last()

    def reversed(self) -> Key:
        return replace(self, down=not self.down, nulls_first=None if self.nulls_first is None else not self.nulls_first)


def _direction(value, path: tuple) -> tuple[bool, bool | None]:
    sort, nulls = (value.get("sort"), value.get("nulls")) if isinstance(value, dict) else (value, None)
    if sort not in ("asc", "desc") or nulls not in (None, "first", "last") or isinstance(value, dict) and set(value) - {"sort", "nulls"}:
        raise QueryError("an order is asc, desc, or an object of sort and nulls", path)
    return sort == "desc", None if nulls is None else nulls == "first"


def entries(order, path: tuple = ("orderBy",)) -> list[tuple[str, object, tuple]]:
    """(name, direction or object, path) from an object or a list of objects."""
    out = []
    for k, part in enumerate(order if isinstance(order, (list, tuple)) else [order] if order else []):
        if not isinstance(part, dict):
            raise QueryError("an order must be an object", (*path, k))
        out += [(name, v, (*path, name)) for name, v in part.items() if v is not None]
    return out


def field_key(catalog: Catalog, model: Model, name: str, value, path: tuple, column: str | None = None) -> Key:
    field = model.scalar(name, path)
    down, first = _direction(value, path)
    names = catalog.enum(field.base)
    return Key(column or name, down, first, tuple(names.values()) if names else ())


def keys(catalog: Catalog, tables, df: DataFrame, model: Model, order, path: tuple = ("orderBy",)) -> tuple[DataFrame, list[Key]]:
    """Sort keys; orders by a to-one relation's fields join them in as columns of their own."""
    out: list[Key] = []
    joined: dict[tuple[str, ...], tuple[Model, dict[str, str]]] = {}

    def step(df: DataFrame, at: tuple[str, ...], model: Model, columns: dict[str, str], name: str, value, path: tuple) -> DataFrame:
        if name not in model.relations:
            out.append(field_key(catalog, model, name, value, path, columns.get(name)))
            return df
        relation = model.relations[name]
        if relation.many:
            raise QueryError("an order can't follow a relation with many rows", path)
        if len(at) >= limits().relation_order_depth:
            raise LimitExceeded(f"orders follow at most {limits().relation_order_depth} relations", path)
        if not isinstance(value, dict) or "_count" in value:
            raise QueryError("an order by a relation needs one of its fields", path)
        here = (*at, name)
        if here not in joined:
            other = catalog.model(relation.model)
            n = next(_number)
            names = {f: f"__order{n}_{f}" for f in other.fields}
            child = scan(tables, other).select(*[col(f).alias(c) for f, c in names.items()])
            on = None
            for p, c in zip(relation.parent, relation.child, strict=True):
                same = col(columns.get(p, p)) == col(names[c])
                on = same if on is None else on & same
            df = df.join(child, on, "left")
            joined[here] = other, names
        other, names = joined[here]
        for k, v in value.items():
            df = step(df, here, other, names, k, v, (*path, k))
        return df

    for name, value, at in entries(order, path):
        df = step(df, (), model, {}, name, value, at)
    return df, out


def with_tiebreak(order: list[Key], model: Model) -> list[Key]:
    """The keys and, ascending, those of the primary key that are not among them."""
    return order + [Key(k) for k in model.tiebreak if k not in {o.column for o in order}]
