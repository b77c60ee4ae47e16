"""count, aggregate, groupBy and having."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import NUMERIC, Catalog, Field, Model
from ..config import limits
from ..errors import LimitExceeded, QueryError
from .ordering import Key, _direction, entries, field_key
from .predicates import Predicates, col

FUNCTIONS: dict[str, Callable[[Column], Column]] = {"_count": F.count, "_sum": F.sum, "_avg": F.avg, "_min": F.min, "_max": F.max}
HAVING = frozenset({"equals", "not", "gt", "gte", "lt", "lte", "in", "notIn"})


@dataclass(frozen=True)
class Aggregate:
    kind: str
    field: str  # "_all" for all rows

    @property
    def column(self) -> str:
        return f"__agg{self.kind}_{self.field}"

    def expression(self) -> Column:
        return F.count(F.lit(1)) if self.field == "_all" else FUNCTIONS[self.kind](col(self.field))


def one(model: Model, kind: str, name: str, path: tuple) -> Aggregate:
    if name == "_all":
        if kind != "_count":
            raise QueryError(f"{kind} takes no _all", path)
        return Aggregate(kind, name)
    field = model.scalar(name, path)
    if kind in ("_sum", "_avg") and (field.base not in NUMERIC or field.is_list):
        raise QueryError(f"{kind} needs a number; {name} is {field.type}", path)
    return Aggregate(kind, name)


def selected(model: Model, args: dict) -> list[Aggregate]:
    out = []
    for kind in FUNCTIONS:
        value = args.get(kind)
        if value is None or value is False:
            continue
        if value is True:
            if kind != "_count":
                raise QueryError(f"{kind} needs fields", (kind,))
            value = {"_all": True}
        if not isinstance(value, dict):
            raise QueryError(f"{kind} needs fields", (kind,))
        out += [one(model, kind, n, (kind, n)) for n, v in value.items() if v is True]
    return out


def packed(aggregates: list[Aggregate]) -> list[Column]:
    """One struct to each function, named by it, with a member to each field."""
    out = []
    for kind in FUNCTIONS:
        if mine := [a for a in aggregates if a.kind == kind]:
            out.append(F.struct(*[col(a.column).alias(a.field) for a in mine]).alias(kind))
    return out


def flat(df: DataFrame) -> DataFrame:
    """Aggregates as plain columns: _sum.total becomes sum_total, _count._all count_all."""
    out: list[Column] = []
    for f in df.schema.fields:
        if f.name in FUNCTIONS:
            out += [F.col(f"`{f.name}`.`{m.name}`").alias(f"{f.name[1:]}_{m.name.lstrip('_')}") for m in f.dataType.fields]
        else:
            out.append(col(f.name))
    return df.select(*out)


class Having:
    """A having tree as a Column over aggregate columns, and the aggregates it needs."""

    def __init__(self, model: Model, predicates: Predicates):
        self.model, self.predicates, self.needs = model, predicates, []

    def column(self, having: dict, path: tuple = ("having",), depth: int = 0) -> Column:
        if depth > limits().having_depth:
            raise LimitExceeded(f"having nests at most {limits().having_depth} deep", path)
        if not isinstance(having, dict):
            raise QueryError("having must be an object", path)
        parts: list[Column] = []
        for key, value in having.items():
            at = (*path, key)
            if key in ("AND", "OR", "NOT"):
                inner = [self.column(v, (*at, k), depth + 1) for k, v in enumerate(value if isinstance(value, (list, tuple)) else [value])]
                if key == "OR":
                    parts.append(reduce(lambda a, b: a | b, inner) if inner else F.lit(False))
                elif inner:
                    both = reduce(lambda a, b: a & b, inner)
                    parts.append(~both if key == "NOT" else both)
                continue
            if not isinstance(value, dict) or not value:
                raise QueryError("having compares aggregates", at)
            for name, ops in value.items():
                if key in FUNCTIONS:
                    target = one(self.model, key, name, (*at, name))
                elif name in FUNCTIONS:
                    target = one(self.model, name, key, (*at, name))
                else:
                    raise QueryError("having compares aggregates", (*at, name))
                parts.append(self._test(target, ops, (*at, name)))
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    def _test(self, target: Aggregate, ops, path: tuple) -> Column:
        if target not in self.needs:
            self.needs.append(target)
        if not isinstance(ops, dict):
            ops = {"equals": ops}
        wrong = set(ops) - HAVING
        if wrong:
            raise QueryError(f"having takes no {', '.join(sorted(wrong))}", path)
        if target.kind == "_count":
            field = Field(target.field, "BigInt")
        elif target.kind in ("_avg", "_sum") and self.model.fields[target.field].base != "Decimal":
            field = Field(target.field, "Float")
        else:
            field = self.model.fields[target.field]
        return self.predicates.scalar(field, ops, path, col(target.column))


def aggregate(df: DataFrame, model: Model, args: dict) -> DataFrame:
    """One row."""
    wanted = selected(model, args)
    if not wanted:
        raise QueryError("an aggregation needs one of _count, _sum, _avg, _min, _max")
    return df.agg(*[a.expression().alias(a.column) for a in wanted]).select(*packed(wanted))


def group_by(df: DataFrame, model: Model, catalog: Catalog, predicates: Predicates, args: dict) -> tuple[DataFrame, list[Key], list[Column]]:
    """Groups that pass having, their sort keys, and the columns to give."""
    by = args.get("by")
    by = [by] if isinstance(by, str) else by
    if not isinstance(by, (list, tuple)) or not by:
        raise QueryError("by is a list of fields", ("by",))
    if len(set(by)) < len(by):
        raise QueryError("by names a field twice", ("by",))
    for n in by:
        if model.scalar(n, ("by",)).is_list:
            raise QueryError("a list can't make groups", ("by", n))
    wanted = selected(model, args)
    having = Having(model, predicates)
    test = having.column(args["having"]) if args.get("having") else None
    order: list[Key] = []
    for name, value, path in entries(args.get("orderBy")):
        if name in FUNCTIONS:
            if not isinstance(value, dict):
                raise QueryError("an order by an aggregate needs its field", path)
            for f, d in value.items():
                a = one(model, name, f, (*path, f))
                having.needs.append(a)
                order.append(Key(a.column, *_direction(d, (*path, f))))
        elif name in by:
            order.append(field_key(catalog, model, name, value, path))
        else:
            raise QueryError("groups sort by their fields and aggregates", path)
    needs = list(dict.fromkeys([*wanted, *having.needs])) or [Aggregate("_count", "_all")]
    out = df.groupBy(*[col(n) for n in by]).agg(*[a.expression().alias(a.column) for a in needs])
    if test is not None:
        out = out.where(test)
    return out, order, [*[col(n) for n in by], *packed(wanted)]
