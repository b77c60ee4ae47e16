"""Python values as literals of a field's type."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import Catalog, Field
from ..errors import QueryError

MOST_DEPTH = 20
SPARK = {"String": "string", "Int": "int", "BigInt": "bigint", "Float": "double", "Boolean": "boolean", "DateTime": "timestamp", "Json": "string", "Bytes": "binary"}


def plain(value, path: tuple = (), depth: int = 0, seen: tuple = ()):
    """A value without cycles, too deep nesting, or dates and numbers that no column can hold."""
    if depth > MOST_DEPTH:
        raise QueryError(f"values nest at most {MOST_DEPTH} deep", path)
    if isinstance(value, (dict, list, tuple)):
        if id(value) in seen:
            raise QueryError("a value holds itself", path)
        inner = (*seen, id(value))
        if isinstance(value, dict):
            return {k: plain(v, (*path, k), depth + 1, inner) for k, v in value.items()}
        return [plain(v, (*path, k), depth + 1, inner) for k, v in enumerate(value)]
    if isinstance(value, float) and not math.isfinite(value):
        raise QueryError("not a finite number", path)
    return value


def literal(value, field: Field, catalog: Catalog, path: tuple = ()) -> Column:
    """``value`` as a literal to compare with ``field``'s elements; enum names become their physical values."""
    value = plain(value, path)
    if value is None:
        return F.lit(None)
    names = catalog.enum(field.base)
    if names is not None:
        if value not in names:
            raise QueryError(f"{value!r} is no {field.base}; it has {', '.join(names)}", path)
        return F.lit(names[value])
    kind = field.base
    try:
        if kind in ("Int", "BigInt"):
            if isinstance(value, bool) or int(value) != value and not isinstance(value, str):
                raise ValueError
            return F.lit(int(value)).cast("bigint")
        if kind == "Float":
            return F.lit(float(value))
        if kind == "Decimal":
            return F.lit(decimal.Decimal(str(value)))
        if kind == "Boolean":
            if not isinstance(value, bool):
                raise ValueError
            return F.lit(value)
        if kind == "DateTime":
            if isinstance(value, str):
                value = dt.datetime.fromisoformat(value)
            elif isinstance(value, dt.date) and not isinstance(value, dt.datetime):
                value = dt.datetime(value.year, value.month, value.day)
            elif isinstance(value, (int, float)):
                value = dt.datetime.fromtimestamp(value / 1000, dt.UTC)
            if value.tzinfo:
                value = value.astimezone(dt.UTC).replace(tzinfo=None)
            return F.to_timestamp(F.lit(value.isoformat(sep=" ")))
        if kind == "Json":
            return F.lit(value if isinstance(value, str) else json.dumps(value))
        if kind == "Bytes":
            return F.lit(bytes(value))
        if not isinstance(value, str):
            raise ValueError
        return F.lit(value)
    except (ValueError, TypeError, AttributeError, decimal.InvalidOperation):
        raise QueryError(f"{value!r} is no {kind}", path) from None


def count_of(value, name: str, path: tuple, least: int, most: int) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise QueryError(f"{name} must be a whole number", path)
    try:
        number = int(value)
        if float(value) != number:
            raise ValueError
    except ValueError:
        raise QueryError(f"{name} must be a whole number", path) from None
    if not least <= number <= most:
        raise QueryError(f"{name} must be from {least} to {most}", path)
    return number
