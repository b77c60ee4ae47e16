"""``where`` arguments as Spark filters, semi joins and anti joins.

A relation predicate that stands in the top conjunction becomes a left semi or left anti join. Under OR and NOT it
becomes a mark: a left join with the related rows' distinct keys, and a flag that is true where there is one. All scalar
predicates follow SQL's three-valued logic; relation predicates are true or false.
"""

from __future__ import annotations

from decimal import Decimal
import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, Field, Model, Relation
from ..config import Options, limits
from ..errors import LimitExceeded, QueryError
from ..functions.values import literal
from ..sources.tables import scan

COMPARE = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
LIKE = {"contains": ("%", "%"), "startsWith": ("", "%"), "endsWith": ("%", "")}
MANY = ("some", "every", "none")
ONE = ("is", "isNot")
JSON_TEXT = {"string_contains": ("%", "%"), "string_starts_with": ("", "%"), "string_ends_with": ("%", "")}
_number = itertools.count()


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def pattern(value: str, around: tuple[str, str], escape: bool) -> str:
    """A LIKE pattern; a backslash always stands for itself, % and _ only if ``escape``."""
    value = value.replace("\\", "\\\\")
    if escape:
        value = value.replace("%", "\\%").replace("_", "\\_")
    return around[0] + value + around[1]


class Predicates:
    def __init__(self, catalog: Catalog, tables, options: Options):
        self.catalog, self.tables, self.options = catalog, tables, options

    # rows

    def filter(self, df: DataFrame, model: Model, where: dict | None, path: tuple = ("where",), depth: int = 0) -> DataFrame:
        """The rows of ``df`` for which ``where`` holds."""
        where = self._checked(where, path, depth)
        for key, value in where.items():
            at = (*path, key)
            if key == "AND":
                for k, part in enumerate(value if isinstance(value, (list, tuple)) else [value]):
                    df = self.filter(df, model, part, (*at, k), depth + 1)
            elif key in model.relations:
                df = self._related(df, model.relations[key], value, at, depth)
            else:
                df, condition = self.condition(df, model, {key: value}, path, depth)
                df = df.where(condition).drop(*[c for c in df.columns if c.startswith("__mark")])
        return df

    def _checked(self, where, path: tuple, depth: int) -> dict:
        if where is None:
            return {}
        if not isinstance(where, dict):
            raise QueryError("a filter must be an object", path)
        if depth > limits().query_depth:
            raise LimitExceeded(f"filters nest at most {limits().query_depth} deep", path)
        return where

    def _child(self, relation: Relation, where: dict | None, path: tuple, depth: int, negate: bool = False) -> tuple[DataFrame, list[str]]:
        """The related rows' keys under names of their own."""
        model = self.catalog.model(relation.model)
        rows = scan(self.tables, model)
        if negate:
            rows, condition = self.condition(rows, model, where, path, depth + 1)
            rows = rows.where(~condition)
        else:
            rows = self.filter(rows, model, where, path, depth + 1)
        n = next(_number)
        names = [f"__key{n}_{k}" for k in range(len(relation.child))]
        return rows.select(*[col(c).alias(name) for c, name in zip(relation.child, names, strict=True)]), names

    @staticmethod
    def _on(relation: Relation, names: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [col(p) == col(n) for p, n in zip(relation.parent, names, strict=True)])

    def _quantified(self, relation: Relation, value, path: tuple) -> list[tuple[str, dict | None, bool]]:
        """(kind, filter, negate) for each test: kind "semi" or "anti", or "null" / "set" for a local key."""
        if relation.many:
            if not isinstance(value, dict):
                raise QueryError("a filter of a relation must be an object", path)
            wrong = set(value) - set(MANY)
            if wrong or not value:
                raise QueryError(f"{relation.name} has many rows: use some, every or none" + (f", not {', '.join(sorted(wrong))}" if wrong else ""), path)
            out = []
            for q, inner in value.items():
                if not isinstance(inner, dict):
                    raise QueryError(f"{q} must be an object", (*path, q))
                out.append(("semi", inner, False) if q == "some" else ("anti", inner, q == "every"))
            return out
        if value is None:
            value = {"is": None}
        if not isinstance(value, dict):
            raise QueryError("a filter of a relation must be an object", path)
        if set(value) & set(MANY) and not set(value) & set(self.catalog.model(relation.model).fields):
            raise QueryError(f"{relation.name} has one row at most: use is or isNot", path)
        if not set(value) <= set(ONE):
            return [("semi", value, False)]
        out = []
        for q, inner in value.items():
            if inner is None:
                kind = ("null" if q == "is" else "set") if relation.local else ("anti" if q == "is" else "semi")
                out.append((kind, {}, False))
            else:
                out.append(("semi" if q == "is" else "anti", inner, False))
        return out

    @staticmethod
    def _null_key(relation: Relation, kind: str) -> Column:
        parts = [col(p).isNull() if kind == "null" else col(p).isNotNull() for p in relation.parent]
        return reduce((lambda a, b: a | b) if kind == "null" else (lambda a, b: a & b), parts)

    def _related(self, df: DataFrame, relation: Relation, value, path: tuple, depth: int) -> DataFrame:
        for kind, inner, negate in self._quantified(relation, value, path):
            if kind in ("null", "set"):
                df = df.where(self._null_key(relation, kind))
                continue
            child, names = self._child(relation, inner, path, depth, negate)
            df = df.join(child, self._on(relation, names), f"left_{kind}")
        return df

    # conditions

    def condition(self, df: DataFrame, model: Model, where: dict | None, path: tuple, depth: int = 0) -> tuple[DataFrame, Column]:
        """A Column for ``where``, and ``df`` with the marks that it uses."""
        where = self._checked(where, path, depth)
        parts: list[Column] = []
        for key, value in where.items():
            at = (*path, key)
            if key in ("AND", "OR", "NOT"):
                branches = []
                for k, part in enumerate(value if isinstance(value, (list, tuple)) else [value]):
                    df, c = self.condition(df, model, part, (*at, k), depth + 1)
                    branches.append(c)
                if key == "OR":
                    parts.append(reduce(lambda a, b: a | b, branches) if branches else F.lit(False))
                elif branches:
                    both = reduce(lambda a, b: a & b, branches)
                    parts.append(~both if key == "NOT" else both)
            elif key in model.relations:
                relation = model.relations[key]
                for kind, inner, negate in self._quantified(relation, value, at):
                    if kind in ("null", "set"):
                        parts.append(self._null_key(relation, kind))
                        continue
                    child, names = self._child(relation, inner, at, depth, negate)
                    mark = f"__mark{next(_number)}"
                    df = df.join(child.distinct().withColumn(mark, F.lit(True)), self._on(relation, names), "left").drop(*names)
                    found = F.coalesce(col(mark), F.lit(False))
                    parts.append(found if kind == "semi" else ~found)
            else:
                parts.append(self.scalar(model.scalar(key, at), value, at))
        return df, reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    def scalar(self, field: Field, value, path: tuple, target: Column | None = None, deep: int = 0) -> Column:
        """One field's test: a value, null, or an object of operators."""
        target = col(field.name) if target is None else target
        if field.is_list:
            return self._array(field, value, path)
        if not isinstance(value, dict):
            return self._equals(target, field, value, path)
        if field.base == "Json" and (set(value) & (set(JSON_TEXT) | {"path"})):
            return self._json(field, value, path)
        insensitive = value.get("mode") == "insensitive"
        if value.get("mode") not in (None, "insensitive", "default"):
            raise QueryError("mode is default or insensitive", (*path, "mode"))
        parts = [self.operator(target, field, op, v, insensitive, (*path, op), deep) for op, v in value.items() if op != "mode"]
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    def _equals(self, target: Column, field: Field, value, path: tuple, insensitive: bool = False) -> Column:
        if value is None:
            return target.isNull()
        lit = literal(value, field, self.catalog, path)
        return F.lower(target) == F.lower(lit) if insensitive else target == lit

    def operator(self, target: Column, field: Field, op: str, value, insensitive: bool, path: tuple, deep: int = 0) -> Column:
        if op == "equals":
            return self._equals(target, field, value, path, insensitive)
        if op == "not":
            if deep > limits().not_depth:
                raise LimitExceeded(f"not nests at most {limits().not_depth} deep", path)
            if isinstance(value, dict):
                inner = value if "mode" in value or not insensitive else value | {"mode": "insensitive"}
                if not set(inner) - {"mode"}:
                    return F.lit(True)
                return ~self.scalar(field, inner, path, target, deep + 1)
            return target.isNotNull() if value is None else ~self._equals(target, field, value, path, insensitive)
        if op in COMPARE:
            if value is None:
                raise QueryError(f"{op} needs a value", path)
            return getattr(target, COMPARE[op])(literal(value, field, self.catalog, path))
        if op in ("in", "notIn"):
            if not isinstance(value, (list, tuple)):
                raise QueryError(f"{op} needs a list", path)
            lits = [literal(v, field, self.catalog, (*path, k)) for k, v in enumerate(value)]
            if not lits:
                return F.lit(op == "notIn")
            found = target.isin(*lits)
            return found if op == "in" else ~found
        if op in LIKE:
            if field.base not in ("String", "Json") or not isinstance(value, str):
                raise QueryError(f"{op} compares texts", path)
            p = pattern(value, LIKE[op], self.options.escape_like)
            return target.ilike(p) if insensitive else target.like(p)
        raise QueryError(f"no operator {op}", path)

    def _array(self, field: Field, value, path: tuple) -> Column:
        target = col(field.name)
        if value is None:
            return target.isNull()
        if not isinstance(value, dict):
            value = {"equals": value}
        one = Field(field.name, field.base)

        def array(v, at: tuple) -> Column:
            if not isinstance(v, (list, tuple)):
                raise QueryError("needs a list", at)
            if len(v) > limits().array_size:
                raise LimitExceeded(f"lists have at most {limits().array_size} items", at)
            return F.array(*[literal(x, one, self.catalog, at) for x in v])

        def kind() -> str:
            from ..functions.values import SPARK

            return f"array<{SPARK.get(field.base, 'string')}>"

        empty = target.isNull() | (F.size(target) == 0)
        parts = []
        for op, v in value.items():
            at = (*path, op)
            if op == "equals":
                parts.append(target.isNull() if v is None else empty if not v else target.cast(kind()) == array(v, at).cast(kind()))
            elif op == "not":
                if isinstance(v, dict):
                    if set(v) != {"equals"}:
                        raise QueryError("not of a list takes a list, null or equals", at)
                    v = v["equals"]
                parts.append(target.isNotNull() if v is None else ~empty if not v else ~(target.cast(kind()) == array(v, at).cast(kind())))
            elif op == "has":
                if v is None or isinstance(v, (list, tuple, dict)):
                    raise QueryError("has needs one value", at)
                x = literal(v, one, self.catalog, at)
                parts.append(F.when(target.isNotNull(), F.coalesce(F.array_contains(target.cast(kind()), x.cast(kind()[6:-1])), F.lit(False))))
            elif op == "hasSome":
                parts.append(F.when(target.isNotNull(), F.coalesce(F.arrays_overlap(target.cast(kind()), array(v, at).cast(kind())), F.lit(False))) if v else F.lit(False))
            elif op == "hasEvery":
                parts.append(F.when(target.isNotNull(), F.size(F.array_except(array(v, at).cast(kind()), target.cast(kind()))) == 0))
            elif op == "isEmpty":
                if not isinstance(v, bool):
                    raise QueryError("isEmpty is true or false", at)
                parts.append(empty if v else target.isNotNull() & (F.size(target) > 0))
            else:
                raise QueryError(f"no operator {op} for lists", at)
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    def _json(self, field: Field, value: dict, path: tuple) -> Column:
        """Tests at a path of a JSON text, and of the whole text."""
        target, parts = col(field.name), []
        if "path" in value and not isinstance(value["path"], dict) and value["path"] is not None:
            value = {"path": {"path": value["path"]} | {k: v for k, v in value.items() if k != "path" and k not in JSON_TEXT}} | {k: v for k, v in value.items() if k in JSON_TEXT}
        for op, v in value.items():
            at = (*path, op)
            if op == "path" and v is None:
                parts.append(target.isNull())
            elif op == "path":
                parts += self._json_path(target, v, at)
            elif op in JSON_TEXT:
                if v is None or isinstance(v, (dict, list)):
                    raise QueryError(f"{op} needs one value", at)
                if len(str(v)) > limits().string_length:
                    raise LimitExceeded(f"texts have at most {limits().string_length} characters", at)
                parts.append(target.ilike(pattern(str(v), JSON_TEXT[op], self.options.escape_like)))
            else:
                parts.append(self.operator(target, field, op, v, False, at))
        return reduce(lambda a, b: a & b, parts)

    def _json_path(self, target: Column, value: dict, path: tuple) -> list[Column]:
        import re

        segments, ops = value.get("path"), {k: v for k, v in value.items() if k != "path"}
        if not isinstance(segments, (list, tuple)) or not segments or len(segments) > limits().json_path_segments:
            raise QueryError("a JSON path is a list of names", path)
        for s in segments:
            if not isinstance(s, str) or len(s) > limits().json_segment_length or not re.fullmatch(r"[a-zA-Z_]\w*", s, re.A):
                raise QueryError(f"{s!r} is no name in a JSON path", path)
        if not ops:
            raise QueryError("a JSON path needs an operator", path)
        got = F.get_json_object(target, "$." + ".".join(segments))
        out = []
        for op, v in ops.items():
            if op not in ("equals", *COMPARE):
                raise QueryError(f"no operator {op} at a JSON path", (*path, op))
            if v is None:
                out.append(got.isNull())
                continue
            number = isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)
            side = got.try_cast("double") if number else got
            lit = F.lit(float(v)) if number else F.lit(str(v).lower() if isinstance(v, bool) else str(v))
            out.append(side == lit if op == "equals" else getattr(side, COMPARE[op])(lit))
        return out
