"""``select`` and ``include``: nested rows, and counts of related rows.

Children are filtered, cut to each parent's page by a window, given their own children, and collected by key; the result
joins the parents. A limited page of parents restricts the children before that (a semi join on its keys).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..catalog import Model, Relation
from ..config import limits
from ..errors import LimitExceeded, QueryError, UnsupportedQuery
from ..sources.tables import scan
from .ordering import Key, field_key, entries, with_tiebreak
from .paging import distinct_fields, skip_of, take_of
from .predicates import Predicates, col

_number = itertools.count()
CHILD_ARGS = frozenset({"where", "select", "include", "orderBy", "take", "skip", "distinct"})


class Shape:
    """What a query returns of a model: fields, nested relations, and counts of relations."""

    def __init__(self, model: Model, args: dict, path: tuple, top: bool = True):
        select, include = args.get("select"), args.get("include")
        if select is not None and include is not None and top:
            raise QueryError("select and include exclude each other", path)
        self.fields: list[str] = []
        self.relations: dict[str, dict] = {}
        self.counts: dict[str, dict] = {}
        if select is None:
            self.fields = list(model.fields)
        for name, value in (select if select is not None else include or {}).items():
            at = (*path, "select" if select is not None else "include", name)
            if value is None or value is False:
                continue
            if name == "_count":
                self.counts = self._counts(model, value, at)
            elif name in model.relations:
                if value is not True and not isinstance(value, dict):
                    raise QueryError("a relation takes true or an object", at)
                self.relations[name] = {} if value is True else value
            elif select is not None:
                model.scalar(name, at)
                self.fields.append(name)
            else:
                model.relation(name, at)
        if not (self.fields or self.relations or self.counts):
            raise QueryError("a select needs at least one field", path)

    @staticmethod
    def _counts(model: Model, value, path: tuple) -> dict[str, dict]:
        if value is True:
            return {n: {} for n, r in model.relations.items() if r.many}
        if not isinstance(value, dict) or not isinstance(value.get("select"), dict):
            raise QueryError("_count takes true or a select", path)
        out = {}
        for name, v in value["select"].items():
            model.relation(name, (*path, name))
            if v:
                out[name] = v.get("where") or {} if isinstance(v, dict) else {}
        return out


class Includes:
    def __init__(self, predicates: Predicates):
        self.predicates, self.catalog, self.tables = predicates, predicates.catalog, predicates.tables
        self.subqueries = 0

    def shaped(self, df: DataFrame, model: Model, shape: Shape, path: tuple, trail: tuple = (), keys: DataFrame | None = None, keep: list[str] = ()) -> DataFrame:
        """``df``'s rows as ``shape`` asks, with the columns ``keep`` as well. ``keys``: rows that children belong to."""
        limit, depth = limits(), len(trail)
        if shape.relations and depth >= limit.include_depth:
            raise LimitExceeded(f"relations nest at most {limit.include_depth} deep", path)
        if len(shape.relations) > limit.includes_per_level:
            raise LimitExceeded(f"at most {limit.includes_per_level} relations to a level", path)
        out: list[Column] = [col(f) for f in shape.fields]
        for name, args in shape.relations.items():
            relation, at = model.relations[name], (*path, name)
            step = (model.name, name)
            if step in trail:
                raise QueryError(f"{model.name}.{name} comes back to itself", at)
            if relation.model == model.name and sum(model.relations[n].model == model.name for m, n in trail if m == model.name) >= limit.self_referential_depth:
                raise LimitExceeded(f"a model refers to itself at most {limit.self_referential_depth} times", at)
            self.subqueries += 1
            if self.subqueries > limit.total_subqueries:
                raise LimitExceeded(f"at most {limit.total_subqueries} relations to a query", at)
            df = self.attach(df, relation, args, at, (*trail, step), keys)
            out.append(col(f"__rel_{name}").alias(name))
        if shape.counts:
            for name, where in shape.counts.items():
                df = self.count(df, model.relations[name], where, (*path, "_count", name))
            out.append(F.struct(*[F.coalesce(col(f"__count_{n}"), F.lit(0).cast("bigint")).alias(n) for n in shape.counts]).alias("_count"))
        return df.select(*out, *[col(k) for k in keep])

    def _keys(self, relation: Relation) -> list[str]:
        n = next(_number)
        return [f"__fk{n}_{k}" for k in range(len(relation.child))]

    @staticmethod
    def _on(relation: Relation, names: list[str]) -> Column:
        on = None
        for p, n in zip(relation.parent, names, strict=True):
            on = (col(p) == col(n)) if on is None else on & (col(p) == col(n))
        return on

    def attach(self, df: DataFrame, relation: Relation, args: dict, path: tuple, trail: tuple, keys: DataFrame | None) -> DataFrame:
        """``df`` with a column __rel_name: an array of the related rows, or one row or null."""
        if "cursor" in args:
            raise UnsupportedQuery("a relation takes no cursor", path)
        wrong = set(args) - CHILD_ARGS
        if wrong:
            raise QueryError(f"a relation takes no {', '.join(sorted(wrong))}", path)
        model = self.catalog.model(relation.model)
        shape = Shape(model, args, path)
        rows = self.predicates.filter(scan(self.tables, model), model, args.get("where"), (*path, "where"))
        if keys is not None:  # only children of the page
            names = self._keys(relation)
            page = keys.select(*[col(p).alias(n) for p, n in zip(relation.parent, names, strict=True)])
            on = None
            for c, n in zip(relation.child, names, strict=True):
                on = (col(c) == col(n)) if on is None else on & (col(c) == col(n))
            rows = rows.join(page, on, "left_semi")
        names = self._keys(relation)
        order = [field_key(self.catalog, model, n, v, at) for n, v, at in entries(args.get("orderBy"), (*path, "orderBy"))]
        rows = rows.withColumns({n: col(c) for n, c in zip(names, relation.child, strict=True)})
        if args.get("distinct") is not None:  # of each parent
            fields = distinct_fields(model, args["distinct"], (*path, "distinct"))
            w = Window.partitionBy(*names, *[col(f) for f in fields]).orderBy(*[k.sort() for k in with_tiebreak(order, model)])
            rows = rows.withColumn("__d", F.row_number().over(w)).where("__d = 1").drop("__d")
        if not relation.many:
            rows = self.shaped(rows, model, shape, path, trail, keys if keys is None else rows, names)
            row = F.struct(*[col(c) for c in rows.columns if c not in names]).alias(f"__rel_{relation.name}")
            return df.join(rows.select(*names, row), self._on(relation, names), "left").drop(*names)
        take, skip = take_of(args), skip_of(args)
        ranks = self._ranked(rows, names, with_tiebreak(order, model), take, skip)
        rows = self.shaped(ranks, model, shape, path, trail, ranks if keys is not None or take is not None else None, [*names, "__rn"])
        row = F.struct(*[col(c) for c in rows.columns if c not in (*names, "__rn")])
        packed = rows.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct(col("__rn"), row.alias("row")))).alias("__all"))
        packed = packed.select(*names, F.transform("__all", lambda x: x["row"]).alias(f"__rel_{relation.name}"))
        df = df.join(packed, self._on(relation, names), "left").drop(*names)
        kind = dict(df.dtypes)[f"__rel_{relation.name}"]
        return df.withColumn(f"__rel_{relation.name}", F.coalesce(col(f"__rel_{relation.name}"), F.array().cast(kind)))

    @staticmethod
    def _ranked(rows: DataFrame, names: list[str], order: list[Key], take: int | None, skip: int) -> DataFrame:
        """Rows with their place __rn among their parent's, cut to its page."""
        w = Window.partitionBy(*[col(n) for n in names])
        rows = rows.where(" and ".join(f"`{n}` is not null" for n in names))
        if take is not None and take < 0:  # the tail, in the order asked for
            back = rows.withColumn("__back", F.row_number().over(w.orderBy(*[k.reversed().sort() for k in order])))
            return back.where((F.col("__back") > skip) & (F.col("__back") <= skip - take)).withColumn("__rn", -F.col("__back")).drop("__back")
        rows = rows.withColumn("__rn", F.row_number().over(w.orderBy(*[k.sort() for k in order])))
        if skip:
            rows = rows.where(F.col("__rn") > skip)
        return rows if take is None else rows.where(F.col("__rn") <= skip + take)

    def count(self, df: DataFrame, relation: Relation, where: dict, path: tuple) -> DataFrame:
        """``df`` with a column __count_name: related rows, null where there are none."""
        model = self.catalog.model(relation.model)
        names = self._keys(relation)
        rows = self.predicates.filter(scan(self.tables, model), model, where, path)
        counts = rows.groupBy(*[col(c).alias(n) for c, n in zip(relation.child, names, strict=True)]).agg(F.count("*").alias(f"__count_{relation.name}"))
        return df.join(counts, self._on(relation, names), "left").drop(*names)
