"""The queries: ``Engine(spark, tables).model("orders").find_many({...})``. Every method gives a lazy DataFrame."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, sales_catalog
from ..config import Options
from ..errors import QueryError, UnsupportedQuery
from ..functions.values import plain
from ..operators import aggregates, ordering, paging
from ..operators.includes import Includes, Shape
from ..operators.ordering import Key
from ..operators.predicates import Predicates, col
from ..sources.tables import ParquetTables, scan

METHODS = ("findMany", "findFirst", "findUnique", "count", "aggregate", "groupBy")
ARGS = {
    "findMany": {"where", "select", "include", "orderBy", "take", "skip", "cursor", "distinct"},
    "findFirst": {"where", "select", "include", "orderBy", "take", "skip", "cursor", "distinct"},
    "findUnique": {"where", "select", "include"},
    "count": {"where", "orderBy", "take", "skip", "cursor", "distinct", "select"},
    "aggregate": {"where", "orderBy", "take", "skip", "cursor", *aggregates.FUNCTIONS},
    "groupBy": {"by", "where", "having", "orderBy", "take", "skip", *aggregates.FUNCTIONS},
}


class Engine:
    def __init__(self, spark: SparkSession, tables, catalog: Catalog | None = None, options: Options | None = None, on_query: Callable[[dict], None] | None = None):
        self.spark, self.tables = spark, ParquetTables(spark, tables) if isinstance(tables, str) else tables
        self.catalog, self.options, self.on_query = catalog or sales_catalog(), options or Options(), on_query
        self.predicates = Predicates(self.catalog, self.tables, self.options)

    def model(self, name: str) -> ModelQueries:
        return ModelQueries(self, self.catalog.model(name).name)

    def __getattr__(self, name: str) -> ModelQueries:
        if name.startswith("_") or name in ("catalog", "tables"):
            raise AttributeError(name)
        try:
            return self.model(name)
        except QueryError as e:
            raise AttributeError(str(e)) from None

    def sql(self, text: str, **values) -> DataFrame:
        """Spark SQL with named parameters; values are never written into the text."""
        return self.spark.sql(text, args=values)

    def query(self, model: str, method: str, args: dict | None = None) -> DataFrame:
        """The DataFrame of one query; ``explain()`` shows its plan."""
        if method not in METHODS:
            raise UnsupportedQuery(f"no method {method}; there are {', '.join(METHODS)}")
        args = plain(args or {})
        wrong = set(args) - ARGS[method]
        if wrong:
            raise QueryError(f"{method} takes no {', '.join(sorted(wrong))}")
        begin = time.perf_counter()
        out = getattr(self, f"_{method}")(self.catalog.model(model), args)
        if self.on_query:
            self.on_query({"model": model, "method": method, "args": args, "seconds": time.perf_counter() - begin, "frame": out})
        return out

    # rows

    def _rows(self, model, args: dict, first: bool = False) -> tuple[DataFrame, list[Key], bool]:
        """The page of rows, the keys it is sorted by, and whether it is limited."""
        df = self.predicates.filter(scan(self.tables, model), model, args.get("where"))
        df, order = ordering.keys(self.catalog, self.tables, df, model, args.get("orderBy"))
        take, skip = paging.take_of(args), paging.skip_of(args)
        cursor = None if first or args.get("cursor") is None else paging.flat_cursor(model, args["cursor"])
        if take is not None and take < 0:
            if not order and not cursor:
                raise QueryError("a negative take needs an order", ("take",))
            if first:
                raise QueryError("findFirst takes no negative take", ("take",))
        names = paging.distinct_fields(model, args["distinct"]) if args.get("distinct") is not None else []
        if names and cursor is not None and self.options.dialect == "sqlite":
            raise UnsupportedQuery("the sqlite dialect has no cursor with distinct", ("cursor",))
        if cursor is not None and len(cursor) > 1 and order and [k.column for k in order[: len(cursor)]] != list(cursor):
            raise QueryError(f"an order begins with a compound cursor's fields: {', '.join(cursor)}", ("orderBy",))
        if names and cursor is not None and not set(cursor) <= set(names):
            raise QueryError("with distinct, a cursor's fields are among its fields", ("cursor",))
        if cursor is not None:
            down = take is not None and take < 0
            keys = order + [Key(n) for n in cursor if n not in {k.column for k in order}]
            df, keys = paging.from_cursor(df, model, self.catalog, cursor, [k.reversed() for k in keys] if down else keys)
            order = [k.reversed() for k in keys] if down else keys
        if names:
            if self.options.dialect == "postgres":  # distinct fields lead the order
                own = {k.column: k for k in order}
                order = [own.get(n, Key(n)) for n in names] + [k for k in order if k.column not in names]
            df = paging.distinct(df, model, names, order)
        return df, order, take is not None or bool(skip)

    def _shaped(self, df: DataFrame, model, args: dict, order: list[Key], limited: bool, place: list[str] = ()) -> DataFrame:
        shape = Shape(model, args, ())
        if not shape.relations and not shape.counts:
            return df.select(*[col(f) for f in shape.fields], *place)
        keep = list(dict.fromkeys(k.column for k in order))
        names = [f"__sort{i}" for i in range(len(keep))]
        df = df.withColumns({n: col(k) for n, k in zip(names, keep, strict=True)})
        # children are restricted to a limited page of parents
        out = Includes(self.predicates).shaped(df, model, shape, (), keys=df if limited else None, keep=[*names, *place])
        moved = dict(zip(keep, names, strict=True))
        if order:  # joins lose the order
            out = out.orderBy(*[Key(moved[k.column], k.down, k.nulls_first, k.values).sort() for k in order])
        return out.drop(*names)

    @staticmethod
    def _settled(model, args: dict, order: list[Key], limited: bool) -> list[Key]:
        """A limited page with relations is read more than once, so its rows must not depend on ties."""
        return ordering.with_tiebreak(order, model) if limited and (args.get("include") or args.get("select")) else order

    def _findMany(self, model, args: dict) -> DataFrame:
        df, order, limited = self._rows(model, args)
        order = self._settled(model, args, order, limited)
        return self._shaped(paging.page(df, order, paging.take_of(args), paging.skip_of(args), model.tiebreak, bool(model.key)), model, args, order, limited)

    def numbered(self, model: str, args: dict, place: str = "position") -> DataFrame:
        """findMany's rows with their places, from 1 on, in the column ``place``."""
        m, args = self.catalog.model(model), plain(args)
        wrong = set(args) - ARGS["findMany"]
        if wrong:
            raise QueryError(f"findMany takes no {', '.join(sorted(wrong))}")
        if place in m.fields or place in m.relations:
            raise QueryError(f"{m.name} has a field {place} of its own")
        df, order, limited = self._rows(m, args)
        order = self._settled(m, args, order, limited)
        return self._shaped(paging.page(df, order, paging.take_of(args), paging.skip_of(args), m.tiebreak, bool(m.key), place), m, args, order, limited, [place])

    def _findFirst(self, model, args: dict) -> DataFrame:
        df, order, _ = self._rows(model, args, first=True)
        order = self._settled(model, args, order, True)
        take = paging.take_of(args)
        return self._shaped(paging.page(df, order, 1 if take is None else min(take, 1), paging.skip_of(args), model.tiebreak, bool(model.key)), model, args, order, True)

    def _findUnique(self, model, args: dict) -> DataFrame:
        where = args.get("where")
        if not isinstance(where, dict) or not where:
            raise QueryError("findUnique needs a filter by a unique key", ("where",))
        # a compound key may be one object; other conditions may stand beside a whole key
        flat: dict = {}
        for name, value in where.items():
            flat |= value if isinstance(value, dict) and name not in model.fields and name not in model.relations and "_".join(value) == name else {name: value}
        value_of = lambda v: v["equals"] if isinstance(v, dict) and set(v) == {"equals"} else v
        given = {n for n, v in flat.items() if n in model.fields and value_of(v) is not None and not isinstance(value_of(v), (dict, list, tuple))}
        if not any(set(k) <= given for k in model.unique_keys):
            told = " or ".join(" and ".join(k) for k in model.unique_keys)
            raise QueryError(f"findUnique needs the value of {told}" if told else f"{model.name} has no unique key", ("where",))
        where = flat
        df = self.predicates.filter(scan(self.tables, model), model, where)
        return self._shaped(df.limit(1), model, args, [], True)

    # aggregates

    def _count(self, model, args: dict) -> DataFrame:
        take = paging.take_of(args, negative=False)
        if take is None and not paging.skip_of(args) and args.get("cursor") is None and args.get("distinct") is None:
            df = self.predicates.filter(scan(self.tables, model), model, args.get("where"))
        else:
            df, order, _ = self._rows(model, args)
            df = paging.page(df, order, take, paging.skip_of(args), model.tiebreak, bool(model.key))
        chosen = args.get("select") or {"_all": True}
        names = [n for n, v in chosen.items() if v] if isinstance(chosen, dict) else ["_all"]
        if not names:
            raise QueryError("a count selects _all or fields", ("select",))
        for n in names:
            if n != "_all":
                model.scalar(n, ("select", n))
        counts = df.agg(*[F.count(F.lit(1) if n == "_all" else col(n)).alias(f"__n{k}") for k, n in enumerate(names)])
        return counts.select(F.struct(*[F.col(f"__n{k}").alias(n) for k, n in enumerate(names)]).alias("_count"))

    def _aggregate(self, model, args: dict) -> DataFrame:
        return aggregates.aggregate(self.predicates.filter(scan(self.tables, model), model, args.get("where")), model, args)

    def _groupBy(self, model, args: dict) -> DataFrame:
        df = self.predicates.filter(scan(self.tables, model), model, args.get("where"))
        out, order, columns = aggregates.group_by(df, model, self.catalog, self.predicates, args)
        take = paging.take_of(args)
        if take is not None and take < 0 and not order:
            raise QueryError("a negative take needs an order", ("take",))
        by = [args["by"]] if isinstance(args["by"], str) else args["by"]
        kinds = dict(out.dtypes)  # sums of floats may differ in their last digits when groups are read again
        again = all(k.column in by or kinds[k.column] not in ("float", "double") for k in order)
        return paging.page(out, order, take, paging.skip_of(args), tuple(by) if again else ()).select(*columns)

    def attach_includes(self, df: DataFrame, model: str, include: dict) -> DataFrame:
        """Rows that are at hand already, with their relations."""
        m = self.catalog.model(model)
        shape = Shape(m, {"include": include}, ())
        shape.fields = [c for c in df.columns if c in m.fields]
        return Includes(self.predicates).shaped(df, m, shape, (), keys=df)


class Compiled:
    """A query that is bound to its tables and not run: its frame, and the text of its plan."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    @property
    def plan(self) -> str:
        return self.frame._jdf.queryExecution().optimizedPlan().toString()


def compiler(spark: SparkSession, tables, catalog: Catalog | None = None, options: Options | None = None) -> Callable[[str, str, dict | None], Compiled]:
    """A function of model, method and arguments that compiles without running anything."""
    engine = Engine(spark, tables, catalog, options)
    return lambda model, method, args=None: Compiled(engine.query(model, method, args))


class ModelQueries:
    def __init__(self, engine: Engine, name: str):
        self.engine, self.name = engine, name

    def find_many(self, args: dict | None = None) -> DataFrame:
        return self.engine.query(self.name, "findMany", args)

    def find_first(self, args: dict | None = None) -> DataFrame:
        return self.engine.query(self.name, "findFirst", args)

    def find_unique(self, args: dict) -> DataFrame:
        return self.engine.query(self.name, "findUnique", args)

    def count(self, args: dict | None = None) -> DataFrame:
        return self.engine.query(self.name, "count", args)

    def aggregate(self, args: dict) -> DataFrame:
        return self.engine.query(self.name, "aggregate", args)

    def group_by(self, args: dict) -> DataFrame:
        return self.engine.query(self.name, "groupBy", args)
