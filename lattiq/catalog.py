"""Models, their fields and relations, and the logical names of physical tables and columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import QueryError

NUMERIC = frozenset({"Int", "BigInt", "Float", "Decimal"})
SCALARS = NUMERIC | {"String", "Boolean", "DateTime", "Json", "Bytes"}


@dataclass(frozen=True)
class Field:
    """A scalar column. ``type`` is a scalar type, an enum's name, or either with [] for a list; ``db`` is the physical name."""

    name: str
    type: str = "String"
    db: str | None = None
    required: bool = True
    is_id: bool = False
    unique: bool = False

    @property
    def column(self) -> str:
        return self.db or self.name

    @property
    def is_list(self) -> bool:
        return self.type.endswith("[]")

    @property
    def base(self) -> str:
        return self.type.rstrip("?").removesuffix("[]")


@dataclass(frozen=True)
class Relation:
    """``parent`` fields of this model equal ``child`` fields of the related one. ``local``: this side holds the key."""

    name: str
    model: str
    parent: tuple[str, ...]
    child: tuple[str, ...]
    many: bool
    local: bool = False


@dataclass(frozen=True)
class Model:
    name: str
    table: str
    fields: dict[str, Field]
    relations: dict[str, Relation]
    primary_key: tuple[str, ...] = ()

    def scalar(self, name: str, path: tuple = ()) -> Field:
        if name in self.relations:
            raise QueryError(f"{name} of {self.name} is a relation, not a field", path)
        if name not in self.fields:
            raise QueryError(f"{self.name} has no field {name}; it has {', '.join(self.fields)}", path)
        return self.fields[name]

    def relation(self, name: str, path: tuple = ()) -> Relation:
        if name not in self.relations:
            raise QueryError(f"{self.name} has no relation {name}", path)
        return self.relations[name]

    @property
    def unique_keys(self) -> list[tuple[str, ...]]:
        """The primary key and the fields that are unique by themselves."""
        return [*([self.key] if self.key else []), *((f.name,) for f in self.fields.values() if f.unique or f.is_id and not self.primary_key)]

    @property
    def key(self) -> tuple[str, ...]:
        """The primary key: the declared one, id fields, or a field named id; empty if there is none."""
        if self.primary_key:
            return self.primary_key
        ids = tuple(f.name for f in self.fields.values() if f.is_id)
        return ids or (("id",) if "id" in self.fields else ())

    @property
    def tiebreak(self) -> tuple[str, ...]:
        """The primary key, or all plain fields where there is none."""
        return self.key or tuple(f.name for f in self.fields.values() if not f.is_list)


@dataclass
class Catalog:
    models: dict[str, Model] = field(default_factory=dict)
    #: Enum name -> values in order; a value may be (name, physical value).
    enums: dict[str, list] = field(default_factory=dict)

    def add(self, name: str, fields: list[Field], relations: list[Relation] = (), table: str | None = None, key: tuple[str, ...] = ()) -> Model:
        model = Model(name, table or name, {f.name: f for f in fields if not f.name.startswith(("@", "//"))}, {r.name: r for r in relations}, tuple(key))
        self.models[name] = model
        return model

    def model(self, name: str, path: tuple = ()) -> Model:
        if name not in self.models:
            raise QueryError(f"no model {name}", path)
        return self.models[name]

    def enum(self, name: str) -> dict[str, str] | None:
        """Logical -> physical values of an enum, in order."""
        if name not in self.enums:
            return None
        return {v: v for v in self.enums[name] if isinstance(v, str)} if all(isinstance(v, str) for v in self.enums[name]) else {(v if isinstance(v, str) else v[0]): (v if isinstance(v, str) else v[1]) for v in self.enums[name]}

    def check(self) -> Catalog:
        """Raises if a relation's keys don't fit."""
        for m in self.models.values():
            for f in m.fields.values():
                if f.base not in SCALARS and f.base not in self.enums:
                    raise QueryError(f"{m.name}.{f.name} has the unknown type {f.type}")
            for k in m.key:
                m.scalar(k)
            for r in m.relations.values():
                other = self.model(r.model)
                if not r.parent or len(r.parent) != len(r.child):
                    raise QueryError(f"{m.name}.{r.name}: keys of {len(r.parent)} and {len(r.child)} fields")
                for p, c in zip(r.parent, r.child, strict=True):
                    a, b = m.scalar(p), other.scalar(c)
                    if a.base != b.base and not {a.base, b.base} <= NUMERIC:
                        raise QueryError(f"{m.name}.{r.name}: {p} is {a.type}, {c} is {b.type}")
        return self


def _f(name: str, type: str = "String", **more) -> Field:
    return Field(name, type, **more)


def _one(name: str, model: str, parent: str, child: str) -> Relation:
    return Relation(name, model, (parent,), (child,), many=False, local=True)


def _many(name: str, model: str, parent: str, child: str) -> Relation:
    return Relation(name, model, (parent,), (child,), many=True)


def sales_catalog() -> Catalog:
    """Logical models over the test tables."""
    c = Catalog(enums={"OrderStatus": ["O", "P", "F"], "Role": ["system", "user", "assistant"]})
    c.add("region", [_f("key", "Int", db="r_regionkey", is_id=True), _f("name", db="r_name")], [_many("nations", "nation", "key", "regionKey")])
    c.add("nation", [_f("key", "Int", db="n_nationkey", is_id=True), _f("name", db="n_name"), _f("regionKey", "Int", db="n_regionkey")], [_one("region", "region", "regionKey", "key"), _many("customers", "customer", "key", "nationKey"), _many("suppliers", "supplier", "key", "nationKey")])
    c.add("customer", [_f("key", "BigInt", db="c_custkey", is_id=True), _f("name", db="c_name"), _f("nationKey", "Int", db="c_nationkey"), _f("balance", "Float", db="c_acctbal"), _f("segment", db="c_mktsegment")], [_one("nation", "nation", "nationKey", "key"), _many("orders", "orders", "key", "customerKey"), _many("events", "events", "key", "userId")])
    c.add("supplier", [_f("key", "BigInt", db="s_suppkey", is_id=True), _f("name", db="s_name"), _f("nationKey", "Int", db="s_nationkey"), _f("balance", "Float", db="s_acctbal")], [_one("nation", "nation", "nationKey", "key"), _many("lines", "lineitem", "key", "supplierKey")])
    c.add("part", [_f("key", "BigInt", db="p_partkey", is_id=True), _f("name", db="p_name"), _f("brand", db="p_brand"), _f("type", db="p_type"), _f("size", "Int", db="p_size"), _f("price", "Float", db="p_retailprice")], [_many("lines", "lineitem", "key", "partKey")])
    c.add("orders", [_f("key", "BigInt", db="o_orderkey", is_id=True), _f("customerKey", "BigInt", db="o_custkey"), _f("status", "OrderStatus", db="o_orderstatus"), _f("total", "Float", db="o_totalprice"), _f("date", "DateTime", db="o_orderdate"), _f("priority", db="o_orderpriority", required=False)], [_one("customer", "customer", "customerKey", "key"), _many("lines", "lineitem", "key", "orderKey")])
    c.add("lineitem", [_f("orderKey", "BigInt", db="l_orderkey"), _f("partKey", "BigInt", db="l_partkey"), _f("supplierKey", "BigInt", db="l_suppkey"), _f("number", "Int", db="l_linenumber"), _f("quantity", "Float", db="l_quantity"), _f("price", "Float", db="l_extendedprice"), _f("discount", "Float", db="l_discount"), _f("tax", "Float", db="l_tax"), _f("returnFlag", db="l_returnflag", required=False), _f("lineStatus", db="l_linestatus"), _f("shipDate", "DateTime", db="l_shipdate")], [_one("order", "orders", "orderKey", "key"), _one("part", "part", "partKey", "key"), _one("supplier", "supplier", "supplierKey", "key"), Relation("alike", "lineitem", ("orderKey", "supplierKey"), ("orderKey", "supplierKey"), many=True)])
    c.add("events", [_f("id", "BigInt", db="event_id", is_id=True), _f("ts", "DateTime"), _f("userId", "BigInt", db="user_id"), _f("type", db="event_type"), _f("value", "Float"), _f("props", "Json")], [_one("customer", "customer", "userId", "key")])
    c.add("documents", [_f("id", "BigInt", db="doc_id", is_id=True), _f("text"), _f("lang"), _f("source"), _f("chars", "BigInt", db="n_chars")], [Relation("label", "labels", ("id",), ("id",), many=False)])
    c.add("labels", [_f("id", "BigInt", db="doc_id", is_id=True), _f("quality", "Int"), _f("toxic", "Int")], [_one("document", "documents", "id", "id")])
    c.add("conversations", [_f("conv", "BigInt", db="conv_id"), _f("turn", "BigInt"), _f("role", "Role"), _f("text")], key=("conv", "turn"))
    c.add("embeddings", [_f("id", "BigInt", db="vec_id", is_id=True), _f("embedding", "Float[]"), _f("label", "Int")])
    c.add("pages", [_f("id", "BigInt", db="page_id", is_id=True), _f("url"), _f("html")])
    c.add("benchmark", [_f("id", "BigInt", db="item_id", is_id=True), _f("text")])
    return c.check()
