"""Queries prepared once and bound later, found again by their shape."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..errors import QueryError
from .client import METHODS, Engine


@dataclass(frozen=True)
class Param:
    """A value that comes with the call; may stand for any value, take, skip, and a cursor's values."""

    name: str


def shape(value) -> object:
    """The arguments with sorted names and every value as a mark."""
    if isinstance(value, dict):
        return {k: shape(value[k]) for k in sorted(value)}
    if isinstance(value, (list, tuple)):
        return [shape(v) for v in value]
    return "?" if isinstance(value, Param) else value


def names(value) -> set[str]:
    if isinstance(value, Param):
        return {value.name}
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, (list, tuple)) else ()
    return set().union(*map(names, inner)) if inner else set()


def bound(value, given: dict):
    if isinstance(value, Param):
        return given[value.name]
    if isinstance(value, dict):
        return {k: bound(v, given) for k, v in value.items()}
    return [bound(v, given) for v in value] if isinstance(value, (list, tuple)) else value


class Prepared:
    def __init__(self, engine: Engine, model: str, method: str, args: dict):
        if method not in METHODS:
            raise QueryError(f"no method {method}")
        engine.catalog.model(model)
        self.engine, self.model, self.method, self.args, self.params = engine, model, method, args, names(args)

    def __call__(self, **given) -> DataFrame:
        if set(given) != self.params:
            raise QueryError(f"parameters are {', '.join(sorted(self.params)) or 'none'}; got {', '.join(sorted(given)) or 'none'}")
        return self.engine.query(self.model, self.method, bound(self.args, given))

    @property
    def key(self) -> str:
        return json.dumps([self.model, self.method, shape(self.args)], sort_keys=True, default=str)


class Registry:
    """Prepared queries by name and by shape."""

    def __init__(self, engine: Engine):
        self.engine, self.by_name, self.by_key = engine, {}, {}

    def prepare(self, name: str, model: str, method: str, args: dict) -> Prepared:
        query = Prepared(self.engine, model, method, args)
        self.by_name[name] = self.by_key[query.key] = query
        return query

    def find(self, model: str, method: str, args: dict) -> Prepared | None:
        return self.by_key.get(json.dumps([model, method, shape(args)], sort_keys=True, default=str))
