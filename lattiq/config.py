"""Limits and options. Passing a limit raises; the values are part of what a caller sees."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Limits:
    query_depth: int = 50
    not_depth: int = 50
    having_depth: int = 50
    array_size: int = 10_000
    string_length: int = 10_000
    include_depth: int = 5
    includes_per_level: int = 10
    total_subqueries: int = 100
    self_referential_depth: int = 2
    relation_order_depth: int = 10
    limit_offset: int = 2**31 - 1
    negative_take: int = -10_000
    json_path_segments: int = 100
    json_segment_length: int = 255


_now = Limits()


def limits() -> Limits:
    return _now


def set_limits(**values: int) -> Limits:
    global _now
    unknown = set(values) - {f.name for f in fields(Limits)}
    if unknown:
        raise KeyError(f"no such limits: {sorted(unknown)}")
    _now = replace(_now, **values)
    return _now


def reset_limits() -> Limits:
    global _now
    _now = Limits()
    return _now


@dataclass(frozen=True)
class Options:
    #: "postgres": distinct fields lead the order; "sqlite": the caller's order stays.
    dialect: str = "postgres"
    #: Treat % and _ in contains, startsWith and endsWith as themselves.
    escape_like: bool = False
