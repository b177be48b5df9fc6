"""Metadata filters: a small Mongo-style language compiled to a native boolean Column.

Every leaf is two-valued before anything negates it, so a missing field never
matches a positive predicate and always matches its ``$not``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.metadata import check, number, token

BOUNDS = ("$gt", "$gte", "$lt", "$lte")


class Filter:
    """A filter's syntax tree.  Build it with parse(), or with the constructors below."""

    def __and__(self, other: Filter) -> Filter:
        return And((self, other))

    def __or__(self, other: Filter) -> Filter:
        return Or((self, other))

    def __invert__(self) -> Filter:
        return Not(self)


@dataclass(frozen=True)
class And(Filter):
    parts: tuple[Filter, ...]


@dataclass(frozen=True)
class Or(Filter):
    parts: tuple[Filter, ...]


@dataclass(frozen=True)
class Not(Filter):
    part: Filter


@dataclass(frozen=True)
class In(Filter):
    """The value at ``path`` equals one of ``tokens``."""

    path: str
    tokens: tuple[str, ...]


@dataclass(frozen=True)
class Range(Filter):
    path: str
    gt: float | None = None
    gte: float | None = None
    lt: float | None = None
    lte: float | None = None


def eq(path: str, value) -> Filter:
    check(value)
    return In(path, (token(value),))


def is_in(path: str, values) -> Filter:
    check(list(values))
    return In(path, tuple(token(v) for v in values))


def between(path: str, low: float, high: float) -> Filter:
    """Both ends included."""
    return Range(path, gte=float(low), lte=float(high))


def _field(path: str, spec) -> Filter:
    if not (isinstance(spec, dict) and any(k.startswith("$") for k in spec)):
        return eq(path, spec)
    parts: list[Filter] = []
    bounds: dict[str, float] = {}
    for name, value in spec.items():
        if name == "$eq":
            parts.append(eq(path, value))
        elif name == "$in":
            if not isinstance(value, list):
                raise InvalidArgument("$in takes an array")
            parts.append(is_in(path, value))
        elif name in BOUNDS:
            bound = number(value)
            if bound is None:
                raise InvalidArgument(f"{name} takes a number")
            bounds[name[1:]] = bound
        else:
            raise InvalidArgument(f"unknown operator {name!r}")
    if bounds:
        parts.append(Range(path, **bounds))
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def parse(spec, depth: int = 0) -> Filter:
    """A filter object -> its tree; raises InvalidArgument before anything is planned."""
    if isinstance(spec, Filter):
        return spec
    if not isinstance(spec, dict):
        raise InvalidArgument("a filter is an object")
    if depth > 64:
        raise InvalidArgument("a filter is nested too deep")
    parts: list[Filter] = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            if not isinstance(value, list) or not value:
                raise InvalidArgument(f"{key} takes a non-empty array")
            inner = tuple(parse(v, depth + 1) for v in value)
            parts.append(And(inner) if key == "$and" else Or(inner))
        elif key == "$not":
            parts.append(Not(parse(value, depth + 1)))
        elif isinstance(key, str) and key.startswith("$"):
            raise InvalidArgument(f"unknown operator {key!r}")
        elif not isinstance(key, str):
            raise InvalidArgument("a field is named by a string")
        else:
            parts.append(_field(key, value))
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def compiled(spec, meta: Column | str = "meta") -> Column:
    """A filter (object, tree or a boolean Column of your own) as a Column over the projection ``meta``."""
    if isinstance(spec, Column):
        return F.coalesce(spec, F.lit(False))
    meta = F.col(meta) if isinstance(meta, str) else meta

    def build(f: Filter) -> Column:
        if isinstance(f, And):
            return reduce(lambda a, b: a & b, map(build, f.parts), F.lit(True))
        if isinstance(f, Or):
            return reduce(lambda a, b: a | b, map(build, f.parts), F.lit(False))
        if isinstance(f, Not):
            return ~build(f.part)
        found = F.try_element_at(meta, F.lit(f.path))
        if isinstance(f, In):
            return F.coalesce(found["eq"].isin(*f.tokens), F.lit(False)) if f.tokens else F.lit(False)
        n, tests = found["num"], []
        for bound, test in ((f.gt, lambda b: n > b), (f.gte, lambda b: n >= b), (f.lt, lambda b: n < b), (f.lte, lambda b: n <= b)):
            if bound is not None:
                tests.append(test(F.lit(bound)))
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)) if tests else F.coalesce(n.isNotNull(), F.lit(False))

    return build(parse(spec))
