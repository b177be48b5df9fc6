"""Vector expressions: distances, normalisation, int8 codes, validation.

All are native Columns.  Sums run in double precision over float32 values in
order, so they agree with a plain SQL fold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument

MAX_DIM = 65_536
#: Largest squared norm that a vector may have: float32's largest number over 8.
MAX_SQUARED = 3.4028234663852886e38 / 8
#: Smallest squared norm that has a direction: float32's smallest normal number.
MIN_SQUARED = 1.1754943508222875e-38
METRICS = ("cosine", "l2", "dot")
_ALIASES = {"euclidean": "l2", "ip": "dot", "inner_product": "dot"}


def metric(name: str, strict: bool = False) -> str:
    """The canonical name of a metric.  Names are case-insensitive and have aliases, unless ``strict``."""
    if not isinstance(name, str):
        raise InvalidArgument("a metric is named by a string")
    found = name if strict else _ALIASES.get(name.lower(), name.lower())
    if found not in METRICS:
        raise InvalidArgument(f"unknown metric {name!r}")
    return found


def literal(vector) -> Column:
    """A query vector as a float32 array literal."""
    return F.array(*[F.lit(float(x)).cast("float") for x in vector])


def _fold(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def squared_norm(v: Column) -> Column:
    return _fold(F.transform(v, lambda x: x.cast("double") * x.cast("double")))


def distance(kind: str, a: Column, b: Column) -> Column:
    """Smaller is closer.  cosine expects unit vectors on both sides; l2 is the squared distance; dot is negative."""
    kind = metric(kind)
    if kind == "cosine":
        return F.greatest(F.lit(0.0), F.lit(1.0) - dot(a, b))
    return squared_l2(a, b) if kind == "l2" else -dot(a, b)


def similarity(distance_: Column) -> Column:
    return F.lit(1.0) - distance_


def normalized(v: Column) -> Column:
    """Unit float32 vector; null for a zero or non-finite norm."""
    norm = F.sqrt(squared_norm(v))
    ok = (norm > 0) & ~F.isnan(norm) & (norm < float("inf"))
    return F.when(ok, F.transform(v, lambda x: (x.cast("double") / norm).cast("float")))


def problem(v: Column, dim: int, kind: str) -> Column:
    """Why a vector can't be stored, or null: dimension, not finite, too large, zero (cosine only)."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    why = F.when(v.isNull() | (F.size(v) != dim), "dimension").when(odd, "not finite").when(squared_norm(v) > MAX_SQUARED, "too large")
    return why.when(squared_norm(v) < MIN_SQUARED, "zero") if metric(kind) == "cosine" else why


def int8_scale(v: Column) -> Column:
    """max |x| / 127 as float32, at least the least positive float; 1 for the zero vector."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x))).cast("double")
    return F.when(top == 0, F.lit(1.0)).otherwise(F.greatest(top / 127.0, F.lit(1.401298464324817e-45))).cast("float")


def int8_codes(v: Column, scale: Column) -> Column:
    """round-half-away(x / scale), clamped to -127..127."""
    code = lambda x: F.round((x.cast("double") / scale.cast("double")).cast("float"))
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), code(x).cast("double"))).cast("tinyint"))


def int8_stored_scale(codes: Column, scale: Column, kind: str) -> Column:
    """The scale kept with the codes: for cosine that which makes them a unit vector."""
    if metric(kind) != "cosine":
        return scale
    return (F.lit(1.0) / F.sqrt(_fold(F.transform(codes, lambda c: c.cast("double") * c.cast("double"))))).cast("float")


def int8_decoded(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda c: (c.cast("float") * scale).cast("float"))
