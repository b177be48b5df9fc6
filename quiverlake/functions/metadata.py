"""JSON metadata: strict parsing, canonical text, and the projection that filters run on.

A record's metadata becomes a map from object path to (equality token, number).
Filters are then native Column expressions over map lookups, which tell missing
from null and 1 from "1" or true.  The projection is made by an Arrow UDF; stored
collections do so once, when a record is written.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument

MAX_DEPTH, MAX_BYTES, MAX_VALUES = 64, 1 << 20, 1_000_000
PROJECTION = T.MapType(T.StringType(), T.StructType([T.StructField("eq", T.StringType()), T.StructField("num", T.DoubleType())]))


def _object(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise InvalidArgument("a JSON object repeats a key")
    return out


def _refuse(text):
    raise InvalidArgument(f"{text} is no JSON number")


def _integer(text: str) -> int:
    value = int(text)
    if not -(2**63) <= value < 2**64:
        raise InvalidArgument("an integer is outside 64 bits")
    return value


def _float(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise InvalidArgument("a number is not finite")
    return value


def parse(text: str):
    """Strict JSON: no repeated keys, no NaN, integers within 64 bits."""
    try:
        return json.loads(text, object_pairs_hook=_object, parse_constant=_refuse, parse_int=_integer, parse_float=_float)
    except InvalidArgument:
        raise
    except (ValueError, RecursionError) as e:
        raise InvalidArgument(f"invalid JSON: {e}") from None


def check(value) -> None:
    """Depth, number range and size limits of a metadata value."""
    todo, seen = [(value, 0)], 0
    while todo:
        v, depth = todo.pop()
        seen += 1
        if depth > MAX_DEPTH or seen > MAX_VALUES:
            raise InvalidArgument("metadata is too deep or too large")
        if isinstance(v, bool) or v is None or isinstance(v, str):
            continue
        if isinstance(v, int):
            if not -(2**63) <= v < 2**64:
                raise InvalidArgument("an integer is outside 64 bits")
        elif isinstance(v, float):
            if not math.isfinite(v):
                raise InvalidArgument("a number is not finite")
        elif isinstance(v, dict):
            if any(not isinstance(k, str) for k in v):
                raise InvalidArgument("an object key is no string")
            todo += [(x, depth + 1) for x in v.values()]
        elif isinstance(v, (list, tuple)):
            todo += [(x, depth + 1) for x in v]
        else:
            raise InvalidArgument(f"{type(v).__name__} is no JSON value")


def canonical(value) -> str:
    """Sorted keys, no spaces, number kinds kept."""
    check(value)
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    if len(text.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        raise InvalidArgument("metadata is over 1 MiB")
    return text


def _nested(v) -> str:
    """Within arrays and objects the kinds of numbers count: 1 and 1.0 differ."""
    if v is None or isinstance(v, bool):
        return repr(v)
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, float):
        return f"f{(v + 0.0).hex()}"
    if isinstance(v, str):
        return json.dumps(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_nested(v[k])}" for k in sorted(v)) + "}"
    return "[" + ",".join(map(_nested, v)) + "]"


def token(v) -> str:
    """Equal exactly for values that compare equal; numbers by their double value, a bool is no number."""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"n{(float(v) + 0.0).hex()}"
    if isinstance(v, str):
        return f"s{v}"
    return f"v{_nested(v)}"


def number(v) -> float | None:
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def project(value) -> dict[str, tuple[str, float | None]]:
    """Every path through objects -> (token, number).  Keys with a dot can't be reached; arrays are not entered."""
    out: dict[str, tuple[str, float | None]] = {}
    if not isinstance(value, dict):
        return out
    todo = [(k, v) for k, v in value.items() if "." not in k]
    while todo:
        path, v = todo.pop()
        out[path] = (token(v), number(v))
        if isinstance(v, dict):
            todo += [(f"{path}.{k}", x) for k, x in v.items() if "." not in k]
    return out


def projection(column):
    """metadata_json -> the map that compiled filters read; a null column gives an empty map."""

    @F.pandas_udf(PROJECTION)
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: {} if t is None else {k: {"eq": a, "num": b} for k, (a, b) in project(parse(t)).items()})

    return made(column)
