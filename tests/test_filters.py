"""Filters against an evaluator of their own over generated weather-station records, and by case."""

import random

import pytest
from pyspark.sql import functions as F

from quiverlake.errors import InvalidArgument
from quiverlake.functions import metadata as M
from quiverlake.operators import filters

CITIES = ["Bergen", "Oslo", "", "7", "São Paulo"]


def station(rng):
    """A record of mixed shape: fields come and go, and change their kind."""
    out = {}
    if rng.random() < 0.8:
        out["city"] = rng.choice([*CITIES, None, CITIES[:2]])
    if rng.random() < 0.8:
        out["height"] = rng.choice([0, 7, 7.0, -0.0, 2**53 + 1, 1e300, True, "7", None])
    if rng.random() < 0.7:
        out["probe"] = rng.choice([{}, {"kind": "wind", "depth": rng.choice([3, 3.5, None])}, {"kind": {"name": "rain", "on": rng.random() < 0.5}}, [3], "wind"])
    if rng.random() < 0.4:
        out["readings"] = rng.choice([[], [7], [7.0], [7, None], [[7]], [{"kind": "wind"}]])
    if rng.random() < 0.3:
        out["probe.kind"] = "wind"
    return rng.choice([out, out, out, out, None, "Oslo", 7, [out]])


VALUES = [*CITIES, None, True, False, 0, 7, 7.0, 2**53, 2**53 + 1, [], [7], [7.0], [7, None], {}, {"kind": "wind", "depth": 3}, ["Bergen", "Oslo"]]
PATHS = ["city", "height", "probe", "probe.kind", "probe.depth", "probe.kind.name", "probe.kind.on", "readings", "none", "city.x"]


def spec_of(rng, records, depth=0):
    """A filter; most values are ones that some record has there."""
    path = rng.choice(PATHS)
    there = [v for v in (reach(r, path) for r in records) if v is not MISSING]
    some = lambda: rng.choice(there) if there and rng.random() < 0.8 else rng.choice(VALUES)
    kind = rng.choice(["leaf"] * 5 + ["and", "or", "not", "fields"]) if depth < 3 else "leaf"
    if kind in ("and", "or"):
        return {f"${kind}": [spec_of(rng, records, depth + 1) for _ in range(rng.randint(1, 3))]}
    if kind == "not":
        return {"$not": spec_of(rng, records, depth + 1)}
    if kind == "fields":
        return {path: {"$eq": some()}, **({"height": 7} if path != "height" else {"city": rng.choice(CITIES)})}
    test = rng.choice(["plain", "$eq", "$in", "bounds"])
    if test == "bounds":
        return {rng.choice(["height", "probe.depth", path]): {b: rng.choice([-1, 0, 3, 7, 7.5, 2**53]) for b in rng.sample(["$gt", "$gte", "$lt", "$lte"], rng.randint(1, 2))}}
    value = [some() for _ in range(rng.randint(0, 4))] if test == "$in" else some()
    return {path: value if test == "plain" else {test: value}}


# the evaluator: from the rules of the language, one record at a time

MISSING = object()


def is_number(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def reach(record, path):
    for key in path.split("."):
        if not isinstance(record, dict) or key not in record:
            return MISSING
        record = record[key]
    return record


def alike(a, b):
    """As values inside arrays and objects: numbers of different kinds differ."""
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(alike(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(alike, a, b))
    return a == b


def equal(a, b):
    return float(a) == float(b) if is_number(a) and is_number(b) else alike(a, b)


def holds(spec, record):
    for key, want in spec.items():
        if key == "$and":
            ok = all(holds(s, record) for s in want)
        elif key == "$or":
            ok = any(holds(s, record) for s in want)
        elif key == "$not":
            ok = not holds(want, record)
        else:
            got = reach(record, key)
            tests = want if isinstance(want, dict) and any(k.startswith("$") for k in want) else {"$eq": want}
            ok = got is not MISSING
            for name, value in tests.items() if ok else ():
                if name == "$eq":
                    ok = ok and equal(got, value)
                elif name == "$in":
                    ok = ok and any(equal(got, v) for v in value)
                else:
                    ok = ok and is_number(got) and {"$gt": float(got) > value, "$gte": float(got) >= value, "$lt": float(got) < value, "$lte": float(got) <= value}[name]
        if not ok:
            return False
    return True


def selected(spark, records, specs):
    """For each filter the places of the records that it selects, in one job."""
    rows = [(i, None if r is None else M.canonical(r)) for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, "i int, metadata_json string").withColumn("meta", M.projection(F.col("metadata_json")))
    got = df.select("i", F.array(*[filters.compiled(s) for s in specs]).alias("hit")).collect()
    return [{r["i"] for r in got if r["hit"][k]} for k in range(len(specs))]


def test_generated_filters_match_the_evaluator(spark):
    rng = random.Random(20)
    records = [station(rng) for _ in range(150)]
    specs = [spec_of(rng, records) for _ in range(120)]
    expected = [{i for i, r in enumerate(records) if holds(s, r)} for s in specs]
    assert sum(0 < len(e) < len(records) for e in expected) > 60
    for spec, got, want in zip(specs, selected(spark, records, specs), expected, strict=True):
        assert got == want, spec


def test_by_case(spark):
    records = [{"depth": 4}, {"depth": 4.0}, {"depth": True}, {"depth": None}, {}, None, {"depth": [4]}, {"depth": [4.0]}, {"a": {"b": 1}}, {"a.b": 1}, {"a": [{"b": 1}]}, {"": 2}]
    cases = [
        ({}, set(range(12))),
        ({"depth": 4}, {0, 1}),
        ({"depth": True}, {2}),
        ({"depth": None}, {3}),
        ({"$not": {"depth": None}}, set(range(12)) - {3}),
        ({"depth": {"$lte": 4}}, {0, 1}),
        ({"depth": [4]}, {6}),
        ({"a.b": 1}, {8}),
        ({"": {"$gt": 1}}, {11}),
        (filters.between("depth", 3, 4) | filters.eq("a.b", 1), {0, 1, 8}),
        (filters.between("depth", 3, 4) & ~filters.is_in("depth", [4, 5]), set()),
    ]
    assert selected(spark, records, [spec for spec, _ in cases]) == [want for _, want in cases]


@pytest.mark.parametrize(
    "spec",
    [[], 3, {"$and": []}, {"$or": {}}, {"$or": [7]}, {"$not": None}, {"$nor": [{}]}, {"h": {"$in": "Oslo"}}, {"h": {"$lt": "7"}}, {"h": {"$gte": False}}, {"h": {"$gte": None}}, {"h": {"$gt": 1, "more": 2}}, {"h": {"$near": 1}}],
)
def test_refuses(spec):
    with pytest.raises(InvalidArgument):
        filters.parse(spec)


def test_depth_is_bounded():
    spec = {"x": 1}
    for _ in range(70):
        spec = {"$not": spec}
    with pytest.raises(InvalidArgument):
        filters.parse(spec)


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', "NaN", "18446744073709551616", "1e400", "{", "[1,]"])
def test_strict_json(text):
    with pytest.raises(InvalidArgument):
        M.parse(text)


def test_tokens_keep_kinds_apart():
    values = [None, True, 1, "1", [1], [1.0], {"a": 1}, {"a": True}, "n0x1.0000000000000p+0", ""]
    assert len({M.token(v) for v in values}) == len(values)
    assert M.token(-0.0) == M.token(0) and M.token(1) == M.token(1.0)
