"""Every registered engine query against DuckDB on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiverlake import catalog_queries as Q
from quiverlake import engine_queries  # noqa: F401  adds to Q
from quiverlake.operators import ivf, search
from quiverlake.functions import vectors as V

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else round(float(v), 6) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    got = duck.execute(Q.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    expected = sorted((tuple(plain(r[names.index(c)]) for c in df.columns) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(x) for x in r) for r in df.collect()), key=repr) == expected


@pytest.mark.parametrize("name", ["explain_plan", "selectivity"])
def test_shares_are_of_all_nodes(spark, tmp_path, name):
    """Twice as many nodes as the planner samples; the share, 301 / 1024, is a tie at the ninth digit."""
    c = duckdb.connect()
    c.execute(f"copy (select i as vec_id, [1::float] as embedding, if(i < 377, 1, 7) as label from range(1024) t(i)) to '{tmp_path}/embeddings.parquet'")
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    expected = c.execute(Q.SQL[name])
    columns = [d[0] for d in expected.description]
    assert [tuple(r) for r in Q.QUERIES[name](spark, f"file://{tmp_path}").select(columns).collect()] == expected.fetchall()


def test_ann_finds_most(spark):
    ann = {r["node"] for r in Q.QUERIES["topk_ann"](spark, DATA).collect()}
    exact = {r["node"] for r in Q.QUERIES["topk_l2"](spark, DATA).collect()}
    assert len(ann & exact) >= 9


def _found(spark, folder, df, metric, k=10, ef=64, asked=60):
    """Share of the exact neighbours of stored vectors that lie in the lists an index probes."""
    n, dim = df.count(), len(df.first()["vector"])
    index = ivf.build(df, folder, metric, n, dim)
    rows = spark.read.parquet(index.path).toArrow()
    x, own = np.array(rows["vector"].to_pylist(), float), np.asarray(rows["list"].combine_chunks())
    hits = 0
    for q in np.random.default_rng(9).choice(n, asked, replace=False):
        d = search._distances(x[q : q + 1], x, metric)[0]
        d[q] = np.inf
        hits += np.isin(own[np.argpartition(d, k)[:k]], ivf.probed(index, x[q], ef)).sum()
    return hits / (k * asked)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test data")
def test_ann_recall_on_sf01(spark, tmp_path):
    """2,000 rows are more than a budget of candidates holds."""
    df = Q.records(spark, LARGER).withColumn("meta", F.lit(None).cast("string"))
    assert _found(spark, f"file://{tmp_path}/lists", df, "cosine") >= 0.95
    ann, exact = ({r["node"] for r in Q.QUERIES[name](spark, LARGER).collect()} for name in ("topk_ann", "topk_l2"))
    assert len(ann & exact) >= 9
    found = {(r["query_id"], r["node"]) for r in Q.QUERIES["ann_batch"](spark, LARGER).collect()}
    c = Q.collection(spark, LARGER)
    true = {(r["query_id"], r["node"]) for r in c.search_batch(c.records().where("node % 20 = 0"), 10, exact=True).collect()}
    assert len(found & true) >= 0.95 * len(true)


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_ann_recall_keeps_with_size(spark, tmp_path, monkeypatch, metric):
    """A sample of 4,000 of 40,000 vectors sets how far searches reach."""
    monkeypatch.setattr(ivf, "SAMPLE_NUMBERS", 4000 * 32)
    x = np.random.default_rng(4).standard_normal((40_000, 32))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
    df = spark.createDataFrame(pa.table({"node": np.arange(len(x)), "id": np.arange(len(x)).astype(str), "vector": pa.FixedSizeListArray.from_arrays(x.astype(np.float32).reshape(-1), 32).cast(pa.list_(pa.float32()))}))
    assert _found(spark, f"file://{tmp_path}/lists", df, metric) >= 0.95


def test_ann_reach_grows_with_ef(spark, tmp_path):
    df = Q.records(spark, DATA)
    index = ivf.build(df, f"file://{tmp_path}/lists", "cosine", 500, 64)
    q = np.array(df.first()["vector"], float)
    lists = [ivf.probed(index, q, ef) for ef in (1, 8, 64, 500, 10_000)]
    assert all(set(a) <= set(b) for a, b in zip(lists, lists[1:], strict=False)) and len(lists[-1]) == len(index.centers)


def test_recall_report(spark):
    rows = sorted(Q.QUERIES["recall_report"](spark, DATA).collect())
    assert [r["ef"] for r in rows] == [16, 64] and rows[1]["recall"] >= 0.9


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_knn_over_many_lanes_matches_brute_force(spark, monkeypatch, metric):
    """Small lanes, blocks and tiles, with repeated vectors: ties go to the earlier node."""
    monkeypatch.setattr(search, "LANE_NUMBERS", 900)
    x = np.random.default_rng(5).integers(-3, 4, (150, 6)).astype(np.float32)
    x[(x == 0).all(1)] = 1
    x[100:] = x[:50]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, vector array<float>")
    got = {(r["query_id"], r["rank"]): (r["node"], r["distance"]) for r in search.knn(df, df.where("node % 3 = 0"), 7, metric, skip_self=True).collect()}
    assert len(got) == 50 * 7
    for i in range(0, 150, 3):
        a, b = x[i].astype(float), x.astype(float)
        d = [sum((p - q) ** 2 for p, q in zip(a, r)) if metric == "l2" else max(0.0, 1 - sum(p * q for p, q in zip(a, r))) if metric == "cosine" else -sum(p * q for p, q in zip(a, r)) for r in b]
        expected = sorted((v, n) for n, v in enumerate(d) if n != i)[:7]
        assert [got[i, k + 1][1] for k in range(7)] == pytest.approx([v for v, _ in expected], abs=1e-12)


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_nearest_takes_the_earliest_of_equals(metric, monkeypatch):
    """Hundreds of equal vectors in any order, and pairs scored again a few at a time."""
    monkeypatch.setattr(search, "PAIR_NUMBERS", 500)
    monkeypatch.setattr(search, "TILE", 97)
    rng = np.random.default_rng(8)
    same = rng.standard_normal(5).astype(np.float32).astype(float)
    same /= np.linalg.norm(same)
    x = np.concatenate([np.tile(same, (400, 1)), np.tile(-same, (20, 1))])
    for _ in range(20):
        node = rng.permutation(len(x))
        got = search._nearest(np.array([7_000, 3]), np.stack([same, same]), node, x, 5, metric, True).to_pydict()
        equals = np.sort(node[:400])
        assert got["query_id"] == [7_000] * 5 + [3] * 5
        assert got["node"] == [*equals[:5], *equals[equals != 3][:5]]


def test_knn_of_empty_sides(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "node long, vector array<float>")
    none = df.where("false")
    assert search.knn(none, df, 3, "l2").count() == 0 and search.knn(df, none, 3, "l2").count() == 0


def test_single_query_plan(spark):
    plan = search.top_k(Q.records(spark, DATA), [0.0] * 64, 10, "l2")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_metric_names():
    assert V.metric("Euclidean") == "l2" and V.metric("ip") == "dot"
    with pytest.raises(ValueError):
        V.metric("euclidean", strict=True)


def test_entry_points():
    import __spark_entry__ as E

    assert set(Q.SQL) <= set(E.oracle_sql()) and set(E.oracle_sql()) <= set(E.queries())
