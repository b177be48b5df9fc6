"""More registered queries: commits, handles, refusals and tools of the engine, each with SQL for the rows it must give.

They work on collections of whole tables; what is refused is told by the error's name.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cli
from .catalog_queries import _L2, _LABEL, _LIVE, _first, _one, _Q, collection, query, records, table
from .errors import EngineError
from .functions import vectors as V
from .operators import filters
from .sources import files
from .sources.database import CheckpointPolicy, Database


def _outcomes(spark, cases) -> DataFrame:
    """(name, outcome) of functions: what they return as text, or their error's name."""
    rows = []
    for name, f in cases:
        try:
            rows.append((name, str(f())))
        except EngineError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "name string, outcome string")


def _values(rows: str) -> str:
    return f"SELECT * FROM (VALUES {rows}) AS t(name, outcome)"


def _new(spark, name: str, **options) -> Database:
    return Database.create(spark, files.shared(spark, name), **options)


def _nations(spark, sf_dir) -> DataFrame:
    """Nations as records: two numbers each."""
    n = table(spark, sf_dir, "nation").orderBy("n_nationkey")
    vector = F.array(F.col("n_nationkey").cast("float"), F.col("n_regionkey").cast("float"))
    return n.select(F.col("n_name").alias("id"), vector.alias("vector"), F.concat(F.lit('{"region":'), F.col("n_regionkey").cast("string"), F.lit("}")).alias("metadata_json"))


@query(_values("('Cosine', 'cosine'), ('EUCLIDEAN', 'l2'), ('l2', 'l2'), ('ip', 'dot'), ('Inner_Product', 'dot'), ('dot', 'dot'), ('hamming', 'InvalidArgument'), ('', 'InvalidArgument')"))
def metric_names(spark, sf_dir):
    return _outcomes(spark, [(name, lambda name=name: V.metric(name)) for name in ("Cosine", "EUCLIDEAN", "l2", "ip", "Inner_Product", "dot", "hamming", "")])


_SPECS = ['{"a":1}', '{"a":{"$gt":1,"$lte":2}}', "{}", '{"$or":[]}', '{"$not":[]}', '{"a":{"$in":1}}', '{"a":{"$lt":true}}', '{"a":{"$gt":1,"b":2}}', '{"$xor":[{}]}', "[]"]


@query(_values(", ".join(f"('{s}', '{'accepted' if i < 3 else 'InvalidArgument'}')" for i, s in enumerate(_SPECS))))
def filter_errors(spark, sf_dir):
    return _outcomes(spark, [(s, lambda s=s: filters.parse(json.loads(s)) and "accepted") for s in _SPECS])


@query(f"SELECT node FROM {_LIVE} WHERE (vec_id % 7 IN (1, 4) OR NOT {_LABEL} >= 3 AND label <= 6)) AND vec_id % 2 = 0")
def filter_builder(spark, sf_dir):
    """A filter made by the constructors, not parsed."""
    made = (filters.is_in("bucket", [1, 4]) | ~filters.between("label", 3, 6)) & filters.eq("nested.even", True)
    return collection(spark, sf_dir).records().where(filters.compiled(made)).select("node")


@query(f"SELECT node FROM (SELECT node, {_L2.format(a='embedding', b='q')} AS d FROM {_LIVE}, {_Q}) ORDER BY d, node LIMIT 40 OFFSET 10")
def visit_search(spark, sf_dir):
    """A search's hits as a frame that the caller goes on with: those after the tenth."""
    return collection(spark, sf_dir).search_frame(_first(spark, sf_dir), 50, exact=True).select("node", "distance").orderBy("distance", "node").offset(10).select("node")


@query(_values("('k 0', 'InvalidArgument'), ('k true', 'InvalidArgument'), ('ef 0', 'InvalidArgument'), ('dimension', 'InvalidArgument'), ('not finite', 'InvalidArgument'), ('too large', 'InvalidArgument'), ('text', 'InvalidArgument'), ('portable k', 'InvalidArgument'), ('no such id', 'NotFound'), ('fine', '1')"))
def search_errors(spark, sf_dir):
    c, q = collection(spark, sf_dir), _first(spark, sf_dir)
    cases = {
        "k 0": lambda: c.search(q, 0), "k true": lambda: c.search(q, True, exact=True), "ef 0": lambda: c.search(q, 1, ef=0), "dimension": lambda: c.search(q[1:], 1), "not finite": lambda: c.search([float("nan"), *q[1:]], 1),
        "too large": lambda: c.search([3e38, *q[1:]], 1), "text": lambda: c.search("query", 1), "portable k": lambda: c.search_portable(q, 10_001), "no such id": lambda: c.like("-1"), "fine": lambda: len(c.search(q, 1, exact=True)),
    }
    return _outcomes(spark, cases.items())


@query("SELECT n_name AS id, n_regionkey AS region FROM nation WHERE n_regionkey <> 3")
def portable_upserts(spark, sf_dir):
    """A batch with a repeated id, or of over 256 records, is refused whole; the others are in."""
    c = _new(spark, "portable").create_collection("x", 2, "l2")
    rows = [(r["id"], r["vector"], json.loads(r["metadata_json"])) for r in _nations(spark, sf_dir).collect()]  # 25 records
    for region in range(5):
        batch = [r for r in rows if r[2]["region"] == region]
        try:
            c.upsert_portable(batch + batch[:1] if region == 3 else batch)
        except EngineError:
            pass
    try:
        c.upsert_portable([(f"n{i}", [1, 1], None) for i in range(257)])
    except EngineError:
        pass
    return c.records().select("id", F.get_json_object("metadata_json", "$.region").cast("long").alias("region"))


@query("SELECT n_name AS id, CAST(n_nationkey AS DOUBLE) AS x, CAST(n_regionkey AS DOUBLE) AS y FROM nation")
def array_source(spark, sf_dir):
    rows = _nations(spark, sf_dir).collect()  # 25 records
    with _new(spark, "arrays") as db:
        c = db.create_collection("x", 2, "l2")
        c.upsert_arrays([r["id"] for r in rows], np.array([r["vector"] for r in rows]))
    back = Database.open_read_only(spark, db.path).collection("x").records()
    return back.select("id", F.col("vector")[0].cast("double").alias("x"), F.col("vector")[1].cast("double").alias("y"))


@query(_values("('after an error', '25'), ('unsaved', '26'), ('reloaded', '25'), ('written to a snapshot', 'InvalidArgument'), ('sequence', '1')"))
def rollback(spark, sf_dir):
    """An error inside a with block, and reload(), leave the last commit."""
    with _new(spark, "rollback") as db:
        db.create_collection("x", 2, "l2").upsert_frame(_nations(spark, sf_dir))
    try:
        with Database.open(spark, db.path) as other:
            other.collection("x").upsert("new", [1, 1])
            raise RuntimeError
    except RuntimeError:
        pass
    read = lambda: Database.open(spark, db.path).collection("x").count()
    mine = Database.open(spark, db.path)
    c = mine.collection("x")
    c.upsert("new", [1, 1])
    return _outcomes(spark, [("after an error", read), ("unsaved", c.count), ("reloaded", lambda: mine.reload() or mine.collection("x").count()), ("written to a snapshot", lambda: mine.snapshot().collection("x").delete("PERU")), ("sequence", lambda: mine.sequence)])


@query(_values("('names', 'a b t'), ('again', 'AlreadyExists'), ('same token', 't'), ('other definition', 'Conflict'), ('unknown', 'NotFound'), ('bad dimension', 'InvalidArgument'), ('bad metric', 'InvalidArgument'), ('bad name', 'InvalidArgument'), ('dropped', 'a t'), ('stale handle', 'NotFound'), ('its successor', '0')"))
def collection_catalog(spark, sf_dir):
    db = _new(spark, "names")
    db.create_collection("b", 2).upsert("x", [1, 1])
    db.create_collection("a", 2)
    db.create_collection("t", 2, token="one")
    stale = db.collection("b")
    cases = [
        ("names", lambda: " ".join(c.name for c in db)), ("again", lambda: db.create_collection("a", 2)), ("same token", lambda: db.create_collection("t", 2, token="one").name), ("other definition", lambda: db.create_collection("t", 3, token="one")),
        ("unknown", lambda: db.collection("z")), ("bad dimension", lambda: db.create_collection("d", 0)), ("bad metric", lambda: db.create_collection("d", 2, "hamming")), ("bad name", lambda: db.create_collection("", 2)),
        ("dropped", lambda: db.drop_collection("b") or " ".join(db.names())), ("stale handle", lambda: (db.create_collection("b", 2), stale.count())), ("its successor", lambda: db.collection("b").count()),
    ]
    return _outcomes(spark, cases)


@query(_values("('second writer', 'Conflict'), ('after reload', '2'), ('both', 'one two')"))
def commit_conflict(spark, sf_dir):
    one = _new(spark, "conflict")
    two = Database.open(spark, one.path)
    one.create_collection("one", 2)
    one.save()
    two.create_collection("lost", 2)

    def again():
        two.reload()
        two.create_collection("two", 2)
        return two.save()

    return _outcomes(spark, [("second writer", two.save), ("after reload", again), ("both", lambda: " ".join(Database.open(spark, one.path).names()))])


@query("SELECT n_name AS id, CAST(n_nationkey AS DOUBLE) AS x, 1 AS files, true AS merged FROM nation WHERE n_regionkey <> 2")
def checkpointed(spark, sf_dir):
    """A commit for each region, merged by the policy as they come and by hand in the end; replayed by a new handle."""
    rows, db = _nations(spark, sf_dir), _new(spark, "checkpoint", policy=CheckpointPolicy(commits=2))
    c = db.create_collection("x", 2, "l2")
    for region in range(5):
        c.upsert_frame(rows.where(F.col("vector")[1] == region))
        db.save()
    c.delete_frame(rows.where(F.col("vector")[1] == 2).select("id"))
    db.checkpoint()
    db.vacuum()
    db.verify()
    again = Database.open(spark, db.path).collection("x")
    return again.records().select("id", F.col("vector")[0].cast("double").alias("x"), F.lit(len(again._entry["files"])).alias("files"), F.lit(db.stats()["checkpoints"] > 1).alias("merged"))


@query("SELECT n_name AS id, n_regionkey AS region FROM nation WHERE n_nationkey % 4 <> 0")
def upgraded_storage(spark, sf_dir):
    """A database of the first format, where deletes are rows, brought up to date."""
    at, rows = files.shared(spark, "former"), table(spark, sf_dir, "nation")
    former = rows.select(F.col("n_name").alias("id"), F.col("n_nationkey").cast("long").alias("node"), F.lit(False).alias("deleted"), F.array(F.col("n_regionkey").cast("float")).alias("vector"))
    former = former.unionByName(former.where("node % 4 = 0").withColumns({"deleted": F.lit(True), "vector": F.lit(None).cast("array<float>")}))
    former = former.withColumns({"codes": F.lit(None).cast("array<tinyint>"), "scale": F.lit(None).cast("float"), "metadata_json": F.lit(None).cast("string")})
    former.write.parquet(f"{at}/data/u/one")
    config = {"dim": 1, "metric": "l2", "m": 16, "ef_construction": 200, "ef_search": 64, "precision": "f32"}
    state = {"format": 1, "identity": "i", "sequence": 0, "delta_bytes": 0, "delta_commits": 0, "checkpoints": 0, "collections": {"x": {"uid": "u", "token": None, "config": config, "next": 25, "files": ["data/u/one"]}}}
    files.write(spark, f"{at}/catalog/{0:020d}.json", json.dumps(state).encode())
    return Database.upgrade(spark, at).collection("x").records().select("id", F.col("vector")[0].cast("long").alias("region"))


@query(f"SELECT count(*) AS rows, count(*) AS visited, 1.0::DOUBLE AS recall FROM {_LIVE}")
def index_of_all_lists(spark, sf_dir):
    """The index holds every live record, and with all of its lists probed it finds what exact search finds."""
    c = collection(spark, sf_dir)
    built, report = c.build_index(), c.estimate_recall(10, 20, [c.count()]).first()
    return _one(spark, (built["rows"], report["visited_p95"], report["recall"]), "rows long, visited long, recall double")


@query(f"SELECT vec_id AS query, node FROM (SELECT a.vec_id, b.node, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_L2.format(a='a.embedding', b='b.embedding')}, b.node) AS rank FROM {_LIVE} a, {_LIVE} b WHERE a.vec_id IN (1, 2, 3, 4)) WHERE rank <= 3")
def async_searches(spark, sf_dir):
    """Four searches beside each other."""
    c = collection(spark, sf_dir)
    futures = {i: c.search_async(c.get(str(i))["vector"], 3, exact=True) for i in (1, 2, 3, 4)}
    return spark.createDataFrame([(i, h["node"]) for i, f in futures.items() for h in f.result()], "query long, node long")


@query("SELECT 'embeddings: compact would drop ' || count(*) FILTER (WHERE vec_id % 5 = 0) || ' nodes' AS hint, count(*) FILTER (WHERE vec_id % 5 = 0) AS dropped, count(*) FILTER (WHERE vec_id % 5 <> 0) AS live FROM embeddings")
def inspect_hint(spark, sf_dir):
    """The command line's inspect suggests compact, which does what it says."""
    rows, said = records(spark, sf_dir), []
    with _new(spark, "inspect") as db:
        c = db.create_collection("embeddings", 2, "l2")
        c.upsert_frame(rows.select("id", F.slice("vector", 1, 2).alias("vector")))
        c.delete_frame(rows.where("node % 5 = 0").select("id"))
    run = lambda *a: cli.run(spark, cli.parser().parse_args([db.path, *a]), said.append)
    run("inspect")
    hint = said[-1]
    run("compact", "embeddings")
    return _one(spark, (hint, said[-1], Database.open(spark, db.path).collection("embeddings").count()), "hint string, dropped long, live long")
