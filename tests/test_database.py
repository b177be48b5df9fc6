import json
import random

import numpy as np
import pytest

from quiverlake import cli
from quiverlake.errors import AlreadyExists, Conflict, CorruptData, InvalidArgument, NotFound
from quiverlake.sources import archive, database, files, jsonl
from quiverlake.sources.database import CheckpointPolicy, Database
from quiverlake.streaming.upserts import upsert_stream


def gauss(n, dim, seed=307):
    rng = random.Random(seed)
    return [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(n)]


def test_mutations_commits_and_snapshots(spark, place):
    db = Database.create(spark, place)
    c = db.create_collection("x", 4, "l2")
    c.upsert_many((str(i), [i, 0, 0, 0], {"v": i}) for i in range(20))
    assert db.save() == 1 and db.save() == 1
    view = db.snapshot()
    c.upsert("3", [100, 0, 0, 0], {"v": -3})
    assert c.delete("5") and not c.delete("5") and not c.contains("5")
    assert (c.count(), c.get("3")["metadata"]) == (19, {"v": -3})
    db.save()
    assert view.collection("x").count() == 20 and view.collection("x").get("3")["metadata"] == {"v": 3}
    with pytest.raises(InvalidArgument):
        view.collection("x").upsert("1", [0] * 4)
    page = c.records_page(0, 5)
    assert [r["id"] for r in page.records] == ["0", "1", "2", "4", "6"] and page.next_offset == 7
    stats = c.stats()
    assert (stats["live"], stats["deleted"], stats["vector_bytes"]) == (19, 2, 21 * 16)
    assert c.compact() == 2 and c.compact() == 0
    assert [r["node"] for r in c.iter_records()] == list(range(19))
    assert [h["id"] for h in c.search([0, 0, 0, 0], 3)] == ["0", "1", "2"]
    db.checkpoint()
    again = Database.open(spark, place)
    assert again.collection("x").count() == 19 and again.sequence == db.sequence


def test_batches_are_atomic_and_last_wins(spark, place):
    db = Database.create(spark, place)
    c = db.create_collection("x", 2, "cosine")
    with pytest.raises(InvalidArgument):
        c.upsert_many([("a", [1, 0]), ("b", [0, 1]), ("c", [0, 0])])
    assert c.count() == 0
    assert c.upsert_many([("a", [1, 0], 1), ("b", [0, 1], 2), ("a", [3, 4], 3)]) == 3
    assert c.count() == 2 and c.get("a")["metadata"] == 3 and np.allclose(c.get("a")["vector"], [0.6, 0.8])
    with pytest.raises(InvalidArgument):
        c.upsert_portable([("a", [1, 0]), ("a", [0, 1])])
    frame = spark.createDataFrame([("d", [1.0, 1.0], None), ("e", [0.0, 0.0], None)], "id string, vector array<float>, metadata_json string")
    with pytest.raises(InvalidArgument):
        c.upsert_frame(frame)
    assert c.upsert_frame(frame.limit(1)) == 1 and c.contains("d")


@pytest.mark.parametrize("vector", [[1], [1, float("nan")], [True, 1], "ab", [1, "2"], [3e38, 3e38], [0, 0], [1e39, 0]])
def test_bad_vectors(spark, place, vector):
    c = Database.create(spark, place).create_collection("x", 2)
    with pytest.raises(InvalidArgument):
        c.upsert("a", vector)


def test_writers_conflict_and_handles_go_stale(spark, place):
    one = Database.create(spark, place)
    one.create_collection("x", 2)
    two = Database.open(spark, place)
    two.create_collection("y", 2)
    one.save()
    with pytest.raises(Conflict):
        two.save()
    two.reload()
    assert two.names() == ["x"]
    handle = two.collection("x")
    two.drop_collection("x")
    two.create_collection("x", 2)
    with pytest.raises(NotFound):
        handle.count()
    with pytest.raises(AlreadyExists):
        two.create_collection("x", 3)
    two.create_collection("t", 2, token="k")
    two.create_collection("t", 2, token="k")
    with pytest.raises(Conflict):
        two.create_collection("t", 3, token="k")


def test_context_saves_only_a_clean_exit(spark, place):
    with Database.create(spark, place) as db:
        db.create_collection("x", 2)
    with pytest.raises(RuntimeError), Database.open(spark, place) as db:
        db.create_collection("y", 2)
        raise RuntimeError
    assert Database.open(spark, place).names() == ["x"]
    with pytest.raises(NotFound):
        Database.open(spark, place + "-none")


def test_automatic_checkpoint_and_vacuum(spark, place):
    db = Database.create(spark, place, policy=CheckpointPolicy(commits=3))
    c = db.create_collection("x", 2)
    for i in range(4):
        c.upsert(str(i), [1, i])
        db.save()
    assert db.stats()["checkpoints"] >= 1 and c.count() == 4
    db.vacuum()
    assert Database.open(spark, place).collection("x").count() == 4
    files.write(spark, f"{place}/catalog/{db.sequence:020d}.json", b"{")
    with pytest.raises(CorruptData):
        Database.open(spark, place)


def test_cursor_is_bound_to_its_state(spark, place):
    db = Database.create(spark, place)
    c = db.create_collection("x", 2)
    c.upsert_many((str(i), [1, i]) for i in range(5))
    rows, cursor = c.page(limit=3)
    assert len(rows) == 3 and [r["id"] for r in c.page(cursor, 3)[0]] == ["3", "4"]
    with pytest.raises(InvalidArgument):
        c.page("nonsense")
    c.upsert("9", [1, 9])
    with pytest.raises(Conflict):
        c.page(cursor)


def test_recall_sample_ignores_how_nodes_are_counted(spark, place, monkeypatch):
    rng = np.random.default_rng(3)
    with Database.create(spark, place) as db:
        c = db.create_collection("c", 8, "l2")
        c.upsert_many([(str(i), rng.normal(size=8).tolist(), None) for i in range(200)])
        for i in (0, 63, 64, 150):
            c.delete(str(i))
        one = c.estimate_recall(3, 15, [8]).drop("seconds").collect()
        monkeypatch.setattr(database, "NODE_SPAN", 32)
        assert c.estimate_recall(3, 15, [8]).drop("seconds").collect() == one


def test_index_recall_and_filters(spark, place):
    db = Database.create(spark, place)
    c = db.create_collection("x", 16, "cosine", m=8)
    data = gauss(1500, 16)
    c.upsert_many((str(i), v, {"group": i % 3}) for i, v in enumerate(data))
    report = c.estimate_recall(10, 12, [16, 128]).orderBy("ef").collect()
    assert report[1]["recall"] >= 0.95 and report[0]["recall"] <= report[1]["recall"]
    plan = c.explain(data[0], 10, filter={"group": 1})
    assert 0.25 <= plan.filter_selectivity <= 0.42 and len(plan.hits) == 10
    x = np.array(data)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    truth = [i for i in np.argsort(-(x @ x[0])) if i % 3 == 1][:10]
    assert len({h["id"] for h in plan.hits} & {str(i) for i in truth}) >= 9
    assert [h["id"] for h in c.search(data[0], 10, exact=True, filter={"group": 1})] == [str(i) for i in truth]
    assert c.like("7", 1, exact=True)[0]["id"] == "7"


def test_filter_that_goes_with_the_vectors_finds_all(spark, place):
    """Matching records lie away from the query: none in the probed lists, or some but not the nearest."""
    x = np.array(gauss(3000, 4))
    x[2000:, 0] += 20
    q = [0.0] * 4
    d = (x**2).sum(1)
    with Database.create(spark, place) as db:
        c = db.create_collection("x", 4, "l2")
        c.upsert_many((str(i), v.tolist(), {"topic": int(i >= 2000), "far": bool(d[i] > 5)}) for i, v in enumerate(x))
        for name, value, match in (("topic", 1, np.arange(3000) >= 2000), ("far", True, d > 5)):
            assert c.plan(5, 8, filter={name: value}).strategy == "index"
            report = c.explain(q, 5, 8, filter={name: value})
            truth = sorted(np.flatnonzero(match), key=lambda i: d[i])[:5]
            assert [h["id"] for h in report.hits] == [str(i) for i in truth] and report.strategy == "filtered_exact"
        near = c.explain(q, 2, 8, filter={"topic": 0})
        assert near.strategy == "index" and [h["id"] for h in near.hits] == [str(i) for i in np.argsort(d)[:2]] and near.visited < 3000


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_int8_recall(spark, place, metric):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (180, 64)).astype(np.float32)
    db = Database.create(spark, place)
    c = db.create_collection("x", 64, metric, precision="int8")
    c.upsert_many((str(i), v.tolist()) for i, v in enumerate(x))
    u = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
    hits = 0
    for q in range(0, 180, 60):
        d = ((u - u[q]) ** 2).sum(1) if metric == "l2" else -(u @ u[q])
        hits += len({str(i) for i in np.argsort(d)[:5]} & {h["id"] for h in c.search(x[q].tolist(), 5, exact=True)})
    assert hits >= 14 and c.stats()["vector_bytes"] == 180 * 68


def test_archive_round_trip_and_damage(spark, place):
    db = Database.create(spark, place)
    c = db.create_collection("x", 2, "cosine")
    c.upsert_many([("01", [1, 0], {"tag": "original", "nullable": None}), ("東京", [0, 1], [True, 1, "v1"])])
    db.create_collection("empty", 3, "l2")
    db.save()
    manifest = archive.export(db, f"{place}-out")
    assert [(m["name"], m["records"]) for m in manifest["collections"]] == [("empty", 0), ("x", 2)]
    assert files.read(spark, f"{place}-out/0001.jsonl").decode() == '{"id":"01","metadata":{"nullable":null,"tag":"original"},"vector":[1.0,0.0]}\n{"id":"東京","metadata":[true,1,"v1"],"vector":[0.0,1.0]}\n'
    with pytest.raises(AlreadyExists):
        archive.export(db, f"{place}-out")
    other = Database.create(spark, f"{place}-two")
    archive.restore(other, f"{place}-out", dry_run=True)
    assert other.names() == []
    archive.restore(other, f"{place}-out")
    assert other.collection("x").get("東京")["metadata"] == [True, 1, "v1"]
    with pytest.raises(Conflict):
        archive.restore(other, f"{place}-out")
    archive.restore(other, f"{place}-out", resume=True)
    good = files.read(spark, f"{place}-out/manifest.json")
    for old, new in ((b'"version": 1', b'"version": 2'), (b'"records": 2', b'"records": 3'), (b"0001.jsonl", b"../1.jsonl"), (b'"cosine"', b'"l2"'), (b'"format"', b'"format": "x", "format"')):
        files.write(spark, f"{place}-out/manifest.json", good.replace(old, new, 1))
        with pytest.raises(CorruptData):
            archive.inspect(spark, f"{place}-out")


def test_json_lines_are_strict(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"id": 7, "vector": [1, 2]}\n\n{"id": "b", "vector": [1, 2.5], "metadata": {"a": 1.0}}\n')
    rows = jsonl.load(spark, f"file://{path}").orderBy("id").collect()
    assert [(r["id"], r["metadata_json"]) for r in rows] == [("7", None), ("b", '{"a":1.0}')]
    path.write_text('{"id": "a", "vector": [1]}\n{"id": "b", "vector": [true]}\n')
    with pytest.raises(InvalidArgument, match="line 2"):
        jsonl.load(spark, f"file://{path}")


def test_stream_and_command_line(spark, place, tmp_path):
    said = []
    run = lambda *a: cli.run(spark, cli.parser().parse_args([place, *a]), said.append)
    run("init")
    run("create-collection", "fruit", "--dim", "2", "--metric", "l2")
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("".join(json.dumps({"id": f"f{i}", "vector": [i, 0], "metadata": {"price": i / 2}}) + "\n" for i in range(6)))
    run("insert", "fruit", f"file://{source}/a.json")
    run("query", "fruit", "--vector", "[0, 0]", "-k", "2", "--filter", '{"price": {"$gt": 0.5}}', "--explain")
    assert json.loads(said[2])["id"] == "f2" and "filtered_exact" in said[4]
    run("delete", "fruit", "f0", "none")
    assert said[-1] == 1
    db = Database.open(spark, place)
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.json").write_text('{"id": "s", "vector": [9.0, 9.0], "metadata_json": "{}"}\n')
    stream = spark.readStream.schema("id string, vector array<float>, metadata_json string").json(f"file://{tmp_path}/s")
    upsert_stream(stream, db, "fruit", f"file://{tmp_path}/ck").awaitTermination()
    assert Database.open(spark, place).collection("fruit").contains("s")
    run("inspect")
    run("compact", "fruit")
    assert said[-1] == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_search_shuffles_nothing_and_runs_no_python(spark, place):
    c = Database.create(spark, place).create_collection("x", 3, "l2")
    c.upsert_many((str(i), [i, 0, 0], {"v": i}) for i in range(30))
    query = lambda: c.search_frame([0, 0, 0], 5, exact=True, filter={"v": {"$gte": 4}})
    plan = plan_of(query())
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan and "TakeOrderedAndProject" in plan
    c.upsert("4", [9, 9, 9], {"v": 4})
    c.delete("5")
    plan = plan_of(query())
    assert "Python" not in plan and "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert [h["id"] for h in query().collect()] == ["6", "7", "8", "9", "10"]
    c.compact()
    assert "Join" not in plan_of(query()) and [h["id"] for h in query().collect()] == ["6", "7", "8", "9", "10"]


def test_bulk_delete_and_replacement_keep_the_counts(spark, place):
    rng, model = random.Random(4), {}
    with Database.create(spark, place) as db:
        c = db.create_collection("x", 1, "l2")
        for step in range(4):
            batch = [(f"k{rng.randrange(40)}", [step * 1000 + i], {"step": step}) for i in range(30)]
            c.upsert_frame(spark.createDataFrame([(i, [float(v[0])], json.dumps(m)) for i, v, m in batch], "id string, vector array<float>, metadata_json string").coalesce(1))
            model |= {i: v[0] for i, v, _ in batch}
            gone = {f"k{rng.randrange(60)}" for _ in range(8)}
            assert c.delete_frame(spark.createDataFrame([(g,) for g in gone] * 2, "id string")) == len(gone & model.keys())
            model = {i: v for i, v in model.items() if i not in gone}
            assert {r["id"]: r["vector"][0] for r in c.records().collect()} == model and c.count() == len(model)
        assert c.delete_frame(spark.createDataFrame([], "id string")) == 0
    db.checkpoint()
    again = Database.open(spark, place).collection("x")
    assert len(again._entry["files"]) == len(again._entry["dead"]) == 1 and {r["id"] for r in again.records().collect()} == model.keys()
    db.verify()


def test_a_failed_batch_stages_nothing(spark, place):
    c = Database.create(spark, place).create_collection("x", 1, "l2")
    c.upsert("a", [1], 1)
    before = json.dumps(c._entry)
    with pytest.raises(InvalidArgument):
        c.upsert_frame(spark.createDataFrame([("b", [1.0], "{}"), ("c", [1.0], "{not json")], "id string, vector array<float>, metadata_json string"))
    assert json.dumps(c._entry) == before


def test_index_is_kept_extended_and_rebuilt(spark, place, monkeypatch):
    built = []
    monkeypatch.setattr(database.ivf, "build", lambda *a, f=database.ivf.build, **k: built.append(1) or f(*a, **k))
    data = gauss(600, 8)
    rows = lambda a, b: [(str(i), data[i], {"i": i}) for i in range(a, b)]
    with Database.create(spark, place) as db:
        c = db.create_collection("x", 8, "l2")
        c.upsert_many(rows(0, 400))
        assert c.build_index()["rows"] == 400
    db = Database.open(spark, place)
    c = db.collection("x")
    exact = lambda q: [h["id"] for h in c.search(q, 5, exact=True)]
    assert [h["id"] for h in c.search(data[7], 5, ef=600)] == exact(data[7]) and len(built) == 1
    # new records go to the lists that there are, deleted ones leave the results
    c.upsert_many(rows(400, 600))
    c.delete("7")
    c.upsert("8", [50.0] * 8)
    assert [h["id"] for h in c.search(data[450], 5, ef=700)] == exact(data[450]) and len(built) == 1
    assert c.build_index()["rows"] == 601 and "7" not in {h["id"] for h in c.search(data[7], 50, ef=700)}
    db.save()
    db.checkpoint()
    db.vacuum()
    c = Database.open_read_only(spark, place).collection("x")
    assert [h["id"] for h in c.search([50.0] * 8, 1, ef=10)] == ["8"] and len(built) == 1
    many = c.search_batch(spark.createDataFrame([(q, data[q]) for q in (3, 9, 300)], "node long, vector array<float>"), 4, ef=700)
    truth = c.search_batch(spark.createDataFrame([(q, data[q]) for q in (3, 9, 300)], "node long, vector array<float>"), 4, exact=True)
    assert sorted(many.select("query_id", "rank", "node").collect()) == sorted(truth.select("query_id", "rank", "node").collect())
    c = Database.open(spark, place).collection("x")
    c.compact()
    assert c.build_index()["rows"] == 599 and len(built) == 2


def test_leases_hold_files(spark, place):
    db = Database.create(spark, place)
    c = db.create_collection("x", 1, "l2")
    c.upsert_many([("a", [1]), ("b", [2])])
    db.save()
    held, brief = db.snapshot(lease=600), db.snapshot(lease=1e-6)
    c.delete("a")
    c.compact()
    db.save()
    db.vacuum()
    assert held.collection("x").records().count() == 2
    brief.release()
    held.release()
    db.vacuum()
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|NotFound"):
        held.collection("x").records().count()
    with pytest.raises(NotFound):
        Database.open(spark, place, sequence=1)


def test_damage_is_found(spark, place, tmp_path):
    db = Database.create(spark, place)
    c = db.create_collection("x", 1, "l2")
    c.upsert_many((str(i), [i]) for i in range(50))
    db.save()
    db.verify()
    catalog = files.read(spark, f"{place}/catalog/{1:020d}.json")
    files.write(spark, f"{place}/catalog/{1:020d}.json", catalog.replace(b'"live": 50', b'"live": 51'))
    with pytest.raises(CorruptData):
        Database.open(spark, place)
    files.write(spark, f"{place}/catalog/{1:020d}.json", catalog)
    part = next((tmp_path / "db" / c._entry["files"][0]).glob("*.parquet"))
    part.unlink()
    with pytest.raises(CorruptData):
        Database.open(spark, place).verify()


def test_the_first_format_is_upgraded(spark, place):
    """A database as the first format had it: deletes are rows, and the newest row of an id decides."""
    former = "id string, node long, deleted boolean, vector array<float>, codes array<tinyint>, scale float, metadata_json string"
    rows = [("a", 0, False, [1.0], None, None, '{"v":1}'), ("b", 1, False, [2.0], None, None, None), ("a", 2, False, [3.0], None, None, '{"v":2}'), ("b", 2, True, None, None, None, None), ("c", 3, False, [4.0], None, None, '{"v":2}')]
    spark.createDataFrame(rows, former).write.parquet(f"{place}/data/u/one")
    config = {"dim": 1, "metric": "l2", "m": 16, "ef_construction": 200, "ef_search": 64, "precision": "f32"}
    state = {"format": 1, "identity": "i", "sequence": 0, "delta_bytes": 0, "delta_commits": 0, "checkpoints": 0, "collections": {"x": {"uid": "u", "token": None, "config": config, "next": 4, "files": ["data/u/one"]}}}
    files.write(spark, f"{place}/catalog/{0:020d}.json", json.dumps(state).encode())
    with pytest.raises(CorruptData):
        Database.open(spark, place)
    db = Database.upgrade(spark, place)
    for view in (db, Database.open(spark, place), Database.upgrade(spark, place)):
        c = view.collection("x")
        assert (c.count(), c.stats()["deleted"]) == (2, 2) and [h["id"] for h in c.search([0.0], 5, filter={"v": 2})] == ["a", "c"]
    assert Database._catalog(spark, place, 0)["format"] == 1


def test_arrays_and_searches_beside_each_other(spark, place):
    c = Database.create(spark, place).create_collection("x", 3, "l2")
    x = np.arange(30, dtype=np.float32).reshape(10, 3)
    assert c.upsert_arrays([str(i) for i in range(10)], x, [{"i": i} if i % 2 else None for i in range(10)]) == 10
    assert c.upsert_arrays([], []) == 0 and c.get("3")["metadata"] == {"i": 3} and c.get("4")["metadata"] is None
    for ids, vectors, metadata in ((["a"], x, None), (["a"], [[1, 2]], None), (["a"], [["1", "2", "3"]], None), (["a", "b"], [[1, 2, 3], [1, 2]], None), (["a"], [[1, 2, 3]], []), ([1], [[1, 2, 3]], None), (["a"], [[1, 2, float("nan")]], None)):
        with pytest.raises(InvalidArgument):
            c.upsert_arrays(ids, vectors, metadata)
    assert c.count() == 10
    futures = [c.search_async(v.tolist(), 1, exact=True) for v in x]
    assert [f.result()[0]["id"] for f in futures] == [str(i) for i in range(10)]
    assert isinstance(c.search_async([0, 0], 1).exception(), InvalidArgument)
