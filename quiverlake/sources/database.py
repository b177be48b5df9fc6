"""Databases of collections: a folder of immutable data files and numbered catalog commits.

A commit is one catalog file, created under the next number only if that is
free.  Readers hold a number and so see one whole state; data files that no
catalog names (a writer that failed) are never seen.  A second writer that
started from the same number gets Conflict.

What a write replaces or deletes is settled when it is written: beside its data
files a collection has lists of dead nodes, and the catalog has the counts.  A
scan is thus the files less the dead nodes, with no shuffle while these can be
broadcast, and counts read no data at all.  Metadata is stored as the map that
filters run on, beside its text.
"""

from __future__ import annotations

import base64
import bisect
import copy
import hashlib
import itertools
import json
import time
import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import AlreadyExists, Conflict, CorruptData, InvalidArgument, NotFound
from ..functions import metadata as M
from ..functions import vectors as V
from ..operators import filters, ivf, search
from ..operators.mutations import renumbered
from ..plans import planner
from . import files

FORMAT = 2
RECORD = "id string, ordinal long, vector array<float>, metadata_json string"
STORED = "id string, node long, vector array<float>, codes array<tinyint>, scale float, metadata_json string, meta map<string,struct<eq:string,num:double>>"
#: Dead nodes, or ids of a write, that may be broadcast; beyond it Spark joins as it sees fit.
BROADCAST_ROWS = 1_000_000
#: Searches that a handle runs beside each other.
SEARCHES = 8
#: A collection that has grown by this factor since its index was built gets a new one.
REBUILD = 2
MAX_BATCH, MAX_ID_BYTES = 256, 65_536
#: Numbers of nodes that are counted together when a sample is drawn; a power of two.
NODE_SPAN = 65_536


@dataclass(frozen=True)
class Config:
    dim: int
    metric: str = "cosine"
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 64
    precision: str = "f32"

    def checked(self) -> Config:
        whole = lambda x, low, high: isinstance(x, int) and not isinstance(x, bool) and low <= x <= high
        if not whole(self.dim, 1, V.MAX_DIM) or not whole(self.m, 2, 256) or not whole(self.ef_construction, 1, 2**32 - 1) or not whole(self.ef_search, 1, 2**32 - 1):
            raise InvalidArgument("dim, m or ef is out of range")
        if self.precision not in ("f32", "int8"):
            raise InvalidArgument("precision is f32 or int8")
        return Config(self.dim, V.metric(self.metric), self.m, self.ef_construction, self.ef_search, self.precision)


@dataclass(frozen=True)
class CheckpointPolicy:
    """Delta files are merged into one base after this many bytes or commits, whichever comes first."""

    bytes: int = 64 << 20
    commits: int = 1_000


@dataclass(frozen=True)
class Report:
    hits: list[Row]
    strategy: str
    ef: int | None
    visited: int
    distance_computations: int
    filter_selectivity: float | None
    elapsed: float


@dataclass(frozen=True)
class Page:
    records: list[Row]
    next_offset: int | None


class Database:
    def __init__(self, spark: SparkSession, path: str, state: dict, read_only: bool, policy: CheckpointPolicy):
        self.spark, self.path, self.read_only, self.policy = spark, path.rstrip("/"), read_only, policy
        self._state, self._saved = copy.deepcopy(state), copy.deepcopy(state)
        self._indexes: dict[str, tuple[dict, ivf.Lists]] = {}
        self._lease: str | None = None
        self._pool: ThreadPoolExecutor | None = None

    # opening

    @staticmethod
    def _commits(spark, path) -> list[int]:
        return sorted(int(n[:-5]) for n in files.names(spark, f"{path}/catalog") if n.endswith(".json") and n[:-5].isdigit())

    @classmethod
    def create(cls, spark: SparkSession, path: str, policy: CheckpointPolicy | None = None) -> Database:
        path = path.rstrip("/")
        if cls._commits(spark, path):
            raise AlreadyExists(f"{path} holds a database")
        state: dict = {"format": FORMAT, "identity": uuid.uuid4().hex, "sequence": 0, "delta_bytes": 0, "delta_commits": 0, "checkpoints": 0, "collections": {}}
        if not files.publish(spark, f"{path}/catalog/{0:020d}.json", _sealed(state)):
            raise AlreadyExists(f"{path} holds a database")
        return cls(spark, path, state, False, policy or CheckpointPolicy())

    @classmethod
    def open(cls, spark: SparkSession, path: str, read_only: bool = False, sequence: int | None = None, policy: CheckpointPolicy | None = None) -> Database:
        path = path.rstrip("/")
        commits = cls._commits(spark, path)
        if not commits or (sequence is not None and sequence not in commits):
            raise NotFound(f"no such database or commit: {path}")
        at = commits[-1] if sequence is None else sequence
        state = cls._catalog(spark, path, at)
        if state.get("format") != FORMAT:
            raise CorruptData(f"catalog {at} has format {state.get('format')}; upgrade() brings older ones to {FORMAT}")
        return cls(spark, path, state, read_only or sequence is not None, policy or CheckpointPolicy())

    @staticmethod
    def _catalog(spark, path, at: int) -> dict:
        try:
            sealed = json.loads(files.read(spark, f"{path}/catalog/{at:020d}.json"))
            state = sealed["state"] if "sha256" in sealed else sealed  # format 1 has no seal
            if sealed.get("sha256") not in (None, _digest(state)) or state["sequence"] != at:
                raise ValueError
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise CorruptData(f"catalog {at} is damaged") from e
        return state

    @classmethod
    def upgrade(cls, spark: SparkSession, path: str) -> Database:
        """Opens a database, rewriting one of format 1 first; its last commit stays as it was until vacuum()."""
        path = path.rstrip("/")
        commits = cls._commits(spark, path)
        if not commits:
            raise NotFound(f"no such database: {path}")
        old = cls._catalog(spark, path, commits[-1])
        if old.get("format") == FORMAT:
            return cls.open(spark, path)
        if old.get("format") != 1:
            raise CorruptData(f"format {old.get('format')} is unknown")
        db = cls(spark, path, old | {"format": FORMAT}, False, CheckpointPolicy())
        db._saved = old
        former = "id string, node long, deleted boolean, vector array<float>, codes array<tinyint>, scale float, metadata_json string"
        for name, c in db._state["collections"].items():
            was, c["files"] = c["files"], []
            c |= {"live": 0, "rows": 0, "dead": [], "dead_rows": 0, "index": None}
            if was:
                rows = spark.read.schema(former).parquet(*[f"{path}/{f}" for f in was])
                last = rows.groupBy("id").agg(F.max(F.struct("node", "deleted")).alias("last")).select(F.col("last.node").alias("node"), F.col("last.deleted").alias("gone"))
                collection = Collection(db, name)
                collection._keep(rows.where(~F.col("deleted")).drop("deleted"))
                collection._bury(collection.nodes().select("node").join(last.where("not gone").select("node"), "node", "left_anti"))
        db.save()
        return db

    @classmethod
    def open_read_only(cls, spark, path) -> Database:
        return cls.open(spark, path, read_only=True)

    @classmethod
    def open_or_create(cls, spark, path) -> Database:
        return cls.open(spark, path) if cls._commits(spark, path.rstrip("/")) else cls.create(spark, path)

    def snapshot(self, lease: float | None = None) -> Database:
        """A read-only view of the last saved state; later commits don't show.

        With a lease, vacuum() leaves its files alone for so many seconds, or until release().
        """
        view = Database.open(self.spark, self.path, sequence=self._saved["sequence"])
        if lease is not None:
            if not lease > 0:
                raise InvalidArgument("a lease lasts some seconds")
            view._lease = f"{self.path}/leases/{uuid.uuid4().hex}.json"
            files.write(self.spark, view._lease, json.dumps({"sequence": view.sequence, "until": time.time() + lease}).encode())
        return view

    def release(self) -> None:
        """Gives up the snapshot's lease."""
        if self._lease is not None:
            files.delete(self.spark, self._lease)
            self._lease = None

    def _leased(self) -> set[int]:
        """Commits under a lease; leases that have run out are removed."""
        held = set()
        for name in files.names(self.spark, f"{self.path}/leases"):
            try:
                lease = json.loads(files.read(self.spark, f"{self.path}/leases/{name}"))
            except ValueError:  # being written: it counts for all
                return set(self._commits(self.spark, self.path))
            if lease["until"] > time.time():
                held.add(lease["sequence"])
            else:
                files.delete(self.spark, f"{self.path}/leases/{name}")
        return held

    def __enter__(self) -> Database:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and not self.read_only:
            self.save()

    # accessors

    @property
    def sequence(self) -> int:
        return self._saved["sequence"]

    @property
    def identity(self) -> str:
        return self._state["identity"]

    def stats(self) -> dict:
        return {k: self._saved[k] for k in ("format", "identity", "sequence", "delta_bytes", "delta_commits", "checkpoints")} | {"collections": len(self._saved["collections"])}

    @property
    def pool(self) -> ThreadPoolExecutor:
        """Threads that searches run in beside each other; Spark's scheduler shares the executors among them."""
        if self._pool is None:
            self._pool = ThreadPoolExecutor(SEARCHES, thread_name_prefix="search")
        return self._pool

    # collections

    def _writable(self) -> None:
        if self.read_only:
            raise InvalidArgument("the database is open for reading only")

    def create_collection(self, name: str, dim: int, metric: str = "cosine", token: str | None = None, **options) -> Collection:
        """With a token, creating the same collection again returns it; another definition under that token is a Conflict."""
        self._writable()
        if not isinstance(name, str) or not 1 <= len(name.encode()) <= 255:
            raise InvalidArgument("a collection's name has 1 to 255 bytes")
        config = asdict(Config(dim, metric, **options).checked())
        old = self._state["collections"].get(name)
        if old is not None:
            if token is not None and old["token"] == token:
                if old["config"] != config:
                    raise Conflict("the token was used with another definition")
                return Collection(self, name)
            raise AlreadyExists(f"collection {name!r} exists")
        self._state["collections"][name] = {"uid": uuid.uuid4().hex, "token": token, "config": config, "next": 0, "files": [], "rows": 0, "live": 0, "dead": [], "dead_rows": 0, "index": None}
        return Collection(self, name)

    def collection(self, name: str) -> Collection:
        if name not in self._state["collections"]:
            raise NotFound(f"no collection {name!r}")
        return Collection(self, name)

    def names(self) -> list[str]:
        return sorted(self._state["collections"])

    def __iter__(self):
        return (self.collection(n) for n in self.names())

    def drop_collection(self, name: str) -> None:
        self._writable()
        if self._state["collections"].pop(name, None) is None:
            raise NotFound(f"no collection {name!r}")

    # commits

    def save(self) -> int:
        """Commits what has changed and returns the sequence; nothing changed: no commit."""
        self._writable()
        if self._state == self._saved:
            return self.sequence
        new = copy.deepcopy(self._state)
        new["sequence"] += 1
        new["delta_commits"] += 1
        if not files.publish(self.spark, f"{self.path}/catalog/{new['sequence']:020d}.json", _sealed(new)):
            raise Conflict("the database was changed through another handle")
        self._state, self._saved = new, copy.deepcopy(new)
        if new["delta_commits"] >= self.policy.commits or new["delta_bytes"] >= self.policy.bytes:
            try:
                self.checkpoint()
            except Exception:  # maintenance never fails a commit that is durable already
                self._state = copy.deepcopy(self._saved)
        return self.sequence

    def reload(self) -> None:
        """Drops unsaved changes and takes up the newest commit."""
        self._state = Database.open(self.spark, self.path)._state
        self._saved = copy.deepcopy(self._state)

    def checkpoint(self) -> int:
        """Merges each collection's files into one, and its lists of dead nodes; these stay until compact()."""
        self._writable()
        for name, c in self._state["collections"].items():
            own = Collection(self, name)
            if len(c["files"]) > 1:
                merged = self._write("data", c["uid"], own.stored())
                if c["index"] is not None and set(c["index"]["files"]) >= set(c["files"]):
                    c["index"]["files"] = [merged]  # the same nodes
                c["files"] = [merged]
            if len(c["dead"]) > 1:
                c["dead"] = [self._write("dead", c["uid"], own.dead().distinct())]
        self._state |= {"delta_bytes": 0, "delta_commits": -1, "checkpoints": self._state["checkpoints"] + 1}
        return self.save()

    def vacuum(self, keep: int = 1) -> None:
        """Deletes files that none of the newest ``keep`` commits names, nor one under a lease, and the older commits."""
        self._writable()
        commits = self._commits(self.spark, self.path)
        leased = self._leased()
        kept = [c for c in commits if c in leased or c in commits[-max(1, keep) :]]
        used = set()
        for state in [self._state, *(self._catalog(self.spark, self.path, at) for at in kept)]:
            for c in state["collections"].values():
                used |= {*c["files"], *c.get("dead", [])} | ({c["index"]["path"]} if c.get("index") else set())
        for at in commits:
            if at not in kept:
                files.delete(self.spark, f"{self.path}/catalog/{at:020d}.json")
        for kind in ("data", "dead", "index"):
            for uid in files.names(self.spark, f"{self.path}/{kind}"):
                for f in files.names(self.spark, f"{self.path}/{kind}/{uid}"):
                    if f"{kind}/{uid}/{f}" not in used:
                        files.delete(self.spark, f"{self.path}/{kind}/{uid}/{f}")

    def verify(self) -> None:
        """Reads every file of the last commit, page checksums included; CorruptData if rows are missing or damaged."""
        for name, c in self._saved["collections"].items():
            own = Collection(Database.open(self.spark, self.path, sequence=self._saved["sequence"]), name)
            try:
                rows, total = own.nodes().agg(F.count("*"), F.sum(F.xxhash64("id", "node", "vector", "codes", "scale", "metadata_json").cast("decimal(38,0)"))).first()
            except Exception as e:
                raise CorruptData(f"collection {name!r} can't be read: {e}") from e
            if rows != c["rows"] or (total is None) != (rows == 0):
                raise CorruptData(f"collection {name!r} has {rows} rows, not {c['rows']}")

    def _write(self, kind: str, uid: str, df: DataFrame) -> str:
        at = f"{kind}/{uid}/{uuid.uuid4().hex}"
        # a point lookup skips the row groups whose filter doesn't know the id
        bloom = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.adaptive.enabled": "true"} if kind == "data" else {}
        df.write.options(**bloom).parquet(f"{self.path}/{at}")
        fs, p = files.located(self.spark, f"{self.path}/{at}")
        self._state["delta_bytes"] += fs.getContentSummary(p).getLength()
        return at


def _digest(state: dict) -> str:
    return hashlib.sha256(json.dumps(state, sort_keys=True).encode()).hexdigest()


def _sealed(state: dict) -> bytes:
    return json.dumps({"sha256": _digest(state), "state": state}).encode()


class Collection:
    """A handle; it stops working when its collection is dropped, even if another of that name is created."""

    def __init__(self, db: Database, name: str):
        self.db, self.name, self.spark = db, name, db.spark
        self._uid = db._state["collections"][name]["uid"]

    @property
    def _entry(self) -> dict:
        entry = self.db._state["collections"].get(self.name)
        if entry is None or entry["uid"] != self._uid:
            raise NotFound(f"collection {self.name!r} was dropped")
        return entry

    @property
    def config(self) -> Config:
        return Config(**self._entry["config"])

    # scans

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.db.path}/{f}" for f in paths])

    def stored(self, paths: list[str] | None = None) -> DataFrame:
        """Every stored row, of all files or of some: replaced and deleted nodes too."""
        return self._read(self._entry["files"] if paths is None else paths, STORED)

    def dead(self) -> DataFrame:
        """(node) of what has been replaced or deleted; broadcast while its number allows it."""
        gone = self._read(self._entry["dead"], "node long")
        return F.broadcast(gone) if self._entry["dead_rows"] <= BROADCAST_ROWS else gone

    def nodes(self) -> DataFrame:
        """Every stored row, and whether it is ``deleted``."""
        rows = self.stored()
        if not self._entry["dead"]:
            return rows.withColumn("deleted", F.lit(False))
        marked = rows.join(self.dead().withColumn("gone", F.lit(True)), "node", "left")
        return marked.withColumn("deleted", F.col("gone").isNotNull()).drop("gone")

    def _vector(self) -> Column:
        return F.coalesce("vector", V.int8_decoded(F.col("codes"), F.col("scale")))

    def _alive(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.dead(), "node", "left_anti") if self._entry["dead"] else rows

    def records(self, paths: list[str] | None = None) -> DataFrame:
        """Live records (id, node, vector, metadata_json, meta), int8 ones decoded."""
        int8 = self.config.precision == "int8"
        return self._alive(self.stored(paths)).select("id", "node", self._vector().alias("vector") if int8 else "vector", "metadata_json", "meta")

    def count(self) -> int:
        return self._entry["live"]

    __len__ = count

    def is_empty(self) -> bool:
        return self.count() == 0

    def _last(self, id: str) -> Row | None:
        return self.records().where(F.col("id") == id).first()  # one node of an id lives at most

    def get(self, id: str) -> Row | None:
        row = self._last(id)
        return None if row is None else Row(id=row["id"], vector=row["vector"], metadata=None if row["metadata_json"] is None else M.parse(row["metadata_json"]))

    def contains(self, id: str) -> bool:
        return self._last(id) is not None

    def records_page(self, offset: int = 0, limit: int = 100) -> Page:
        """Live records from node ``offset`` on, in physical order."""
        if not 1 <= limit <= 10_000 or not 0 <= offset <= self._entry["next"]:
            raise InvalidArgument("the page's limit or offset is out of range")
        rows = self.records().where(F.col("node") >= offset).orderBy("node").limit(limit + 1).collect()
        return Page(rows[:limit], rows[limit]["node"] if len(rows) > limit else None)

    def page(self, cursor: str | None = None, limit: int = 100) -> tuple[list[Row], str | None]:
        """Pages of one state: a cursor of another state or collection is refused."""
        if not 1 <= limit <= MAX_BATCH:
            raise InvalidArgument(f"a page holds 1 to {MAX_BATCH} records")
        context = [self.db.identity, self._uid, self.db.sequence, len(self._entry["files"])]
        offset = 0
        if cursor is not None:
            try:
                *old, offset = json.loads(base64.urlsafe_b64decode(cursor.encode()))
            except ValueError:
                raise InvalidArgument("the cursor is malformed") from None
            if old != context:
                raise Conflict("the cursor is of another state")
        page = self.records_page(offset, limit)
        more = None if page.next_offset is None else base64.urlsafe_b64encode(json.dumps([*context, page.next_offset]).encode()).decode()
        return page.records, more

    def iter_records(self):
        return self.records().orderBy("node").toLocalIterator()

    # mutations

    def _keep(self, rows: DataFrame) -> str:
        """Writes rows (id, node, vector, codes, scale, metadata_json) as a data file of the collection."""
        names = [f.split()[0] for f in STORED.split(", ")]
        try:
            path = self.db._write("data", self._uid, rows.withColumn("meta", M.projection(F.col("metadata_json"))).select(*names))
        except PythonException as e:
            if "InvalidArgument" in str(e):
                raise InvalidArgument("metadata is no valid JSON: " + str(e).split("InvalidArgument:")[-1].split("\n")[0].strip()) from e
            raise
        n = self.stored([path]).count()
        self._entry["files"].append(path)
        self._entry["rows"] += n
        self._entry["live"] += n
        return path

    def _bury(self, nodes: DataFrame) -> int:
        """Marks live nodes as dead and returns how many."""
        path = self.db._write("dead", self._uid, nodes)
        n = self._read([path], "node long").count()
        if n:
            self._entry["dead"].append(path)
            self._entry["dead_rows"] += n
            self._entry["live"] -= n
        return n

    def _stage(self, batch: DataFrame, rows: int) -> None:
        """batch: (id, ordinal from 0, vector, metadata_json), validated.  All of it is staged, or nothing."""
        c, entry = self.config, self._entry
        before = copy.deepcopy(entry)
        v = V.normalized(F.col("vector")) if c.metric == "cosine" else F.col("vector")
        df = batch.select("id", (F.col("ordinal") + entry["next"]).alias("node"), v.alias("vector"), "metadata_json")
        if c.precision == "int8":
            df = df.withColumn("_scale", V.int8_scale(F.col("vector"))).withColumn("codes", V.int8_codes(F.col("vector"), F.col("_scale")))
            df = df.withColumn("scale", V.int8_stored_scale(F.col("codes"), F.col("_scale"), c.metric)).withColumn("vector", F.lit(None).cast("array<float>"))
        else:
            df = df.withColumn("codes", F.lit(None).cast("array<tinyint>")).withColumn("scale", F.lit(None).cast("float"))
        try:
            old = self._alive(self.stored()).select("id", "node") if entry["files"] else None
            new = self.stored([self._keep(df)]).select("id", "node")
            # the last of a batch's equal ids counts, and it replaces what lived under the id
            last = new.groupBy("id").agg(F.max("node").alias("last"), F.count("*").alias("times"))
            again = last.where("times > 1")
            replaced = new.join(again, "id").where("node < last").select("node")
            if old is not None:
                ids = last.select("id")
                replaced = replaced.unionByName(old.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, "id", "left_semi").select("node"))
            self._bury(replaced)
            entry["next"] += rows
        except BaseException:
            entry.update(before)
            raise

    def upsert_frame(self, df: DataFrame) -> int:
        """Bulk upsert of (id, vector, metadata_json or none): all rows or none; of equal ids the last in order counts.  Returns the rows written."""
        self.db._writable()
        c, entry = self.config, self._entry
        text = F.col("metadata_json").cast("string") if "metadata_json" in df.columns else F.lit(None).cast("string")
        staged = f"{self.db.path}/data/{entry['uid']}/staged-{uuid.uuid4().hex}"
        df.select(F.col("id").cast("string"), F.monotonically_increasing_id().alias("place"), F.col("vector").cast("array<float>"), text.alias("metadata_json")).write.parquet(staged)
        try:
            raw = self.spark.read.parquet(staged)
            bad = raw.select(V.problem(F.col("vector"), c.dim, c.metric).alias("why"), "id").where(F.col("why").isNotNull() | F.col("id").isNull()).first()
            if bad is not None:
                raise InvalidArgument(f"record {bad['id']!r}: {bad['why'] or 'no id'}")
            part = F.shiftrightunsigned("place", 33)
            counts = sorted((r["p"], r["count"]) for r in raw.groupBy(part.alias("p")).count().collect())  # one row for each input partition
            starts = dict(zip([p for p, _ in counts], np.concatenate([[0], np.cumsum([n for _, n in counts])])[:-1].tolist(), strict=True)) if counts else {}
            rows = sum(n for _, n in counts)
            if not rows:
                return 0
            offsets = F.broadcast(self.spark.createDataFrame([(p, int(s)) for p, s in starts.items()], "p long, start long"))
            numbered = raw.withColumn("p", part).join(offsets, "p").withColumn("ordinal", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
            self._stage(numbered.select("id", "ordinal", "vector", "metadata_json"), rows)
            return rows
        finally:
            files.delete(self.spark, staged)

    def upsert_arrays(self, ids, vectors, metadata=None) -> int:
        """Bulk upsert of ids, a two-dimensional array (numpy or anything with its interface) or rows of numbers, and metadata values or none; as many of each."""
        c, ids = self.config, [checked_id(i) for i in ids]
        try:
            x = np.asarray(vectors)
        except ValueError as e:
            raise InvalidArgument("vectors are rows of equal length") from e
        if len(ids) and (x.ndim != 2 or x.shape[1] != c.dim or x.dtype.kind not in "fiu"):
            raise InvalidArgument(f"vectors are rows of {c.dim} numbers")
        texts = [None] * len(ids) if metadata is None else [None if m is None else M.canonical(m) for m in metadata]
        if not len(ids) == len(x) == len(texts):
            raise InvalidArgument("ids, vectors and metadata differ in number")
        if not ids:
            return 0
        with np.errstate(over="ignore"):
            flat = pa.array(np.ascontiguousarray(x, np.float32).reshape(-1))
        rows = pa.table({"id": pa.array(ids, pa.string()), "vector": pa.FixedSizeListArray.from_arrays(flat, c.dim).cast(pa.list_(pa.float32())), "metadata_json": pa.array(texts, pa.string())})
        return self.upsert_frame(self.spark.createDataFrame(rows))

    def upsert_many(self, records) -> int:
        """(id, vector, metadata) triples: validated before anything is written; the last of equal ids counts, all count as written."""
        self.db._writable()
        c, rows = self.config, []
        for i, (id, vector, *rest) in enumerate(records):
            rows.append((checked_id(id), i, checked_vector(vector, c.dim, c.metric), None if not rest or rest[0] is None else M.canonical(rest[0])))
        if rows:
            self._stage(self.spark.createDataFrame(rows, RECORD), len(rows))
        return len(rows)

    def upsert(self, id: str, vector, metadata=None) -> None:
        self.upsert_many([(id, vector, metadata)])

    def upsert_portable(self, records) -> int:
        """As upsert_many, for at most MAX_BATCH records of different ids."""
        records = list(records)
        if len(records) > MAX_BATCH:
            raise InvalidArgument(f"a batch holds at most {MAX_BATCH} records")
        if len({r[0] for r in records}) != len(records):
            raise InvalidArgument("a batch repeats an id")
        return self.upsert_many(records)

    def delete(self, id: str) -> bool:
        return bool(self.delete_frame(self.spark.createDataFrame([(id,)], "id string")))

    def delete_frame(self, ids: DataFrame) -> int:
        """Deletes all records whose id is in ``ids`` (id), in one pass, and returns how many there were."""
        self.db._writable()
        if not self._entry["files"]:
            return 0
        return self._bury(self.records().select("id", "node").join(ids.select(F.col("id").cast("string")).distinct(), "id", "left_semi").select("node"))

    def compact(self) -> int:
        """Rewrites the live nodes, numbered anew in order, and returns how many went."""
        self.db._writable()
        entry = self._entry
        gone = entry["rows"] - entry["live"]
        if gone == 0:
            return 0
        alive = renumbered(self._alive(self.stored())).select(*[f.split()[0] for f in STORED.split(", ")])
        entry["files"] = [self.db._write("data", self._uid, alive)]
        entry |= {"next": entry["live"], "rows": entry["live"], "dead": [], "dead_rows": 0, "index": None}
        return gone

    # search

    def _prepared(self, query) -> list[float]:
        c = self.config
        q = checked_vector(query, c.dim, c.metric)
        if c.metric == "cosine":
            x = np.asarray(q, np.float32).astype(np.float64)
            q = (x / np.sqrt((x * x).sum())).astype(np.float32).tolist()
        return q

    def _index(self) -> ivf.Lists:
        """The index over all files: that of the catalog, with new files dealt to its lists, or a new one.

        What is built here belongs to the catalog from the next save() on; a
        read-only handle keeps it to itself, outside the database.
        """
        entry, saved = self._entry, self._entry["index"]
        kept = self.db._indexes.get(self._uid)
        if kept is not None and (saved is None or not set(saved["files"]) >= set(entry["files"])):
            saved = kept[0]  # of this handle only
        fits = saved is not None and set(saved["files"]) <= set(entry["files"]) and entry["live"] <= REBUILD * max(1, saved["rows"])
        if fits and kept is not None and kept[0] == saved and set(saved["files"]) == set(entry["files"]):
            return kept[1]
        if fits and set(saved["files"]) == set(entry["files"]):
            lists = ivf.load(self.spark, self._at(saved["path"]), saved["parts"])
        elif fits and (not self.db.read_only or kept is not None and kept[0] == saved):
            lists = kept[1] if kept is not None and kept[0] == saved else ivf.load(self.spark, self._at(saved["path"]), saved["parts"])
            new = [f for f in entry["files"] if f not in saved["files"]]
            lists = ivf.extend(lists, self.records(new), max(saved["parts"]) + 1)
            saved = saved | {"files": list(entry["files"]), "parts": lists.parts}
        else:
            path = files.shared(self.spark, "index") if self.db.read_only else f"index/{self._uid}/{uuid.uuid4().hex}"
            lists = ivf.build(self.records(), self._at(path), self.config.metric, entry["live"], self.config.dim)
            ivf.save(self.spark, lists)
            saved = {"path": path, "files": list(entry["files"]), "parts": lists.parts, "rows": entry["live"]}
        if not self.db.read_only:
            entry["index"] = saved
        self.db._indexes[self._uid] = saved, lists
        return lists

    def _at(self, path: str) -> str:
        return path if ":" in path or path.startswith("/") else f"{self.db.path}/{path}"

    def build_index(self) -> dict:
        """Brings the index up to date; save() makes it part of the database."""
        lists = self._index()
        return {"lists": len(lists.sizes), "largest": int(lists.sizes.max()), "empty": int((lists.sizes == 0).sum()), "rows": int(lists.sizes.sum())}

    def plan(self, k: int = 10, ef: int | None = None, exact: bool = False, filter=None) -> planner.Plan:
        c, entry = self.config, self._entry
        share = None if filter is None else planner.selectivity(self.nodes(), filters.compiled(filter), entry["rows"])
        return planner.choose(entry["rows"], entry["live"], c.dim, k, share, ef, c.ef_search, c.m, exact)

    def _searched(self, q: list[float], k: int, plan: planner.Plan, where, seen: Observation | None = None) -> tuple[DataFrame, str]:
        """The hits, and the strategy that they come from in the end; ``seen`` counts the rows that an exact scan compares."""
        if plan.strategy == "index":
            index = self._index()
            hits = ivf.search(index, self.spark, q, k, plan.ef, where, self._alive)
            if where is None or ivf.within_reach(index, self.spark, q, k, plan.ef, hits):
                return hits, plan.strategy
        base = self.records() if where is None else self.records().where(where)
        if seen is not None:
            base = base.observe(seen, F.count(F.lit(1)).alias("rows"))
        return search.top_k(base, q, k, self.config.metric), "filtered_exact" if plan.strategy == "index" else plan.strategy

    def search_frame(self, query, k: int = 10, ef: int | None = None, exact: bool = False, filter=None, plan: planner.Plan | None = None) -> DataFrame:
        """(id, node, distance, metadata_json), nearest first.

        Where the index's lists hold fewer than k matching records, or the k-th
        lies farther out than the lists reach, the search is made again, exactly.
        """
        q = self._prepared(query)
        where = None if filter is None else filters.compiled(filter)
        plan = plan or self.plan(k, ef, exact, None if exact else filter)  # an exact search needs no estimate
        return self._searched(q, k, plan, where)[0].select("id", "node", "distance", "metadata_json")

    def explain(self, query, k: int = 10, ef: int | None = None, exact: bool = False, filter=None) -> Report:
        begin = time.perf_counter()
        q = self._prepared(query)
        plan = self.plan(k, ef, exact, filter)
        seen = Observation(f"compared-{uuid.uuid4().hex}")
        found, strategy = self._searched(q, k, plan, None if filter is None else filters.compiled(filter), seen)
        hits = _finite(found.select("id", "node", "distance", "metadata_json").collect())
        visited = seen.get["rows"] if strategy != "index" else 0
        if plan.strategy == "index":
            index = self._index()
            visited += int(index.sizes[ivf.probed(index, np.asarray(q), plan.ef)].sum())
        return Report(hits, strategy, plan.ef, visited, visited, plan.selectivity, time.perf_counter() - begin)

    def search(self, query, k: int = 10, **options) -> list[Row]:
        return _finite(self.search_frame(query, k, **options).collect())

    def search_async(self, query, k: int = 10, **options) -> Future:
        """search() in a thread of the database's own; the future holds the hits or the error."""
        return self.db.pool.submit(self.search, query, k, **options)

    def search_batch(self, queries: DataFrame, k: int = 10, ef: int | None = None, exact: bool = False) -> DataFrame:
        """(query_id, rank, node, distance) for many queries (node, vector), by the index or exactly.

        Vectors are taken as they are stored: of unit length for cosine.
        """
        if exact:
            return search.knn(self.records(), queries, k, self.config.metric)
        search.check_k(k)
        return ivf.search_many(self._index(), queries, k, max(ef or self.config.ef_search, k), self._alive)

    def search_portable(self, query, k: int = 10, **options) -> list[Row]:
        search.check_k(k, 10_000)
        return sorted(self.search(query, k, **options), key=lambda h: (h["distance"], h["id"]))

    def like(self, id: str, k: int = 10, **options) -> list[Row]:
        """Neighbours of a stored record, itself among them."""
        row = self._last(id)
        if row is None:
            raise NotFound(f"no record {id!r}")
        return self.search(row["vector"], k, **options)

    # introspection

    def stats(self) -> dict:
        c, entry = self.config, self._entry
        text = self.stored().agg(F.coalesce(F.sum(F.octet_length("metadata_json")), F.lit(0)).alias("b")).first()
        each = c.dim + 4 if c.precision == "int8" else 4 * c.dim
        index = self.db._indexes.get(self._uid)
        return {
            "live": entry["live"], "deleted": entry["rows"] - entry["live"], "vector_bytes": entry["rows"] * each, "metadata_bytes": text["b"],
            "index_lists": len(index[1].sizes) if index else 0, "index_bytes": int(index[1].centers.nbytes) if index else 0,
        }

    def estimate_recall(self, k: int = 10, sample: int = 100, ef_values=(16, 64, 128), seed: int = planner.SEED) -> DataFrame:
        """(ef, recall, visited_p50, visited_p95, queries, seconds): how many of the exact neighbours of sampled records the index finds.

        Each record's own is left out.  All the sampled records are searched in one pass for each ef.
        """
        ef_values = list(ef_values)
        if k < 1 or sample < 1 or not ef_values or min(ef_values) < 1:
            raise InvalidArgument("k, sample and ef values must be greater than zero")
        base = self.records()
        # the sample is drawn by ordinal among the live records; only counts of node ranges come to the driver
        span = F.col("node").cast("long").bitwiseAND(F.lit(-NODE_SPAN)).alias("span")
        counts = base.groupBy(span).count().orderBy("span").collect()
        live = sum(r["count"] for r in counts)
        if live < 2:
            raise InvalidArgument("recall needs at least two records")
        rng, take, moved, drawn = planner.SplitMix64(seed), min(sample, live), {}, []
        for i in range(take):
            j = i + rng.below(live - i)
            drawn.append(moved.get(j, j))
            moved[j] = moved.get(i, i)
        ends = list(itertools.accumulate(r["count"] for r in counts))
        wanted = []
        for ordinal in drawn:
            at = bisect.bisect_right(ends, ordinal)
            wanted.append((counts[at]["span"], ordinal - (ends[at] - counts[at]["count"]) + 1))
        asked = self.spark.createDataFrame(wanted, "span long, place int")
        spans = base.withColumn("span", span).join(F.broadcast(asked.select("span").distinct()), "span")
        spans = spans.withColumn("place", F.row_number().over(Window.partitionBy("span").orderBy("node")))
        queries = spans.join(F.broadcast(asked), ["span", "place"]).drop("span", "place")
        k = min(k, live - 1)
        sampled = self.spark.createDataFrame(queries.select("node", "vector").collect(), "node long, vector array<float>")  # ``sample`` rows at most
        true = {(r["query_id"], r["node"]) for r in search.knn(base, sampled, k, self.config.metric, skip_self=True).select("query_id", "node").collect()}
        rows, index, out = sampled.collect(), self._index(), []
        for ef in ef_values:
            begin = time.perf_counter()
            hits = ivf.search_many(index, sampled, k, max(ef, k), self._alive, skip_self=True).select("query_id", "node").collect()
            took = time.perf_counter() - begin
            visited = sorted(int(index.sizes[ivf.probed(index, np.asarray(r["vector"], np.float64), max(ef, k))].sum()) for r in rows)
            ranked = lambda p: visited[int((len(visited) - 1) * p + 0.5)]  # noqa: E731  nearest rank
            found = sum((h["query_id"], h["node"]) in true for h in hits)
            out.append((ef, found / (k * len(rows)), ranked(0.5), ranked(0.95), len(rows), took))
        return self.spark.createDataFrame(out, "ef int, recall double, visited_p50 long, visited_p95 long, queries int, seconds double")


def _finite(hits: list[Row]) -> list[Row]:
    if any(not np.isfinite(h["distance"]) for h in hits):
        raise InvalidArgument("stored vectors exceed the distance limit")
    return hits


def checked_id(id) -> str:
    if not isinstance(id, str) or len(id.encode("utf-8", "surrogatepass")) > MAX_ID_BYTES:
        raise InvalidArgument("an id is a string of at most 65,536 bytes")
    return id


def checked_vector(vector, dim: int, metric: str) -> list[float]:
    """Finite numbers (no bools, strings or bytes) of the right dimension and size; not zero for cosine."""
    if isinstance(vector, (str, bytes, bytearray)):
        raise InvalidArgument("a vector is a sequence of numbers")
    values = list(vector)
    if len(values) != dim or any(isinstance(x, (bool, np.bool_, str, bytes)) or not isinstance(x, (int, float, np.number)) for x in values):
        raise InvalidArgument(f"a vector has {dim} numbers")
    with np.errstate(over="ignore"):
        x = np.asarray(values, np.float64).astype(np.float32).astype(np.float64)
    norm = float((x * x).sum())
    if not np.isfinite(x).all() or norm > V.MAX_SQUARED:
        raise InvalidArgument("a vector is not finite or too large")
    if metric == "cosine" and norm < V.MIN_SQUARED:
        raise InvalidArgument("a vector has no direction")
    return x.tolist()
