"""Export archives: one JSON-lines file for each collection and a manifest, checked by SHA-256.

Lines are made by the executors and written in physical order by one writer, as
the digest is over the exact bytes; the manifest comes last.  An import checks
everything first, then writes each collection in one commit and reads it back.
"""

from __future__ import annotations

import hashlib
import json
import re
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AlreadyExists, Conflict, CorruptData, InvalidArgument
from ..functions import metadata as M
from ..functions import vectors as V
from . import files, jsonl
from .database import Database

FORMAT, VERSION, PROFILE = "vector-export", 1, "quiverlake/1"
MAX_COLLECTIONS, MAX_LINE = 10_000, 4 << 20
RELATIVE, ABSOLUTE = 2e-5, 2e-6


@F.pandas_udf(T.StringType())
def _lines(id: pd.Series, vector: pd.Series, metadata: pd.Series) -> pd.Series:
    def one(i, v, m):
        return json.dumps({"id": i, "metadata": None if m is None else M.parse(m), "vector": [float(x) for x in v]}, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)

    return pd.Series([one(*r) for r in zip(id, vector, metadata, strict=True)])


def export(db: Database, path: str, source: str = "embedded", format: str = FORMAT, profile: str = PROFILE) -> dict:
    """Writes the database's last saved state below ``path``, which must not exist, and returns the manifest.  A failed export leaves nothing."""
    spark, path = db.spark, path.rstrip("/")
    if files.exists(spark, path):
        raise AlreadyExists(f"{path} exists")
    view, listed = db.snapshot(), []
    try:
        for i, c in enumerate(view):
            digest, n, name = hashlib.sha256(), 0, f"{i:04d}.jsonl"
            fs, p = files.located(spark, f"{path}/{name}")
            stream = fs.create(p, True)
            try:
                ordered = c.records().orderBy("node").select(_lines("id", "vector", "metadata_json").alias("line"))
                for row in ordered.toLocalIterator(prefetchPartitions=True):
                    data = (row["line"] + "\n").encode()
                    digest.update(data)
                    stream.write(bytearray(data))
                    n += 1
            finally:
                stream.close()
            config = c.config
            listed.append({
                "name": c.name, "dim": config.dim, "metric": config.metric, "source_precision": config.precision,
                "vectors": "stored-f32" if config.precision == "f32" else "stored-dequantized",
                "normalization": "unit-at-insertion" if config.metric == "cosine" else "none",
                "records": n, "file": name, "sha256": digest.hexdigest(),
            })
        manifest = {"format": format, "version": VERSION, "profile": profile, "consistent_snapshot": True, "source": source, "created_at": datetime.now(timezone.utc).isoformat(), "collections": listed}
        files.write(spark, f"{path}/manifest.json", json.dumps(manifest, indent=2, ensure_ascii=False).encode())
        return manifest
    except BaseException:
        files.delete(spark, path)
        raise


def duplicates(rows: DataFrame) -> DataFrame:
    """(id, n) of ids that come more than once."""
    return rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def inspect(spark: SparkSession, path: str, formats: tuple[str, ...] = (FORMAT,), profiles: tuple[str, ...] = (PROFILE,)) -> dict:
    """The manifest, after every rule, digest, record and count has been checked."""
    path = path.rstrip("/")
    try:
        manifest = M.parse(files.read(spark, f"{path}/manifest.json").decode())
    except InvalidArgument as e:
        raise CorruptData(f"manifest: {e}") from None
    if not isinstance(manifest, dict) or manifest.get("format") not in formats or manifest.get("version") != VERSION or isinstance(manifest.get("version"), bool) or manifest.get("profile") not in profiles:
        raise CorruptData("the archive has another format, version or profile")
    listed = manifest.get("collections")
    if not isinstance(listed, list) or len(listed) > MAX_COLLECTIONS or len({c.get("name") for c in listed}) != len(listed):
        raise CorruptData("the manifest's collections are wrong")
    for i, c in enumerate(listed):
        if c.get("file") != f"{i:04d}.jsonl" or not re.fullmatch(r"[0-9a-f]{64}", str(c.get("sha256"))) or c.get("source_precision") not in ("f32", "int8"):
            raise CorruptData(f"collection {i} is declared wrongly")
        kind = V.metric(c["metric"], strict=True)
        if c.get("vectors") != ("stored-f32" if c["source_precision"] == "f32" else "stored-dequantized") or c.get("normalization") != ("unit-at-insertion" if kind == "cosine" else "none"):
            raise CorruptData(f"collection {i} contradicts itself")
        digest, last = hashlib.sha256(), b"\n"
        fs, p = files.located(spark, f"{path}/{c['file']}")
        if not fs.exists(p):
            raise CorruptData(f"{c['file']} is missing")
        left, stream = fs.getFileStatus(p).getLen(), fs.open(p)
        try:
            while left:
                part = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(1 << 22, left)))
                digest.update(part)
                left, last = left - len(part), part[-1:]
        finally:
            stream.close()
        if digest.hexdigest() != c["sha256"] or last != b"\n":
            raise CorruptData(f"{c['file']} differs from its digest or lacks its last newline")
        rows = jsonl.read_lines(spark, f"{path}/{c['file']}")
        why = F.coalesce("problem", V.problem(F.col("vector").cast("array<float>"), c["dim"], kind))
        state = rows.agg(F.count("*").alias("n"), F.first(why, ignorenulls=True).alias("why")).first()
        if state["why"] is not None or state["n"] != c["records"]:
            raise CorruptData(f"{c['file']}: {state['why'] or 'the number of records differs'}")
        if duplicates(rows).limit(1).count():
            raise CorruptData(f"{c['file']} repeats an id")
    return manifest


def differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Ids whose vector (within tolerance) or metadata differ, or that only one side has.  Both: (id, vector, metadata_json)."""
    a, b = (df.select("id", F.col("vector").alias(f"v{t}"), F.col("metadata_json").alias(f"m{t}"), F.lit(True).alias(f"h{t}")) for df, t in ((expected, "a"), (found, "b")))
    near = F.forall(F.zip_with("va", "vb", lambda x, y: F.abs(x.cast("double") - y.cast("double")) <= ABSOLUTE + RELATIVE * F.greatest(F.abs(x.cast("double")), F.abs(y.cast("double")))), lambda ok: F.coalesce(ok, F.lit(False)))
    same = F.col("ha").isNotNull() & F.col("hb").isNotNull() & F.coalesce(near, F.lit(False)) & F.col("ma").eqNullSafe(F.col("mb"))
    return a.join(b, "id", "full").where(~same).select("id")


def restore(db: Database, path: str, dry_run: bool = False, resume: bool = False, **accept) -> dict:
    """Imports an archive: checked first, then one commit for each collection, verified by reading it back.

    resume: collections that an earlier import has committed whole are kept; otherwise an existing one is a Conflict.
    """
    manifest = inspect(db.spark, path, **accept)
    for c in manifest["collections"]:
        if c["name"] in db.names() and not resume:
            raise Conflict(f"collection {c['name']!r} exists")
    if dry_run:
        return manifest
    for c in manifest["collections"]:
        rows = jsonl.load(db.spark, f"{path.rstrip('/')}/{c['file']}")
        token = f"import-{c['sha256']}"
        if c["name"] in db.names():
            own = db.collection(c["name"])
            if own._entry["token"] != token or own.count() != c["records"]:
                raise Conflict(f"collection {c['name']!r} differs from the archive")
            continue
        own = db.create_collection(c["name"], c["dim"], c["metric"], token=token, precision=c["source_precision"])
        own.upsert_frame(rows)
        db.save()
        if own.count() != c["records"] or (c["source_precision"] == "f32" and differences(rows, own.records()).limit(1).count()):
            raise CorruptData(f"collection {c['name']!r} reads back differently")
    return manifest
