"""Command line: ``python -m quiverlake.cli DATABASE COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .errors import EngineError
from .sources import archive, jsonl
from .sources.database import Database


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quiverlake")
    top.add_argument("database")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    p = sub.add_parser("create-collection")
    p.add_argument("name")
    p.add_argument("--dim", type=int, required=True)
    p.add_argument("--metric", default="cosine")
    p.add_argument("--precision", default="f32")
    p = sub.add_parser("insert")
    p.add_argument("name")
    p.add_argument("file")
    p = sub.add_parser("delete")
    p.add_argument("name")
    p.add_argument("ids", nargs="+")
    p = sub.add_parser("query")
    p.add_argument("name")
    p.add_argument("--vector")
    p.add_argument("--like")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--ef", type=int)
    p.add_argument("--filter")
    p.add_argument("--exact", action="store_true")
    p.add_argument("--explain", action="store_true")
    for name in ("inspect", "checkpoint"):
        sub.add_parser(name)
    p = sub.add_parser("recall")
    p.add_argument("name")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--sample", type=int, default=100)
    p.add_argument("--ef", type=int, nargs="+", default=[16, 64, 128])
    p = sub.add_parser("compact")
    p.add_argument("name")
    for name in ("export", "import"):
        sub.add_parser(name).add_argument("path")
    return top


def run(spark: SparkSession, args: argparse.Namespace, out=print) -> None:
    if args.command == "init":
        out(Database.create(spark, args.database).identity)
        return
    db = Database.open(spark, args.database, read_only=args.command in ("query", "inspect", "recall", "export"))
    name = getattr(args, "name", None)
    if args.command == "create-collection":
        db.create_collection(name, args.dim, args.metric, precision=args.precision)
        db.save()
    elif args.command == "insert":
        out(db.collection(name).upsert_frame(jsonl.load(spark, args.file)))
        db.save()
    elif args.command == "delete":
        out(sum(db.collection(name).delete(i) for i in args.ids))
        db.save()
    elif args.command == "query":
        c = db.collection(name)
        options = {"ef": args.ef, "exact": args.exact, "filter": json.loads(args.filter) if args.filter else None}
        vector = c._last(args.like)["vector"] if args.like is not None and c.contains(args.like) else json.loads(args.vector)
        report = c.explain(vector, args.k, **options)
        for h in report.hits:
            out(json.dumps({"id": h["id"], "distance": h["distance"], "metadata": json.loads(h["metadata_json"] or "null")}, ensure_ascii=False))
        if args.explain:
            out(f"{report.strategy}, ef {report.ef}, visited {report.visited}, selectivity {report.filter_selectivity}")
    elif args.command == "inspect":
        out(json.dumps(db.stats()))
        for c in db:
            s = c.stats()
            out(json.dumps({"name": c.name} | s))
            if s["deleted"] * 10 >= s["live"] + s["deleted"] > 0:
                out(f"{c.name}: compact would drop {s['deleted']} nodes")
    elif args.command == "checkpoint":
        out(db.checkpoint())
    elif args.command == "compact":
        out(db.collection(name).compact())
        db.save()
    elif args.command == "recall":
        for r in db.collection(name).estimate_recall(args.k, args.sample, args.ef).orderBy("ef").collect():
            out(f"ef {r['ef']}: {r['recall']:.4f}")
    elif args.command == "export":
        archive.export(db, args.path)
    elif args.command == "import":
        archive.restore(db, args.path)


def main() -> int:
    try:
        run(SparkSession.builder.getOrCreate(), parser().parse_args())
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
