"""Command line: python -m krigmesh {validate,run,compare,search} ..."""

from __future__ import annotations

import argparse
import json
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="krigmesh")
    sub = p.add_subparsers(dest="what", required=True)
    v = sub.add_parser("validate", help="check a decision file")
    v.add_argument("--decision", required=True)
    v.add_argument("--request")
    r = sub.add_parser("run", help="run targets of a point table")
    r.add_argument("--points", required=True)
    r.add_argument("--predictors", required=True)
    r.add_argument("--targets", default="all")
    r.add_argument("--x", default="x")
    r.add_argument("--y", default="y")
    r.add_argument("--dry-run", action="store_true")
    s = sub.add_parser("search", help="search a chunk file")
    s.add_argument("--chunks", required=True)
    s.add_argument("--query", required=True)
    s.add_argument("--top-k", type=int, default=8)
    c = sub.add_parser("compare", help="choose among run records (JSON lines)")
    c.add_argument("--runs", required=True)
    c.add_argument("--target")
    c.add_argument("--run-prefix")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.what == "validate":
        from .operators.control import validate_decision

        read = lambda f: json.loads(Path(f).read_text(encoding="utf-8"))
        out = validate_decision(read(a.decision), read(a.request) if a.request else None)
        print(json.dumps(out, indent=2))
        return 0 if out["valid"] else 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.appName("krigmesh").getOrCreate()
    if a.what == "search":
        from .plans.records import search_record
        from .sources.tables import read_chunks

        print(json.dumps(search_record(read_chunks(spark, a.chunks), a.query, a.top_k), ensure_ascii=False, indent=2))
    elif a.what == "compare":
        from .operators.control import compare_runs

        runs = spark.read.json(a.runs).withColumns({"source_file": F.input_file_name(), "ord": F.monotonically_increasing_id()})
        print("\n".join(compare_runs(runs, a.target, a.run_prefix).toJSON().collect()))
    else:
        from .functions.numeric import to_number
        from .plans.batch import batch, targets_of
        from .sources.tables import read_points

        pts, predictors = read_points(spark, a.points), a.predictors.split(",")
        targets = targets_of(pts.columns, ["code", a.x, a.y, *predictors], a.targets)
        pts = pts.withColumns({"x": to_number(a.x), "y": to_number(a.y), **{c: to_number(c) for c in predictors}})
        for row in batch(pts, targets, predictors, dry_run=a.dry_run):
            print(json.dumps(row, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
