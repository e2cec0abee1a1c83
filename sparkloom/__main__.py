"""Command line: ``python -m sparkloom query|dry-run|cube|tables --mdl manifest.json --data folder ...``."""

from __future__ import annotations

import argparse
import csv
import json
import sys
from typing import TextIO

from sparkloom.operators.cube import CubeQuery, parse_filter, parse_time
from sparkloom.session import Engine
from sparkloom.sources import readers


def show(df, form: str, out: TextIO, limit: int) -> None:
    """At most ``limit`` rows as a table, CSV or JSON lines; nulls are empty, or null in JSON."""
    rows, names = df.limit(limit).collect(), df.columns
    if form == "json":
        for r in rows:
            out.write(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False) + "\n")
        return
    cells = [["" if v is None else str(v) for v in r] for r in rows]
    if form == "csv":
        w = csv.writer(out, lineterminator="\n")
        w.writerow(names)
        w.writerows(cells)
        return
    width = [max(map(len, column)) for column in zip(names, *cells)]
    line = lambda row: " | ".join(v.ljust(n) for v, n in zip(row, width)).rstrip() + "\n"
    out.write(line(names) + "-+-".join("-" * n for n in width) + "\n" + "".join(map(line, cells)))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("query", "dry-run", "cube", "tables"):
        s = sub.add_parser(name)
        s.add_argument("--mdl", help="manifest: JSON file")
        s.add_argument("--data", required=True, help="folder of Parquet or CSV files, one a table")
        s.add_argument("--suffix", default="parquet", choices=("parquet", "csv"))
        s.add_argument("--output", default="table", choices=("table", "csv", "json"))
        s.add_argument("--limit", type=int, default=100)
        s.add_argument("--property", action="append", default=[], metavar="NAME=VALUE", help="session property of access rules")
        if name in ("query", "dry-run"):
            s.add_argument("sql")
        if name == "cube":
            s.add_argument("name")
            s.add_argument("--measure", action="append", default=[])
            s.add_argument("--dimension", action="append", default=[])
            s.add_argument("--time", action="append", default=[], metavar="NAME:GRAIN[:START,END]")
            s.add_argument("--filter", action="append", default=[], metavar="NAME:OPERATOR[:VALUE]")
    return p


def main(argv: list[str] | None = None, *, spark=None, out: TextIO | None = None) -> int:
    """Runs a command; 0 if it went well, 1 with the reason on the error stream if not."""
    args, out = parser().parse_args(argv), out or sys.stdout
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("sparkloom").getOrCreate()
    try:
        e = Engine(spark)
        for name, df in readers.discover(spark, args.data, args.suffix).items():
            e.register(name, df)
        if args.mdl:
            with open(args.mdl, encoding="utf-8") as f:
                e.load(json.load(f))
        props = dict(x.split("=", 1) for x in args.property)
        if args.command == "tables":
            out.write("".join(f"{t}\n" for t in e.tables()))
        elif args.command == "dry-run":
            out.write(e.dry_run(args.sql, props) + "\n")
        elif args.command == "query":
            show(e.query(args.sql, properties=props), args.output, out, args.limit)
        else:
            times, filters = map(parse_time, args.time), map(parse_filter, args.filter)
            q = CubeQuery(args.name, tuple(args.measure), tuple(args.dimension), tuple(times), tuple(filters), args.limit)
            show(e.cube_query(q, props), args.output, out, args.limit)
        return 0
    except Exception as x:  # noqa: BLE001 - the command line shows reasons, not traces
        sys.stderr.write(f"{type(x).__name__}: {str(x).splitlines()[0] if str(x) else ''}\n")
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
