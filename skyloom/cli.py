"""Command line: reading DATE, scan FIRST LAST, map DATE."""

from __future__ import annotations

import argparse

from skyloom import api
from skyloom.session import session
from skyloom.sources.frames import days
from skyloom.sources.mesh import fibonacci


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="skyloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("reading").add_argument("date")
    scan = commands.add_parser("scan")
    scan.add_argument("first")
    scan.add_argument("last")
    scan.add_argument("--top", type=int, default=10)
    heat = commands.add_parser("map")
    heat.add_argument("date")
    heat.add_argument("--nodes", type=int, default=2000)
    args = parser.parse_args(argv)
    spark = session()
    if args.command == "reading":
        out = api.reading(spark, api.to_jd(spark, args.date))
    elif args.command == "scan":
        out = api.scan(spark, days(spark, api.to_jd(spark, args.first), api.to_jd(spark, args.last)), args.top)
    else:
        out = api.heatmap(spark, api.to_jd(spark, args.date), fibonacci(spark, args.nodes))
    for line in out.toJSON().toLocalIterator():
        print(line)


if __name__ == "__main__":
    main()
