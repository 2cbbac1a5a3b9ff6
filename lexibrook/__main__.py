"""python -m lexibrook [--data-dir DIR] add FILE | index | search QUERY [--or] [--ranked] | stats | check | recover"""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexibrook", description=__doc__)
    p.add_argument("--data-dir", default="./lexibrook_data")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("add").add_argument("file")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-o", "--or", dest="any", action="store_true")
    s.add_argument("--ranked", action="store_true")
    for name in ("index", "stats", "check", "recover"):
        sub.add_parser(name)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """Exit codes: 0 done (no match included), 1 no documents or an unreadable file, 2 wrong usage, stored data or drift."""
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from lexibrook.engine import Engine, NoDocuments

    engine = Engine(spark or SparkSession.builder.appName("lexibrook").getOrCreate(), args.data_dir)
    try:
        if args.command == "add":
            for r in engine.add_files(args.file).collect():
                print(f"added {r['doc_id']}: {r['path']}")
        elif args.command == "index":
            print("documents {}, terms {}".format(*engine.index()))
        elif args.command == "search":
            n = 0
            for n, r in enumerate(engine.search(args.query, "or" if args.any else "and", args.ranked).toLocalIterator(), 1):
                print(f"{r['rank']}. [{r['exact']:.4f}] {r['doc_id']}: {r['preview']}" if args.ranked else f"{r['doc_id']}: {r['preview']}")
            if not n:
                print("no matches")
        elif args.command == "check":
            report = engine.check()
            print(report)
            return 0 if report["ok"] else 2
        else:
            print(getattr(engine, args.command)())
    except NoDocuments:
        print("there are no documents yet", file=sys.stderr)
        return 1
    except PySparkException as e:
        print(str(e).splitlines()[0], file=sys.stderr)
        return 1 if args.command == "add" else 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
