"""Command line: python -m pathweave.cli --data DIR COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from pathweave.engine import GraphEngine
from pathweave.functions import numbered_title
from pathweave.plans import manifest
from pathweave.sources import jsonapi

VERSION = "0.1.0"
#: Public host of the dump files (fixed value).
DUMP_HOST = "https://dumps.wikimedia.org"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathweave", description=__doc__)
    p.add_argument("--data", default=os.environ.get("DATA_ROOT", "data"))
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("build", "pull"):
        c = commands.add_parser(name)
        c.add_argument("--dump-date", required=True)
        c.add_argument("--dumps", required=True, help="folder of PREFIX-DATE-TABLE.sql.gz files")
        c.add_argument("--prefix", default="wiki")
        c.add_argument("--clean", action="store_true", help="remove builds of other dates")
        c.add_argument("--no-check", action="store_true", help="do not look for malformed tuples first; they are left out silently then")
        c.add_argument("--strict", action="store_true", help="build nothing if a tuple is malformed")
        if name == "pull":
            c.add_argument("--top-pages", required=True)
            c.add_argument("--base-url", required=True)
    c = commands.add_parser("run")
    c.add_argument("source")
    c.add_argument("dest")
    commands.add_parser("query").add_argument("target")
    c = commands.add_parser("find-latest")
    c.add_argument("documents", help="folder of dump status documents")
    c.add_argument("--date", action="store_true")
    c.add_argument("--urls", action="store_true")
    c.add_argument("--relative", action="store_true", help="URLs as the documents give them, relative to the host")
    c.add_argument("--host", default=DUMP_HOST)
    c = commands.add_parser("sitemap")
    c.add_argument("--top-pages", required=True)
    c.add_argument("--base-url", required=True)
    commands.add_parser("make-top-graph").add_argument("--top-pages", required=True)
    for name in ("status", "random", "probe", "validate", "version"):
        commands.add_parser(name)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    spark = spark or SparkSession.builder.appName("pathweave").getOrCreate()
    engine = GraphEngine(spark, args.data, getattr(args, "dump_date", None))
    if args.command in ("build", "pull") and not args.no_check:
        wrong = engine.malformed(args.dumps, args.prefix).groupBy("file", "error").count().orderBy("file", "error").collect()
        for r in wrong:
            print(f"{r.file}: {r['count']} tuples not loaded: {r.error}", file=sys.stderr)
        if wrong and args.strict:
            return 1
    if args.command == "build":
        built = engine.build(engine.dump_tables(args.dumps, args.prefix), clean=args.clean)
        print(json.dumps(vars(built) | {"rates": built.rates()}))
    elif args.command == "pull":
        articles = jsonapi.top_pages(jsonapi.read_documents(spark, args.top_pages))
        done = engine.refresh(engine.dump_tables(args.dumps, args.prefix), articles, args.base_url, args.clean)
        print("built" if done else "up to date")
    elif args.command == "run":
        try:
            found = engine.paths_by_title(args.source, args.dest)
        except KeyError as missing:
            print(f"no page {missing}", file=sys.stderr)
            return 1
        print("\n".join(found) or "no path found")
    elif args.command == "query":
        rows = engine.neighbors(args.target)
        for r in rows.select("direction", numbered_title(rows["id"], rows["title"]).alias("line")).orderBy("direction", "line").toLocalIterator():
            print(f"{r.direction}\t{r.line}")
    elif args.command == "find-latest":
        documents = jsonapi.read_documents(spark, args.documents)
        newest = jsonapi.latest_dump(jsonapi.dump_catalog(documents)).first()
        if newest is None:
            print("no complete dump", file=sys.stderr)
            return 1
        day = newest.dump_date.strftime("%Y%m%d")
        if args.date or not args.urls:
            print(day)
        if args.urls:
            for r in jsonapi.dump_files(documents).filter(f"split_part(url, '/', 3) = '{day}'").select("url").distinct().orderBy("url").toLocalIterator():
                print(r.url if args.relative or "://" in r.url else args.host.rstrip("/") + r.url)
    elif args.command == "sitemap":
        print("\n".join(engine.sitemap(jsonapi.top_pages(jsonapi.read_documents(spark, args.top_pages)), args.base_url)))
    elif args.command == "make-top-graph":
        print(engine.make_top_graph(jsonapi.top_pages(jsonapi.read_documents(spark, args.top_pages))))
    elif args.command == "status":
        print(json.dumps(engine.status() | {"current": manifest.current(spark, engine.base)}))
    elif args.command == "random":
        page = engine.random_page()
        print(json.dumps(page))
        return int(page is None)
    elif args.command == "probe":
        probe = engine.probe()
        print(json.dumps(probe))
        return int(probe is None)
    elif args.command == "validate":
        rows = engine.validate().collect()
        for r in rows:
            print(f"{r['check']}\t{r.failures}")
        return int(any(r.failures for r in rows))
    return 0


if __name__ == "__main__":
    sys.exit(main())
