"""Command line: create-index, extract-ngrams, search, search-service."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from lexigram import build
from lexigram.config import BuildConf, SearchConf
from lexigram.operators.store import open_index
from lexigram.plans.search import QUERY_TYPES, SearchArgs, results, search


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexigram", description="n-gram tables over text corpora")
    p.add_argument("-ngram-size", "--ngram-size", type=int, default=2)
    p.add_argument("-attrs", "--attrs", default="")
    p.add_argument("-limit", "--limit", type=int, default=-1)
    p.add_argument("-offset", "--offset", type=int, default=0)
    p.add_argument("-qtype", "--qtype", choices=QUERY_TYPES, default="default")
    p.add_argument("-conf-path", "--conf-path", default="lexigram.json")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("create-index", "extract-ngrams"):
        sub.add_parser(name).add_argument("conf")
    one = sub.add_parser("search")
    one.add_argument("corpus")
    one.add_argument("query")
    sub.add_parser("search-service")
    sub.add_parser("help")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.command == "help":
        p.print_help()
        return 0
    spark = spark or SparkSession.builder.appName("lexigram").getOrCreate()
    began = time.time()
    if args.command == "create-index":
        print(build.build_index(spark, BuildConf.load(args.conf), args.ngram_size))
    elif args.command == "extract-ngrams":
        print(build.extract_ngrams(spark, BuildConf.load(args.conf), args.ngram_size))
    elif args.command == "search":
        conf = SearchConf.load(args.conf_path)
        attrs = [a.strip() for a in args.attrs.split(",") if a.strip()]
        asked = SearchArgs(args.query, args.qtype, attrs, args.offset, args.limit)
        index = open_index(spark, f"{conf.data_path}/{args.corpus}/ngrams")
        for i, r in enumerate(results(search(index, asked))):
            print(f"res[{i}]: {' '.join(r['ngram'])} ({r['count']}, {r['args']})")
    else:
        from lexigram.server import serve

        serve(spark, SearchConf.load(args.conf_path))
    print(f"{time.time() - began:.3f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
