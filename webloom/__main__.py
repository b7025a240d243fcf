"""``python -m webloom``: crawl a corpus of fetch results, or query stored pages."""

from __future__ import annotations

import argparse
import json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="webloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl", help="breadth-first crawl of a corpus")
    c.add_argument("urls", nargs="*")
    c.add_argument("--corpus", help="Parquet of fetch results")
    c.add_argument("--robots", help="Parquet of robots.txt files")
    c.add_argument("--config", help="JSON or YAML with the same names; flags win")
    c.add_argument("--max-pages", type=int)
    c.add_argument("--max-depth", type=int)
    c.add_argument("--any-domain", action="store_true", default=None)
    c.add_argument("--exclude", action="append")
    c.add_argument("--include", action="append")
    c.add_argument("--output", help="Parquet folder for what was scheduled")
    q = sub.add_parser("query", help="SQL over a Parquet of pages, as view pages")
    q.add_argument("pages")
    q.add_argument("sql")
    return p


#: What a configuration may hold besides the flags' names.
KNOWN = {"start_urls", "corpus", "robots", "max_pages", "max_depth", "any_domain", "exclude", "include", "output"}


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from webloom.plans.crawl import crawl
    from webloom.sources.readers import load_config, sql

    spark = SparkSession.builder.appName("webloom").getOrCreate()
    if args.command == "query":
        for row in sql(spark, spark.read.parquet(args.pages), args.sql).toLocalIterator():
            print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))
        return
    config = load_config(args.config) if args.config else {}
    if unknown := set(config) - KNOWN:
        raise SystemExit(f"unknown configuration: {', '.join(sorted(unknown))}")
    given = {k: v for k, v in vars(args).items() if k in KNOWN and v is not None}
    config |= given
    seeds = args.urls or config.get("start_urls", [])
    robots = spark.read.parquet(config["robots"]) if config.get("robots") else None
    pages = crawl(spark, seeds, spark.read.parquet(config["corpus"]), config.get("max_pages", 100), config.get("max_depth", 2), not config.get("any_domain"), config.get("exclude", []), config.get("include", []), robots)
    if config.get("output"):
        pages.write.mode("overwrite").parquet(config["output"])
    else:
        pages.orderBy("depth", "seq").show(50, truncate=70)


if __name__ == "__main__":
    main()
