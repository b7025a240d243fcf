"""Breadth-first crawl of a corpus, level by level."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.columns import netloc
from webloom.operators.fetch import latest, success
from webloom.operators.frontier import matches
from webloom.operators.html import page_record
from webloom.operators.robots import decisions
from webloom.session import checkpoint
from webloom.sources.sitemap import discover, sitemap_urls

def ranked(df: DataFrame, order: list[str], base: int = 0, name: str = "seq") -> DataFrame:
    """``df`` with the place of each row in a total order, from ``base``: a distributed sort and the counts of its partitions.

    No task sees more than its partition; what the driver holds is one number a partition.
    """
    laid = checkpoint(df.orderBy(*order)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    offsets, total = [], base
    for number, count in sorted(laid.groupBy(part.alias("part")).agg(F.count("*")).collect()):
        offsets.append((number, total))
        total += count
    known = df.sparkSession.createDataFrame(offsets, "_part bigint, _base bigint")
    return laid.join(F.broadcast(known), part == F.col("_part")).withColumn(name, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_base")


def crawl(
    spark: SparkSession, seeds: Iterable[str] | DataFrame, corpus: DataFrame, max_pages: int = 100, max_depth: int = 2, same_domain: bool = True,
    exclude: Iterable[str] = (), include: Iterable[str] = (), robots: DataFrame | None = None, agent: str = "webloom", links: DataFrame | None = None,
) -> DataFrame:
    """Every scheduled url: url, depth, seq, ok, error, title, links_count.

    Seeds (urls, or a table of url and seq) are taken unfiltered at depth 0. Each level is cut to what is left of
    ``max_pages`` (failures and robots blocks count) in order of parent and link position; only fetched pages below
    ``max_depth`` are expanded; a link counts once, at its first occurrence. ``corpus`` holds fetch results (url, status,
    content, error, elapsed) with HTML, or with ``links`` (url, pos, link) the edges are given. The driver loops over
    levels only; each level is cut from its lineage by a checkpoint, is ranked by a distributed sort, and reads of the
    corpus only the rows of its own urls.
    """
    if not isinstance(seeds, DataFrame):
        seeds = spark.createDataFrame([(u, i) for i, u in enumerate(dict.fromkeys(seeds))], "url string, seq bigint")
    results = corpus.select("url", "status", "content", "error", "elapsed")
    level = checkpoint(seeds.select("url", F.lit(0).alias("depth"), "seq"))
    seen = level.select("url")
    domains = checkpoint(level.select(netloc(F.col("url")).alias("domain")).where("domain <> ''").distinct()) if same_domain else None
    out, scheduled = None, 0
    for depth in range(max_depth + 1):
        take = level.where(F.col("seq") < max_pages)
        count = take.count()
        if not count:
            break
        scheduled += count
        got = latest(results.join(take.select("url"), "url", "left_semi"))
        if robots is not None:
            take = decisions(take, robots, agent).drop("crawl_delay")
        else:
            take = take.withColumn("allowed", F.lit(True))
        ok = success(F.col("error"), F.col("content")) & F.col("found").isNotNull()
        fetched = take.join(got.withColumn("found", F.lit(1)), "url", "left").withColumn("fetched", F.col("allowed") & F.coalesce(ok, F.lit(False)))
        parsed = fetched.withColumn("p", page_record(F.when(F.col("fetched"), F.col("content")), F.col("url")))
        reason = F.when(~F.col("allowed"), "blocked by robots.txt").when(F.col("fetched"), F.col("p.error")).when(F.col("found").isNull(), "HTTP 404: not in corpus").otherwise(F.coalesce("error", F.lit("no content")))
        done = checkpoint(parsed.select("url", "depth", "seq", reason.isNull().alias("ok"), reason.alias("error"), F.col("p.title").alias("title"), F.col("p.links_count").alias("links_count"), F.when(reason.isNull(), F.col("p.links")).alias("links")))
        out = done.drop("links") if out is None else out.unionByName(done.drop("links"))
        if depth == max_depth or scheduled >= max_pages:
            break
        if links is None:
            edges = done.select(F.col("seq").alias("parent"), F.posexplode("links").alias("pos", "link"))
        else:
            edges = done.where("ok").select("url", F.col("seq").alias("parent")).join(links, "url").select("parent", "pos", "link")
        wanted = edges.where(matches(F.col("link"), None, exclude, include))
        if domains is not None:
            wanted = wanted.join(domains, netloc(F.col("link")) == F.col("domain"), "left_semi")
        first = wanted.groupBy(F.col("link").alias("url")).agg(F.min(F.struct("parent", "pos")).alias("at")).join(seen, "url", "left_anti")
        level = checkpoint(ranked(first.select("url", F.lit(depth + 1).alias("depth"), "at"), ["at"], scheduled).select("url", "depth", "seq"))
        seen = checkpoint(seen.union(level.select("url")))
    return out if out is not None else spark.createDataFrame([], "url string, depth int, seq bigint, ok boolean, error string, title string, links_count int")


def crawl_with_sitemaps(spark: SparkSession, seeds: Iterable[str], corpus: DataFrame, sitemaps: Iterable[str] | None = None, max_pages: int = 100, **options) -> DataFrame:
    """A crawl whose seeds are followed by the pages of their sites' sitemaps (or of those named).

    Sitemap hosts count as seed domains. What the sitemaps list stays a table.
    """
    seeds = [*dict.fromkeys(seeds)]
    starts = [*sitemaps] if sitemaps is not None else [u for s in seeds for u in discover(s)]
    found = sitemap_urls(spark, dict.fromkeys(starts), corpus.select("url", "status", "content"))
    own = spark.createDataFrame([(u, [i]) for i, u in enumerate(seeds)], "url string, path array<int>")
    more = found.select("url", F.concat(F.array(F.lit(len(seeds)).cast("int")), "path").alias("path"))
    together = own.union(more).groupBy("url").agg(F.min("path").alias("path"))
    return crawl(spark, ranked(together, ["path"]).select("url", "seq"), corpus, max_pages, **options)
