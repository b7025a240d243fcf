"""The URL frontier: insert-if-absent, order, states, and filters on what may be crawled."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.columns import falsy, netloc

# The states of an entry.
STATES = ("pending", "processing", "visited", "failed")


def first_added(frontier: DataFrame) -> DataFrame:
    """One row per url, the first added (ties: lowest priority, depth, state, error): a ranking aggregate."""
    rest = ["priority", "depth", "added_at", "state", "error"]
    pick = F.min(F.struct("added_at", "priority", "depth", "state", F.coalesce("error", F.lit("")).alias("e"), "error"))
    return frontier.groupBy("url").agg(pick.alias("r")).select("url", *(F.col(f"r.{c}").alias(c) for c in rest))


def next_urls(frontier: DataFrame, count: int) -> DataFrame:
    """The next pending urls: lowest priority first, then first added, then by url. Top-k, no full sort."""
    return first_added(frontier).where("state = 'pending'").orderBy("priority", "added_at", "url").limit(count)


def states(frontier: DataFrame) -> DataFrame:
    """The latest state of each url (ties: the greatest state)."""
    return frontier.groupBy("url").agg(F.max(F.struct("added_at", "state", F.coalesce("error", F.lit("")).alias("error"))).alias("r")).select("url", "r.state", F.nullif("r.error", F.lit("")).alias("error"))


def failed(latest: DataFrame) -> DataFrame:
    return latest.where("state = 'failed'").select("url", falsy(F.col("error"), F.lit("unknown")).alias("error"))


def frontier_stats(latest: DataFrame) -> DataFrame:
    """One row of counts; pending includes what is being processed."""
    count = lambda *s: F.count_if(F.col("state").isin(*s))
    return latest.agg(count("pending", "processing").alias("pending"), count("visited").alias("visited"), count("failed").alias("failed"), F.count("*").alias("total_seen"))


def pop(frontier: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """(the next urls, the frontier after they were taken): what is taken is being processed from then on."""
    taken = next_urls(frontier, count)
    once = first_added(frontier).join(taken.select("url", F.lit(True).alias("taken")), "url", "left")
    return taken, once.withColumn("state", F.when(F.col("taken"), "processing").otherwise(F.col("state"))).drop("taken")


def depths(urls: DataFrame, frontier: DataFrame) -> DataFrame:
    """Each url with its depth in the frontier, 0 where it is unknown."""
    known = first_added(frontier).select("url", F.col("depth").alias("known"))
    return urls.join(known, "url", "left").withColumn("depth", F.coalesce("known", F.lit(0))).drop("known")


def pending_count(latest: DataFrame) -> DataFrame:
    """One row: the urls still waiting, without those being processed."""
    return latest.agg(F.count_if(F.col("state") == "pending").alias("pending"))


def matches(url: Column, seed_domains: Iterable[str] | None = None, exclude: Iterable[str] = (), include: Iterable[str] = ()) -> Column:
    """Whether a url passes the domain, exclude and include filters (patterns are searched anywhere)."""
    test = F.lit(True)
    if seed_domains is not None:
        test = test & netloc(url).isin(*seed_domains)
    for pattern in exclude:
        test = test & ~url.rlike(pattern)
    include = list(include)
    if include:
        wanted = F.lit(False)
        for pattern in include:
            wanted = wanted | url.rlike(pattern)
        test = test & wanted
    return test


def unknown(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose url is not known yet."""
    return candidates.join(known.select("url"), "url", "left_anti")


def ordered_distinct(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values with the place of their first occurrence."""
    return df.groupBy(column).agg(F.min(order).alias(order))
