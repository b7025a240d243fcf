"""The polite schedule of requests in closed form.

Serving a bucket's requests in order with at least ``gap`` between starts, each start put off by its own jitter, means
start_i = max(arrival_i, start_{i-1} + gap) + jitter_i. With c_i the sum of all gaps and jitters up to i, that is c_i +
max over j <= i of (arrival_j + jitter_j - c_j): a running maximum. A window over a whole bucket would put a hot bucket
into one task, so rows are cut into time slices: per slice the sum and the maximum combine (a max-plus monoid), a scan
over the few slice totals gives each slice its start, and windows run within slices only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of arrivals in a slice.
SLICE_SECONDS = 60


def required_gap(rps: float = 1.0, min_delay: float = 0.0) -> float:
    """Seconds between two starts: what the rate asks for, and never less than the delay."""
    return max(1.0 / max(rps, 0.001), min_delay)


def seeded_jitter(jitter: float, seed: int, *parts: Column) -> Column:
    """Microseconds from 0 to below ``jitter`` seconds, spread evenly and the same in every run: by a hash of the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    drawn = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.shiftrightunsigned(drawn * F.lit(round(jitter * 1_000_000)).cast("bigint"), 32)


def schedule(
    arrivals: DataFrame, gap: float, bucket: str = "bucket", arrival: str = "arrival", order: tuple[str, ...] = ("seq",), slice_seconds: int = SLICE_SECONDS,
    jitter: float = 0.0, seed: int = 0, per_domain: bool = True,
) -> DataFrame:
    """Each request with ``start_us`` and ``wait_us`` (microseconds), served per bucket in order of arrival, then ``order``.

    The wait does not count time spent queued behind others: it is start - max(arrival, previous start), jitter
    included. A null bucket is the bucket ``_global``, and so is every one unless ``per_domain``; a null arrival is left
    out; repeated rows are requests of their own, and rows that tie are served in order of all their columns.
    """
    step = F.lit(round(gap * 1_000_000)).cast("bigint")
    key = F.coalesce(F.col(bucket), F.lit("_global")) if per_domain else F.lit("_global")
    rows = arrivals.where(F.col(arrival).isNotNull()).withColumn("bucket_key", key).withColumn("arrival_us", F.round(F.col(arrival) * 1_000_000).cast("bigint"))
    late = seeded_jitter(jitter, seed, F.col("bucket_key"), F.col("arrival_us"), *map(F.col, order)) if jitter > 0 else F.lit(0).cast("bigint")
    rows = rows.withColumn("slice", F.floor(F.col("arrival_us") / (slice_seconds * 1_000_000))).withColumn("jitter_us", late)
    rest = [c for c in arrivals.columns if c not in order]
    inside = Window.partitionBy("bucket_key", "slice").orderBy("arrival_us", *order, *rest)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("n", F.row_number().over(inside)).withColumn("load_us", F.sum(step + F.col("jitter_us")).over(so_far))
    numbered = numbered.withColumn("lead_us", F.max(F.col("arrival_us") + F.col("jitter_us") - F.col("load_us")).over(so_far))
    # slices of a bucket, in order: what was served before, and the running maximum of what came before
    totals = numbered.groupBy("bucket_key", "slice").agg(F.max("load_us").alias("load"), F.max("lead_us").alias("peak"))
    across = Window.partitionBy("bucket_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.withColumn("base", F.coalesce(F.sum("load").over(across), F.lit(0)))
    placed = placed.withColumn("prior", F.max(F.col("peak") - F.col("base")).over(across)).select("bucket_key", "slice", "base", "prior")
    joined = numbered.join(placed, ["bucket_key", "slice"])
    own = F.col("lead_us") - F.col("base")
    started = joined.withColumn("start_us", F.greatest(own, F.coalesce("prior", own)) + F.col("base") + F.col("load_us"))
    # the start before this one: within the slice by lag, at its head from the slices before
    before = Window.partitionBy("bucket_key", "slice").orderBy("n")
    previous = F.coalesce(F.lag("start_us").over(before), F.col("prior") + F.col("base"))
    waited = started.withColumn("wait_us", F.col("start_us") - F.greatest(F.col("arrival_us"), F.coalesce(previous, F.col("arrival_us"))))
    return waited.select(*arrivals.columns, "bucket_key", "arrival_us", "start_us", "wait_us")


def crawl_delayed(scheduled: DataFrame, delays: DataFrame) -> DataFrame:
    """The schedule with ``fetch_us``: the start, put off by the crawl delay (seconds) of the bucket's robots rules.

    ``delays`` has bucket_key and crawl_delay, one row a bucket; a bucket without one is not delayed. The limiter's
    own starts stay, as the delay is slept after its turn.
    """
    delay = F.coalesce(F.col("crawl_delay"), F.lit(0)).cast("bigint") * 1_000_000
    return scheduled.join(delays.select("bucket_key", "crawl_delay"), "bucket_key", "left").withColumn("fetch_us", F.col("start_us") + delay)


def limiter_stats(scheduled: DataFrame) -> DataFrame:
    """One row: waits, their total and mean in seconds (three decimals), buckets other than ``_global``."""
    waits = F.count_if(F.col("wait_us") > 0)
    total = F.coalesce(F.sum(F.col("wait_us")), F.lit(0)) / 1_000_000
    return scheduled.agg(waits.alias("total_waits"), F.round(total, 3).alias("total_wait_time"), F.when(waits > 0, F.round(total / waits, 3)).otherwise(0.0).alias("avg_wait"), F.count_distinct(F.when(F.col("bucket_key") != "_global", F.col("bucket_key"))).alias("domains_tracked"))
