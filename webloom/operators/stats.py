"""Crawl statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.columns import error_label, netloc, safe_divide


def domain_counts(pages: DataFrame) -> DataFrame:
    return pages.select(netloc(F.col("url")).alias("domain")).where("domain <> ''").groupBy("domain").agg(F.count("*").alias("pages"))


def status_counts(pages: DataFrame, column: str = "status_code") -> DataFrame:
    return pages.where(F.col(column).isNotNull() & (F.col(column) != 0)).groupBy(column).agg(F.count("*").alias("pages"))


def error_counts(failures: DataFrame) -> DataFrame:
    return failures.groupBy(error_label(F.col("error")).alias("error_type")).agg(F.count("*").alias("failures"))


def top(counts: DataFrame, key: str, value: str, k: int = 10) -> DataFrame:
    """The k greatest, ties by key."""
    return counts.orderBy(F.desc(value), key).limit(k)


def summary(results: DataFrame, seconds: Column) -> DataFrame:
    """One row over fetch results with ``success``: totals, rate, mean fetch time of successes."""
    good = F.count_if("success")
    total = F.count("*")
    took = F.round(seconds, 2)
    return results.agg(total.alias("total_pages"), good.alias("successful"), (total - good).alias("failed"), F.max(took).alias("elapsed_seconds"), F.round(safe_divide(total, F.max(took)), 2).alias("pages_per_second"), F.round(safe_divide(F.coalesce(F.sum(F.when(F.col("success"), F.col("elapsed"))), F.lit(0.0)), good), 3).alias("avg_fetch_time"))


def counts_as_map(counts: DataFrame, key: str, value: str) -> DataFrame:
    """A small table of counts as one map row."""
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(value).alias("v"))))).alias("counts"))


def counts_text(counts: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """A small table of counts as one text, ``key=count`` in order of keys."""
    pairs = F.array_sort(F.collect_list(F.concat_ws("=", F.col(key).cast("string"), F.col(value).cast("string"))))
    return counts.agg(F.array_join(pairs, ", ").alias(name))


def beside(*rows: DataFrame) -> DataFrame:
    """Several tables of one row each as one row."""
    out = rows[0].withColumn("_one", F.lit(1))
    for row in rows[1:]:
        out = out.join(row.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def full_summary(results: DataFrame, seconds: Column, top_k: int = 10) -> DataFrame:
    """One row with the totals of ``summary``, the counts of statuses and error types, and the most frequent domains."""
    good = results.where("success")
    statuses = counts_text(status_counts(good, "status"), "status", "pages", "status_codes")
    domains = counts_text(top(domain_counts(good), "domain", "pages", top_k), "domain", "pages", "top_domains")
    errors = counts_text(error_counts(results.where(~F.col("success"))), "error_type", "failures", "error_types")
    return beside(summary(results, seconds), statuses, domains, errors)


def progress(visited: Column, failed: Column, queued: Column, max_pages: int, seconds: Column) -> dict[str, Column]:
    """The columns of a progress snapshot; the rest is unknown while nothing is done and zero when nothing is left."""
    completed = visited + failed
    remaining = F.greatest(F.lit(max_pages) - completed, F.lit(0))
    speed = safe_divide(completed.cast("double"), seconds)
    percent = F.least(F.lit(100.0), completed * 100.0 / max_pages) if max_pages else F.lit(100.0)
    eta = F.when(remaining == 0, 0.0).when(speed == 0, F.lit(None).cast("double")).otherwise(F.round(remaining / speed, 1))
    return {"completed": completed, "queued": queued, "max_pages": F.lit(max_pages), "percent": F.round(percent, 1), "speed": F.round(speed, 2), "eta_seconds": eta, "failed": failed}
