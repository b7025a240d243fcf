"""Fetching from a corpus: requests joined to what was saved, results turned into page records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.columns import content_type, http_status
from webloom.operators.html import page_record
from webloom.schema import PAGE


def success(error: Column, content: Column) -> Column:
    """A fetch with content and without an error; an empty text is content."""
    return error.isNull() & content.isNotNull()


def latest(results: DataFrame, key: str = "url", order: tuple[str, ...] = ("elapsed", "status", "error", "content")) -> DataFrame:
    """One row per key: the greatest by ``order``, nulls lowest. A ranking aggregate, so hot keys combine map-side."""
    rest = [c for c in results.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*(F.struct(F.col(c).isNotNull(), F.col(c)) for c in order)))
    return results.groupBy(key).agg(best.alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def fetch_results(results: DataFrame) -> DataFrame:
    """Fetch results with the derived success, the status found in error texts and a plain content type."""
    return results.select("url", F.coalesce("status", http_status(F.col("error"))).alias("status"), "content", content_type(F.col("content_type")).alias("content_type"), "error", F.coalesce("elapsed", F.lit(0.0)).alias("elapsed"), success(F.col("error"), F.col("content")).alias("success"))


def fetch_bodies(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(url, body) of each distinct request: the content, or the empty text on any failure."""
    wanted = requests.select("url").distinct()
    got = latest(results.join(wanted, "url", "left_semi"))  # contents of no request are not aggregated
    body = F.when(success(F.col("error"), F.col("content")), F.col("content")).otherwise(F.lit(""))
    return wanted.join(got, "url", "left").select("url", F.coalesce(body, F.lit("")).alias("body"))


def fetch_and_parse(results: DataFrame, now: Column | None = None) -> DataFrame:
    """Page records of fetch results; a failed fetch gives an empty record with its error.

    Null errors of rows without content read ``no content``; repeated rows are parsed each.
    """
    ok = success(F.col("error"), F.col("content"))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx") if now is None else now
    rows = fetch_results(results).withColumn("ok", ok)
    parsed = rows.withColumn("p", page_record(F.when(F.col("ok"), F.col("content")), F.col("url")))
    fields = [part.strip().split(" ")[0] for part in _top_level(PAGE)]
    columns = [F.col(f"p.{f}").alias(f) for f in fields if f != "error"]
    error = F.when(F.col("ok"), F.col("p.error")).otherwise(F.coalesce("error", F.lit("no content")))
    return parsed.select(*columns, error.alias("error"), F.when(F.col("ok"), F.col("elapsed")).alias("fetch_elapsed"), F.col("status").alias("status_code"), "content_type", stamp.alias("crawled_at"))


def _top_level(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(ddl[start:i])
            start = i + 1
    return [*out, ddl[start:]]
