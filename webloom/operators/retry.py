"""Error classes, backoff and the log of a retry loop, computed from attempt outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The class of each known status.
PERMANENT = (400, 401, 403, 404, 405, 410)
TRANSIENT = (429, 500, 502, 503, 504)


def classify(kind: Column, status: Column) -> Column:
    """Error class of an outcome: by status where there is one, else by kind; anything else is worth another try.

    Parse errors have a class of their own. A null kind with a status is an HTTP error.
    """
    http = F.when(status.isin(*PERMANENT), "PermanentError").when(status.isin(*TRANSIENT), "TransientError").when(status < 500, "PermanentError").otherwise("TransientError")
    by_kind = F.when(kind == "timeout", "TransientError").when(kind.isin("connector", "client"), "NetworkError").when(kind == "parse", "ParseError").when(kind == "permanent", "PermanentError").otherwise("TransientError")
    return F.when((kind == "http") | kind.isNull(), F.when(status.isNotNull(), http).otherwise("TransientError")).otherwise(by_kind)


def message(kind: Column, status: Column, text: Column) -> Column:
    """The wording of a classified error."""
    said = F.coalesce(text, F.lit(""))
    return (
        F.when(((kind == "http") | kind.isNull()) & status.isNotNull(), F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), said)).when(kind == "timeout", "Request timed out")
        .when(kind == "connector", F.concat(F.lit("Connection failed: "), said)).when(kind == "client", F.concat(F.lit("Network error: "), said)).when(kind.isin("parse", "permanent"), said)
        .otherwise(F.concat(F.lit("Unknown error: "), said))
    )


def backoff(attempt: Column, base: float = 1.0, factor: float = 2.0, longest: float = 60.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt), F.lit(longest))


def should_retry(error_type: Column, retry_on: tuple[str, ...] = ("TransientError", "NetworkError")) -> Column:
    return error_type.isin(*retry_on)


def wait_before(error_type: Column, text: Column, attempt: Column, base: float = 1.0, factor: float = 2.0, longest: float = 60.0, penalty: float = 30.0) -> Column:
    """Seconds before the next try: backoff, and for a transient 429 at least the penalty, even above the longest."""
    plain = backoff(attempt, base, factor, longest)
    return F.when((error_type == "TransientError") & text.contains("429"), F.greatest(plain, F.lit(penalty))).otherwise(plain)


def attempts(outcomes: DataFrame, max_retries: int = 3) -> DataFrame:
    """The attempts a retry loop makes of those in ``outcomes``, typed; a success has the type ``ok``."""
    asked = outcomes.where(F.col("attempt") <= max_retries + 1).groupBy("url", "attempt").agg(F.min(F.struct("message", "kind", "status")).alias("o")).select("url", "attempt", "o.*")
    typed = asked.withColumn("error_type", F.when(F.coalesce(F.col("kind"), F.lit("")) == "ok", "ok").otherwise(classify(F.col("kind"), F.col("status")))).withColumn("text", message(F.col("kind"), F.col("status"), F.col("message")))
    stops = (F.col("error_type") == "ok") | ~should_retry(F.col("error_type"))
    before = Window.partitionBy("url").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    return typed.withColumn("stopped", F.coalesce(F.max(stops.cast("int")).over(before), F.lit(0))).where("stopped = 0")


def retry_totals(outcomes: DataFrame, max_retries: int = 3) -> DataFrame:
    """One row: attempts made, errors among them, urls that failed first and then came, urls that failed for good."""
    made = attempts(outcomes, max_retries)
    good = F.col("error_type") == "ok"
    return made.agg(
        F.count("*").alias("total_attempts"), F.count_if(~good).alias("total_errors"), F.count_if(good & (F.col("attempt") > 1)).alias("successful_retries"),
        F.count_distinct(F.when(F.col("error_type") == "PermanentError", F.col("url"))).alias("permanent_urls"),
    )


def simulate(outcomes: DataFrame, max_retries: int = 3, base: float = 1.0, factor: float = 2.0, longest: float = 60.0, penalty: float = 30.0) -> DataFrame:
    """The error log of a retry loop over (url, attempt from 1, kind, status, message).

    ``kind`` is ``ok`` for a success. Of repeated rows of an attempt the one with the smallest message counts. The
    loop stops at the first success, at the first error that is not retried and after ``max_retries`` retries; later
    outcomes are never asked for. Per url the attempts are few (the loop's bound), so the window is small even for a
    hot url; attempts beyond the bound are dropped before it.
    """
    run = attempts(outcomes, max_retries).where("error_type <> 'ok'")
    last = ~should_retry(F.col("error_type")) | (F.col("attempt") > max_retries)
    return run.select("url", "attempt", "error_type", F.col("text").alias("message"), F.when(~last, wait_before(F.col("error_type"), F.col("text"), F.col("attempt"), base, factor, longest, penalty)).alias("next_retry_in"))


def retry_stats(log: DataFrame) -> DataFrame:
    """Errors by class with the urls that failed for good."""
    permanent = F.count_distinct(F.when(F.col("error_type") == "PermanentError", F.col("url")))
    return log.groupBy("error_type").agg(F.count("*").alias("errors"), F.count_distinct("url").alias("urls"), permanent.alias("permanent_urls"))
