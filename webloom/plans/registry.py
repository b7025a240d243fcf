"""Named queries of the core and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.columns import AUTHORITY, bucket_key, content_type, falsy, falsy_number, http_status, is_valid_url, kilobytes, netloc, origin, path_tail, shorten
from webloom.operators import books, fetch, frontier, html, limiter, records, retry, robots, stats
from webloom.operators.nested import COLLECTIONS, flatten, node_table
from webloom.plans import fixtures
from webloom.plans.crawl import crawl, ranked
from webloom.schema import FRONTIER
from webloom.session import scratch, table
from webloom.sources import readers, sinks, sitemap
from webloom.streaming import twins

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HOST = f"regexp_extract(url, '{AUTHORITY}', 1)"


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# nested records


@query("p6_nodes")
def p6_nodes(s, d):
    return flatten(table(s, d, "pages"), "id", {"metadata_json": None, "links_json": "links"})


#: The walk as a recursion over JSON values: a value is plain, a collection, or a node.
NODES = f"""
WITH RECURSIVE texts AS (SELECT id, name, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM (SELECT id, '' AS name, metadata_json AS t FROM pages UNION ALL SELECT id, 'links', links_json FROM pages)),
decoded AS (SELECT id, name, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN (j ->> '$')::JSON END ELSE j END AS j FROM texts),
walk(id, path, parent, value, state) AS (
SELECT id, name, '$', j, CASE WHEN name = '' THEN 'plain' ELSE 'collection' END FROM decoded WHERE json_type(j) IN ('OBJECT', 'ARRAY')
UNION ALL
SELECT w.id,
 CASE WHEN w.state = 'collection' AND json_type(w.value) = 'OBJECT' THEN w.path || '[0]' WHEN json_type(w.value) = 'ARRAY' THEN w.path || '[' || e.key || ']' WHEN w.path = '' THEN e.key ELSE w.path || '.' || e.key END,
 CASE WHEN w.state = 'node' THEN w.path ELSE w.parent END,
 CASE WHEN w.state = 'collection' AND json_type(w.value) = 'OBJECT' THEN w.value ELSE e.value END,
 CASE WHEN w.state = 'collection' THEN CASE WHEN json_type(w.value) = 'OBJECT' OR json_type(e.value) = 'OBJECT' OR json_type(e.value) = 'VARCHAR' THEN 'node' ELSE 'plain' END
      WHEN json_type(w.value) = 'OBJECT' AND e.key IN {COLLECTIONS} THEN 'collection' ELSE 'plain' END
FROM walk w, LATERAL (SELECT unnest(CASE WHEN w.state = 'collection' AND json_type(w.value) = 'OBJECT' THEN [{{'key': '0', 'value': w.value}}]
  WHEN json_type(w.value) = 'OBJECT' THEN list_transform(json_keys(w.value), lambda k: {{'key': k, 'value': w.value -> ('$."' || k || '"')}})
  WHEN json_type(w.value) = 'ARRAY' THEN list_transform(range(json_array_length(w.value)::BIGINT), lambda i: {{'key': i::VARCHAR, 'value': w.value -> ('$[' || i || ']')}}) END) AS e)
WHERE (json_type(e.value) IN ('OBJECT', 'ARRAY') OR w.state = 'collection' AND w.path = 'links' AND w.parent = '$' AND json_type(e.value) = 'VARCHAR'))
SELECT id, parent AS parent_path, path AS node_path FROM walk WHERE state = 'node'
"""


@query("p6_found", NODES)
def p6_found(s, d):
    return flatten(table(s, d, "pages"), "id", {"metadata_json": None, "links_json": "links"}, fields=False).select("id", "parent_path", "node_path")


@query("p6_images")
def p6_images(s, d):
    """The flat table of one node type, with the intervals that link it to the others."""
    return node_table(flatten(table(s, d, "pages"), "id", {"metadata_json": None, "links_json": "links"}), "images")


# url functions


@query("url_parts", f"SELECT id, {HOST} AS netloc, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin, coalesce(regexp_matches(url, '^(?i:https?)://[^/?#]'), false) AS valid FROM pages")
def url_parts(s, d):
    return table(s, d, "pages").select("id", netloc(F.col("url")).alias("netloc"), origin(F.col("url")).alias("origin"), is_valid_url(F.col("url")).alias("valid"))


@query("bucket_keys", f"SELECT id, coalesce(nullif({HOST}, ''), '_global') AS bucket FROM pages")
def bucket_keys(s, d):
    return table(s, d, "pages").select("id", bucket_key(F.col("url")).alias("bucket"))


@query("url_tails", "SELECT id, split_part(url, '/', -1) AS tail FROM pages")
def url_tails(s, d):
    return table(s, d, "pages").select("id", path_tail(F.col("url")).alias("tail"))


@query("domain_counts", f"SELECT {HOST} AS domain, count(*) AS pages FROM pages WHERE {HOST} <> '' GROUP BY 1")
def domain_counts(s, d):
    return stats.domain_counts(table(s, d, "pages"))


@query("domain_top10", f"SELECT {HOST} AS domain, count(*) AS pages FROM pages WHERE {HOST} <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def domain_top10(s, d):
    return stats.top(stats.domain_counts(table(s, d, "pages")), "domain", "pages")


@query("active_domains", f"SELECT DISTINCT {HOST} AS domain FROM frontier WHERE {HOST} <> ''")
def active_domains(s, d):
    return table(s, d, "frontier").select(netloc(F.col("url")).alias("domain")).where("domain <> ''").distinct()


# fetching

STATUS = r"coalesce(status, try_cast(nullif(regexp_extract(error, 'HTTP (\d+)', 1), '') AS INTEGER))"
PLAIN_TYPE = "trim(split_part(CASE WHEN content_type IS NULL OR content_type = '' THEN 'text/html' ELSE content_type END, ';', 1))"


@query("fetch_results", f"SELECT url, {STATUS} AS status, {PLAIN_TYPE} AS content_type, error, coalesce(elapsed, 0.0) AS elapsed, (error IS NULL AND content IS NOT NULL) AS success FROM fetch_results")
def fetch_results(s, d):
    return fetch.fetch_results(table(s, d, "fetch_results")).drop("content")


LATEST = "(SELECT * FROM fetch_results QUALIFY row_number() OVER (PARTITION BY url ORDER BY elapsed DESC NULLS LAST, status DESC NULLS LAST, error DESC NULLS LAST, content DESC NULLS LAST) = 1)"


@query("fetch_urls", f"SELECT r.url, coalesce(CASE WHEN f.error IS NULL AND f.content IS NOT NULL THEN f.content ELSE '' END, '') AS body FROM (SELECT DISTINCT url FROM frontier) r LEFT JOIN {LATEST} f ON r.url = f.url")
def fetch_urls(s, d):
    return fetch.fetch_bodies(table(s, d, "frontier"), table(s, d, "fetch_results"))


BODY = r"regexp_replace(regexp_replace(content, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '', 'g'), '<[^>]*>', ' ', 'g')"
DECODED = f"replace(replace(replace(replace({BODY}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
TEXT = rf"trim(regexp_replace({DECODED}, '\s+', ' ', 'g'))"
OK = "error IS NULL AND content IS NOT NULL AND content <> ''"


@query(
    "page_records",
    rf"SELECT url, CASE WHEN {OK} THEN nullif(replace(trim(regexp_extract(content, '<title>([^<]*)</title>', 1)), '&amp;', '&'), '') END AS title, CASE WHEN {OK} THEN {TEXT} ELSE '' END AS text, CAST(CASE WHEN {OK} THEN length({TEXT}) ELSE 0 END AS INTEGER) AS text_length, "
    f"CASE WHEN error IS NOT NULL THEN error WHEN content IS NULL THEN 'no content' WHEN content = '' THEN 'Empty HTML string received' END AS error, {STATUS} AS status_code, CASE WHEN error IS NULL AND content IS NOT NULL THEN coalesce(elapsed, 0.0) END AS fetch_elapsed FROM fetch_results",
)
def page_records(s, d):
    return fetch.fetch_and_parse(table(s, d, "fetch_results"), F.lit("2025-01-01T00:00:00+00:00")).select("url", "title", "text", "text_length", "error", "status_code", "fetch_elapsed")


@query("results_table", "SELECT url AS full_url, CASE WHEN length(url) > 50 THEN left(url, 50) || '...' ELSE url END AS shown, printf('%.1f KB', length(coalesce(content, '')) / 1024.0) AS size, CASE WHEN coalesce(content, '') <> '' THEN 'OK' ELSE 'FAIL' END AS flag FROM fetch_results")
def results_table(s, d):
    body = F.coalesce("content", F.lit(""))
    return table(s, d, "fetch_results").select(F.col("url").alias("full_url"), shorten(F.col("url"), 50).alias("shown"), kilobytes(F.char_length(body)).alias("size"), F.when(body != "", "OK").otherwise("FAIL").alias("flag"))


@query("error_type_counts", "SELECT CASE WHEN error IS NULL OR error = '' THEN 'Unknown' ELSE trim(split_part(error, ':', 1)) END AS error_type, count(*) AS failures FROM fetch_results WHERE NOT (error IS NULL AND content IS NOT NULL) GROUP BY 1")
def error_type_counts(s, d):
    rows = table(s, d, "fetch_results")
    return stats.error_counts(rows.where(~fetch.success(F.col("error"), F.col("content"))))


@query("status_counts", "SELECT status_code, count(*) AS pages FROM pages WHERE status_code IS NOT NULL AND status_code <> 0 GROUP BY 1")
def status_counts(s, d):
    return stats.status_counts(table(s, d, "pages"))


@query(
    "crawl_summary",
    "SELECT count(*) AS total_pages, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, 60.0::DOUBLE AS elapsed_seconds, round(count(*) / 60.0::DOUBLE, 2) AS pages_per_second, round(sum(elapsed) FILTER (ok) / count(*) FILTER (ok), 3) AS avg_fetch_time FROM (SELECT coalesce(elapsed, 0.0) AS elapsed, error IS NULL AND content IS NOT NULL AS ok FROM fetch_results)",
)
def crawl_summary(s, d):
    return stats.summary(fetch.fetch_results(table(s, d, "fetch_results")), F.lit(60.0).cast("double"))


TEXTS = "SELECT coalesce(string_agg(k || '=' || v, ', ' ORDER BY k || '=' || v), '') FROM"


@query(
    "crawl_summary_full",
    f"WITH r AS (SELECT {STATUS} AS status, url, error, coalesce(elapsed, 0.0) AS elapsed, error IS NULL AND content IS NOT NULL AS ok FROM fetch_results) SELECT count(*) AS total_pages, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, 60.0::DOUBLE AS elapsed_seconds, round(count(*) / 60.0::DOUBLE, 2) AS pages_per_second, "
    f"round(sum(elapsed) FILTER (ok) / count(*) FILTER (ok), 3) AS avg_fetch_time, ({TEXTS} (SELECT status AS k, count(*) AS v FROM r WHERE ok AND status IS NOT NULL AND status <> 0 GROUP BY 1)) AS status_codes, ({TEXTS} (SELECT {HOST} AS k, count(*) AS v FROM r WHERE ok AND {HOST} <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) AS top_domains, "
    f"({TEXTS} (SELECT CASE WHEN error IS NULL OR error = '' THEN 'Unknown' ELSE trim(split_part(error, ':', 1)) END AS k, count(*) AS v FROM r WHERE NOT ok GROUP BY 1)) AS error_types FROM r",
)
def crawl_summary_full(s, d):
    return stats.full_summary(fetch.fetch_results(table(s, d, "fetch_results")), F.lit(60.0).cast("double"))


@query("fetch_split", "SELECT count(*) FILTER (coalesce(error, '') = '') AS ok, count(*) FILTER (coalesce(error, '') <> '') AS failed FROM fetch_results")
def fetch_split(s, d):
    good = F.coalesce("error", F.lit("")) == ""
    return table(s, d, "fetch_results").agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"))


# frontier

FIRST = "(SELECT * FROM frontier QUALIFY row_number() OVER (PARTITION BY url ORDER BY added_at NULLS FIRST, priority NULLS FIRST, depth NULLS FIRST, state NULLS FIRST, coalesce(error, '')) = 1)"
STATE = "(SELECT url, state, nullif(coalesce(error, ''), '') AS error FROM frontier QUALIFY row_number() OVER (PARTITION BY url ORDER BY added_at DESC NULLS LAST, state DESC NULLS LAST, coalesce(error, '') DESC) = 1)"


@query("frontier_added", f"SELECT url, priority, depth, added_at, state, error FROM {FIRST}")
def frontier_added(s, d):
    return frontier.first_added(table(s, d, "frontier"))


@query("frontier_next", f"SELECT url, priority, depth FROM {FIRST} WHERE state = 'pending' ORDER BY priority NULLS FIRST, added_at NULLS FIRST, url LIMIT 100")
def frontier_next(s, d):
    return frontier.next_urls(table(s, d, "frontier"), 100).select("url", "priority", "depth")


@query("frontier_states", f"SELECT url, state, error FROM {STATE}")
def frontier_states(s, d):
    return frontier.states(table(s, d, "frontier"))


@query("frontier_failed", f"SELECT url, coalesce(error, 'unknown') AS error FROM {STATE} WHERE state = 'failed'")
def frontier_failed(s, d):
    return frontier.failed(frontier.states(table(s, d, "frontier")))


@query("frontier_stats", f"SELECT count(*) FILTER (state IN ('pending', 'processing')) AS pending, count(*) FILTER (state = 'visited') AS visited, count(*) FILTER (state = 'failed') AS failed, count(*) AS total_seen FROM {STATE}")
def frontier_stats(s, d):
    return frontier.frontier_stats(frontier.states(table(s, d, "frontier")))


@query("frontier_popped", f"SELECT url, priority, CASE WHEN state = 'pending' AND row_number() OVER (PARTITION BY state ORDER BY priority NULLS FIRST, added_at NULLS FIRST, url) <= 100 THEN 'processing' ELSE state END AS state FROM {FIRST}")
def frontier_popped(s, d):
    return frontier.pop(table(s, d, "frontier"), 100)[1].select("url", "priority", "state")


@query("frontier_lookup", f"SELECT p.id, coalesce(f.depth, 0) AS depth FROM pages p LEFT JOIN {FIRST} f ON p.url = f.url")
def frontier_lookup(s, d):
    return frontier.depths(table(s, d, "pages").select("id", "url"), table(s, d, "frontier")).select("id", "depth")


@query("frontier_pending", f"SELECT count(*) FILTER (state = 'pending') AS pending FROM {STATE}")
def frontier_pending(s, d):
    return frontier.pending_count(frontier.states(table(s, d, "frontier")))


@query("frontier_depths", f"SELECT depth, count(*) AS urls FROM {FIRST} GROUP BY 1")
def frontier_depths(s, d):
    return frontier.first_added(table(s, d, "frontier")).groupBy("depth").agg(F.count("*").alias("urls"))


@query(
    "progress_snapshot",
    f"SELECT v + f AS completed, q AS queued, 100000 AS max_pages, round(least(100.0::DOUBLE, (v + f) * 100.0::DOUBLE / 100000), 1) AS percent, round((v + f) / 60.0::DOUBLE, 2) AS speed, round((100000 - v - f) / ((v + f) / 60.0::DOUBLE), 1) AS eta_seconds, f AS failed "
    f"FROM (SELECT count(*) FILTER (state = 'visited') AS v, count(*) FILTER (state = 'failed') AS f, count(*) FILTER (state IN ('pending', 'processing')) AS q FROM {STATE})",
)
def progress_snapshot(s, d):
    one = frontier.frontier_stats(frontier.states(table(s, d, "frontier")))
    return one.select(*(c.alias(n) for n, c in stats.progress(F.col("visited"), F.col("failed"), F.col("pending"), 100000, F.lit(60.0).cast("double")).items()))


@query("unknown_urls", "SELECT url, priority, depth FROM frontier f WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = f.url)")
def unknown_urls(s, d):
    return frontier.unknown(table(s, d, "frontier").select("url", "priority", "depth"), table(s, d, "pages"))


@query("known_urls", "SELECT url, priority, depth FROM frontier f WHERE EXISTS (SELECT 1 FROM pages p WHERE p.url = f.url)")
def known_urls(s, d):
    return table(s, d, "frontier").select("url", "priority", "depth").join(table(s, d, "pages").select("url"), "url", "left_semi")


@query("url_filter", rf"SELECT id, url FROM pages WHERE {HOST} LIKE '%.test' AND NOT regexp_matches(url, '/(tag|old)/') AND NOT regexp_matches(url, '\?') AND (regexp_matches(url, '/(guide|docs)/') OR regexp_matches(url, '\.html'))")
def url_filter(s, d):
    return table(s, d, "pages").select("id", "url").where(netloc(F.col("url")).like("%.test") & frontier.matches(F.col("url"), None, ["/(tag|old)/", r"\?"], ["/(guide|docs)/", r"\.html"]))


@query("first_occurrences", "SELECT url, min(id) AS id FROM pages GROUP BY url")
def first_occurrences(s, d):
    return frontier.ordered_distinct(table(s, d, "pages"), "url", "id")


# politeness

ARRIVED = "SELECT bucket, seq, arrival, coalesce(bucket, '_global') AS k, CAST(round(arrival * 1000000) AS BIGINT) AS arrival_us FROM arrivals WHERE arrival IS NOT NULL"
STARTED = f"SELECT *, max(arrival_us - n * 1000000) OVER (PARTITION BY k ORDER BY n ROWS UNBOUNDED PRECEDING) + n * 1000000 AS start_us FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY arrival_us, seq) - 1 AS n FROM ({ARRIVED}))"
WAITED = f"SELECT *, start_us - greatest(arrival_us, coalesce(lag(start_us) OVER (PARTITION BY k ORDER BY n), arrival_us)) AS wait_us FROM ({STARTED})"


@query("rate_limit_schedule", f"SELECT k AS bucket_key, seq, arrival_us, start_us, wait_us FROM ({WAITED})")
def rate_limit_schedule(s, d):
    return limiter.schedule(table(s, d, "arrivals"), 1.0).select("bucket_key", "seq", "arrival_us", "start_us", "wait_us")


@query(
    "rate_limit_stats",
    f"SELECT count(*) FILTER (wait_us > 0) AS total_waits, round(sum(wait_us) / 1000000.0::DOUBLE, 3) AS total_wait_time, round(sum(wait_us) / 1000000.0::DOUBLE / count(*) FILTER (wait_us > 0), 3) AS avg_wait, count(DISTINCT k) FILTER (k <> '_global') AS domains_tracked FROM ({WAITED})",
)
def rate_limit_stats(s, d):
    return limiter.limiter_stats(limiter.schedule(table(s, d, "arrivals"), 1.0))


@query("rate_limit_min_delay", f"SELECT k AS bucket_key, seq, arrival_us, start_us, wait_us FROM ({WAITED.replace('n * 1000000', 'n * 700000')})")
def rate_limit_min_delay(s, d):
    return limiter.schedule(table(s, d, "arrivals"), limiter.required_gap(100.0, 0.7)).select("bucket_key", "seq", "arrival_us", "start_us", "wait_us")


JITTERED = "SELECT seq, arrival_us, (CAST('0x' || left(md5('7:_global:' || arrival_us || ':' || seq), 8) AS BIGINT) * 300000) >> 32 AS j FROM ({})"
LOADED = f"SELECT *, row_number() OVER w AS n, sum(500000 + j) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM ({JITTERED.format(ARRIVED)}) WINDOW w AS (ORDER BY arrival_us, seq, j)"
PUT_OFF = f"SELECT *, c + max(arrival_us + j - c) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS start_us FROM ({LOADED})"


@query("rate_limit_jitter", f"SELECT '_global' AS bucket_key, seq, arrival_us, CAST(start_us AS BIGINT) AS start_us, CAST(start_us - greatest(arrival_us, coalesce(lag(start_us) OVER (ORDER BY n), arrival_us)) AS BIGINT) AS wait_us FROM ({PUT_OFF})")
def rate_limit_jitter(s, d):
    """One bucket for all hosts, two requests a second and a seeded jitter of up to 0.3 s."""
    return limiter.schedule(table(s, d, "arrivals"), limiter.required_gap(2.0), jitter=0.3, seed=7, per_domain=False).select("bucket_key", "seq", "arrival_us", "start_us", "wait_us")


@query("robots_rules")
def robots_rules(s, d):
    return robots.robots_rules(table(s, d, "robots"))


@query("robots_decisions")
def robots_decisions(s, d):
    return robots.decisions(table(s, d, "pages").select("id", "url"), table(s, d, "robots"), "deskbot/1.0")


@query("robots_stats")
def robots_stats(s, d):
    return robots.robots_stats(robots_decisions(s, d), table(s, d, "robots"))


# errors and retries

TYPE = (
    "CASE WHEN kind = 'http' OR kind IS NULL THEN CASE WHEN status IS NULL THEN 'TransientError' WHEN status IN (400, 401, 403, 404, 405, 410) THEN 'PermanentError' WHEN status IN (429, 500, 502, 503, 504) THEN 'TransientError' WHEN status < 500 THEN 'PermanentError' ELSE 'TransientError' END "
    "WHEN kind = 'timeout' THEN 'TransientError' WHEN kind IN ('connector', 'client') THEN 'NetworkError' WHEN kind = 'parse' THEN 'ParseError' WHEN kind = 'permanent' THEN 'PermanentError' ELSE 'TransientError' END"
)
SAID = (
    "CASE WHEN (kind = 'http' OR kind IS NULL) AND status IS NOT NULL THEN 'HTTP ' || status || ': ' || coalesce(message, '') WHEN kind = 'timeout' THEN 'Request timed out' WHEN kind = 'connector' THEN 'Connection failed: ' || coalesce(message, '') "
    "WHEN kind = 'client' THEN 'Network error: ' || coalesce(message, '') WHEN kind IN ('parse', 'permanent') THEN coalesce(message, '') ELSE 'Unknown error: ' || coalesce(message, '') END"
)
OUTCOME = f"CASE WHEN kind = 'ok' THEN 'ok' ELSE {TYPE} END"
ASKED = f"SELECT url, attempt, {TYPE} AS error_type, {SAID} AS message FROM (SELECT * FROM retry_log WHERE attempt <= 4 QUALIFY row_number() OVER (PARTITION BY url, attempt ORDER BY message NULLS FIRST, kind NULLS FIRST, status NULLS FIRST) = 1)"
RUN = f"SELECT * FROM (SELECT *, coalesce(max(CASE WHEN error_type IN ('TransientError', 'NetworkError') THEN 0 ELSE 1 END) OVER (PARTITION BY url ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM ({ASKED})) WHERE stopped = 0"
LOG = f"SELECT url, attempt, error_type, message, CASE WHEN error_type IN ('TransientError', 'NetworkError') AND attempt <= 3 THEN CASE WHEN error_type = 'TransientError' AND contains(message, '429') THEN greatest(least(power(2.0::DOUBLE, attempt), 60.0::DOUBLE), 30.0::DOUBLE) ELSE least(power(2.0::DOUBLE, attempt), 60.0::DOUBLE) END END AS next_retry_in FROM ({RUN})"


@query("classified_errors", f"SELECT url, attempt, {TYPE} AS error_type, {SAID} AS said FROM retry_log")
def classified_errors(s, d):
    return table(s, d, "retry_log").select("url", "attempt", retry.classify(F.col("kind"), F.col("status")).alias("error_type"), retry.message(F.col("kind"), F.col("status"), F.col("message")).alias("said"))


@query("retry_log", LOG)
def retry_log(s, d):
    return retry.simulate(table(s, d, "retry_log"))


@query("retry_stats", f"SELECT error_type, count(*) AS errors, count(DISTINCT url) AS urls, count(DISTINCT url) FILTER (error_type = 'PermanentError') AS permanent_urls FROM ({LOG}) GROUP BY 1")
def retry_stats(s, d):
    return retry.retry_stats(retry.simulate(table(s, d, "retry_log")))


TOTALS = f"SELECT count(*) AS total_attempts, count(*) FILTER (error_type <> 'ok') AS total_errors, count(*) FILTER (error_type = 'ok' AND attempt > 1) AS successful_retries, count(DISTINCT url) FILTER (error_type = 'PermanentError') AS permanent_urls FROM ({RUN.replace(TYPE, OUTCOME)})"


@query("retry_totals", TOTALS)
def retry_totals(s, d):
    return retry.retry_totals(table(s, d, "retry_log"))


@query(
    "crawl_stats",
    f"SELECT q.*, w.total_waits, t.total_attempts, t.successful_retries FROM (SELECT count(*) FILTER (state IN ('pending', 'processing')) AS pending, count(*) FILTER (state = 'visited') AS visited, count(*) FILTER (state = 'failed') AS failed, count(*) AS total_seen FROM {STATE}) q, "
    f"(SELECT count(*) FILTER (wait_us > 0) AS total_waits FROM ({WAITED})) w, ({TOTALS}) t",
)
def crawl_stats(s, d):
    """The statistics of the queue, the limiter and the retries as one row."""
    waits = limiter.limiter_stats(limiter.schedule(table(s, d, "arrivals"), 1.0)).select("total_waits")
    return stats.beside(frontier_stats(s, d), waits, retry_totals(s, d).select("total_attempts", "successful_retries"))


@query("backoff_schedule", "SELECT range AS attempt, least(power(2.0::DOUBLE, range), 60.0::DOUBLE) AS wait FROM range(10)")
def backoff_schedule(s, d):
    return s.range(10).select(F.col("id").alias("attempt"), retry.backoff(F.col("id")).alias("wait"))


@query("error_statuses", r"SELECT error, try_cast(nullif(regexp_extract(error, 'HTTP (\d+)', 1), '') AS INTEGER) AS status FROM fetch_results WHERE error IS NOT NULL")
def error_statuses(s, d):
    return table(s, d, "fetch_results").where("error is not null").select("error", http_status(F.col("error")).alias("status"))


# stored records


@query(
    "stored_defaults",
    "SELECT id, url, CASE WHEN title IS NULL OR title = '' THEN '' ELSE title END AS title, CASE WHEN status_code IS NULL OR status_code = 0 THEN 200 ELSE status_code END AS status_code, CASE WHEN content_type IS NULL OR content_type = '' THEN 'text/html' ELSE content_type END AS content_type, "
    "CAST(CASE WHEN text_length IS NULL OR text_length = 0 THEN length(coalesce(text, '')) ELSE text_length END AS INTEGER) AS text_length, coalesce(links_count, 0) AS links_count FROM pages",
)
def stored_defaults(s, d):
    text = F.coalesce("text", F.lit(""))
    return table(s, d, "pages").select("id", "url", falsy(F.col("title"), F.lit("")).alias("title"), falsy_number(F.col("status_code"), F.lit(200)).alias("status_code"), falsy(F.col("content_type"), F.lit("text/html")).alias("content_type"), falsy_number(F.col("text_length"), F.char_length(text)).alias("text_length"), F.coalesce("links_count", F.lit(0)).alias("links_count"))


@query("flat_records")
def flat_records(s, d):
    return records.flat_record(fetch.fetch_and_parse(table(s, d, "fetch_results"), F.lit("2025-01-01T00:00:00+00:00")), F.lit("2025-01-01T00:00:00+00:00"))


@query("upsert_latest", "SELECT url, crawled_at, id, title, status_code FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY crawled_at DESC NULLS LAST, id DESC) AS r FROM pages) WHERE r = 1")
def upsert_latest(s, d):
    return records.upsert(table(s, d, "pages").select("url", "crawled_at", "id", "title", "status_code"), "url", ["crawled_at", "id"])


@query("csv_projection", "SELECT coalesce(CAST(id AS VARCHAR), '') AS id, coalesce(url, '') AS url, coalesce(title, '') AS title, coalesce(CAST(status_code AS VARCHAR), '') AS status_code FROM pages")
def csv_projection(s, d):
    return records.csv_projection(table(s, d, "pages").select("id", "url", "title", "status_code"))


@query("slim_export", "SELECT id, url, title, links_json, metadata_json, crawled_at, status_code, content_type, text_length, links_count FROM pages")
def slim_export(s, d):
    return table(s, d, "pages").drop("text")


@query("metadata_titles", "SELECT id, json_extract_string(metadata_json, '$.title') AS title FROM pages WHERE metadata_json IS NOT NULL AND json_valid(metadata_json)")
def metadata_titles(s, d):
    rows = table(s, d, "pages").where(F.try_parse_json("metadata_json").isNotNull())
    return rows.select("id", F.get_json_object("metadata_json", "$.title").alias("title"))


ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(
    "report_rows",
    f"SELECT id, {ESCAPED.format('url')} AS href, {ESCAPED.format('left(url, 70)')} AS shown_url, {ESCAPED.format(chr(40) + 'left(CASE WHEN title IS NULL OR title = ' + chr(39) * 2 + ' THEN ' + chr(39) + '—' + chr(39) + ' ELSE title END, 60))')} AS title, CAST(coalesce(links_count, 0) AS VARCHAR) AS links, format('{{:,}}', coalesce(text_length, 0)) AS text_length FROM pages ORDER BY id LIMIT 500",
)
def report_rows(s, d):
    return records.report_rows(table(s, d, "pages"))


@query("content_types", f"SELECT id, {PLAIN_TYPE} AS media_type FROM pages")
def content_types(s, d):
    return table(s, d, "pages").select("id", content_type(F.col("content_type")).alias("media_type"))


# written and read again


@query("json_roundtrip", "SELECT id, url, title, text, status_code FROM pages")
def json_roundtrip(s, d):
    path = scratch(s, "json")
    sinks.JsonSink(path).write(table(s, d, "pages").select("id", "url", "title", "text", "status_code"))
    return readers.read_json(s, path, "id bigint, url string, title string, text string, status_code int")


@query("csv_roundtrip", "SELECT CAST(id AS VARCHAR) AS id, coalesce(title, '') AS title, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) AS text FROM pages")
def csv_roundtrip(s, d):
    """Missing and empty text can't be told apart in CSV; line ends within fields are compared as LF."""
    path = scratch(s, "csv")
    sinks.CsvSink(path).write(table(s, d, "pages").select("id", "title", "text"))
    back = readers.read_csv(s, path)
    return back.select("id", F.coalesce("title", F.lit("")).alias("title"), F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")).alias("text"))


def _in_two_writes(s, d, **options):
    rows = table(s, d, "pages").select("url", "crawled_at", "id")
    sink = sinks.TableSink(scratch(s, "table"), ["crawled_at", "id"], **options)
    sink.write(rows.where("id % 3 <> 1"))
    sink.write(rows.where("id % 3 = 1"))
    return s.read.parquet(sink.path)


LAST = "SELECT url, crawled_at, id FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY {}crawled_at DESC NULLS LAST, id DESC) = 1"


@query("upsert_table", LAST.format("id % 3 = 1 DESC, "))
def upsert_table(s, d):
    """What the sink's table holds after two writes: the later write's row."""
    return _in_two_writes(s, d)


@query("upsert_table_newest", LAST.format(""))
def upsert_table_newest(s, d):
    """The same where the newest crawl counts, whenever it was written."""
    return _in_two_writes(s, d, newest=True)


@query("stream_new_urls", "SELECT DISTINCT url FROM frontier")
def stream_new_urls(s, d):
    path = scratch(s, "stream")
    table(s, d, "frontier").write.parquet(f"{path}-landed")
    stream = s.readStream.schema(FRONTIER).parquet(f"{path}-landed")
    twins.new_urls(stream.select("url")).writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema("url string").parquet(path)


# sql passthrough


@query("sql_where", "SELECT id, url, links_count FROM pages WHERE links_count > 10")
def sql_where(s, d):
    return readers.sql(s, table(s, d, "pages"), "SELECT id, url, links_count FROM pages WHERE links_count > ?", [10])


@query("sql_count", "SELECT count(*) AS n FROM pages")
def sql_count(s, d):
    return readers.sql(s, table(s, d, "pages"), "SELECT count(*) AS n FROM pages")


@query("sql_order_limit", "SELECT id, url FROM pages ORDER BY id LIMIT 5")
def sql_order_limit(s, d):
    return readers.sql(s, table(s, d, "pages"), "SELECT id, url FROM pages ORDER BY id LIMIT 5")


@query("sql_group", "SELECT status_code, count(*) AS n, avg(text_length) AS mean_length FROM pages GROUP BY status_code HAVING count(*) > 10")
def sql_group(s, d):
    return readers.sql(s, table(s, d, "pages"), "SELECT status_code, count(*) AS n, avg(text_length) AS mean_length FROM pages GROUP BY status_code HAVING count(*) > :least", {"least": 10})


# books

PRICE = r"try_cast(nullif(regexp_extract(price_excl_tax, '(\d+(?:\.\d+)?)', 1), '') AS DECIMAL(12, 2))"


@query("book_stats", f"SELECT count(*) AS total, count(DISTINCT genre) AS genres, count(rating) AS rated, round(avg(CAST({PRICE} AS DOUBLE)), 4) AS mean_price FROM (SELECT DISTINCT * FROM books)")
def book_stats(s, d):
    return books.book_stats(table(s, d, "books"))


@query("book_genres_top5", "SELECT genre, count(*) AS books FROM (SELECT DISTINCT * FROM books) WHERE genre IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def book_genres_top5(s, d):
    return stats.top(books.genre_counts(table(s, d, "books")), "genre", "books", 5)


@query("book_ratings", "SELECT rating, count(*) AS books FROM (SELECT DISTINCT * FROM books) WHERE rating IS NOT NULL GROUP BY 1")
def book_ratings(s, d):
    return books.rating_counts(table(s, d, "books"))


@query("book_stock", r"SELECT url, coalesce(nullif(regexp_extract(availability, '(\d+)', 1), '') || ' left', '?') AS stock FROM books")
def book_stock(s, d):
    return table(s, d, "books").select("url", books.in_stock(F.col("availability")).alias("stock"))


@query("book_prices", f"SELECT url, CAST({PRICE} AS DOUBLE) AS price FROM books")
def book_prices(s, d):
    return table(s, d, "books").select("url", books.price(F.col("price_excl_tax")).cast("double").alias("price"))


# html, crawl, sitemap and book pages on inline inputs


@query("html_links", "SELECT * FROM (VALUES ('https://loom.test/shelf/one', 0, 'https://loom.test/parts'), ('https://loom.test/shelf/one', 1, 'https://mill.test/wick?w=2&c=7'), ('https://loom.test/shelf/one', 2, 'https://loom.test/index')) t(url, pos, link)")
def html_links(s, d):
    return html.parse_pages(fixtures.pages(s)).select("url", F.posexplode("links").alias("pos", "link"))


@query("html_pages", "SELECT * FROM (VALUES ('https://loom.test/shelf/one', 'Lantern repair', 'How a storm lantern is taken apart', 'wick, brass', 3, 2, 2, 2, NULL), ('https://loom.test/blank', NULL, NULL, NULL, 0, 0, 0, 0, 'Empty HTML string received'), ('https://loom.test/none', NULL, NULL, NULL, 0, 0, 0, 0, 'Empty HTML string received'), ('https://loom.test/odd', NULL, NULL, NULL, 0, 0, 0, 0, NULL)) t(url, title, description, keywords, links_count, images_count, tables_count, lists_count, error)")
def html_pages(s, d):
    return html.parse_pages(fixtures.pages(s)).select("url", "title", "metadata.description", "metadata.keywords", "links_count", "images_count", "tables_count", "lists_count", "error")


@query("html_text", "SELECT 'https://loom.test/shelf/one' AS url, 'Lantern repair Taking apart Tools Rag oil & pliers p w p2 write e i part size cap 12 inner clean dry slowly' AS text")
def html_text(s, d):
    return html.parse_pages(fixtures.pages(s)).where("links_count > 0").select("url", "text")


@query("html_lists", "SELECT * FROM (VALUES (0, 'ul', 0, 'clean'), (0, 'ul', 1, 'dry slowly'), (1, 'ol', 0, 'slowly')) t(list, tag, pos, item)")
def html_lists(s, d):
    lists = html.parse_pages(fixtures.pages(s)).select(F.posexplode("lists").alias("list", "l"))
    return lists.select("list", "l.tag", F.posexplode("l.items").alias("pos", "item"))


@query("html_tables", "SELECT * FROM (VALUES (0, 'part|size', 0, 'cap|12'), (0, 'part|size', 1, 'inner|inner'), (0, 'part|size', 2, 'inner'), (1, '', 0, 'inner')) t(tbl, headers, pos, cells)")
def html_tables(s, d):
    tables = html.parse_pages(fixtures.pages(s)).select(F.posexplode("tables").alias("tbl", "t"))
    return tables.select("tbl", F.array_join("t.headers", "|").alias("headers"), F.posexplode("t.rows").alias("pos", "row")).select("tbl", "headers", "pos", F.array_join("row", "|").alias("cells"))


@query("html_images", "SELECT * FROM (VALUES (0, 'https://loom.test/glass.png', 'Cracked glass'), (1, 'https://pics.test/burner.png', '')) t(pos, src, alt)")
def html_images(s, d):
    return html.parse_pages(fixtures.pages(s)).select(F.posexplode("images").alias("pos", "i")).select("pos", "i.src", "i.alt")


SEEDS = ["https://quay.test/", "https://isle.test/"]


@query("crawl_site", "SELECT * FROM (VALUES ('https://quay.test/', 0, true, NULL), ('https://isle.test/', 0, true, NULL), ('https://quay.test/boats', 1, true, NULL), ('https://quay.test/sunk', 1, false, 'HTTP 404: not in corpus'), ('https://isle.test/goats', 1, true, NULL), ('https://quay.test/oars', 2, true, NULL), ('https://isle.test/fenced/kid', 2, false, 'blocked by robots.txt')) t(url, depth, ok, error)")
def crawl_site(s, d):
    return crawl(s, SEEDS, fixtures.site(s), 100, 2, robots=fixtures.site_robots(s)).select("url", "depth", "ok", "error")


@query("crawl_page_cap", "SELECT * FROM (VALUES ('https://quay.test/', 0), ('https://isle.test/', 0), ('https://quay.test/boats', 1), ('https://quay.test/sunk', 1)) t(url, depth)")
def crawl_page_cap(s, d):
    return crawl(s, SEEDS, fixtures.site(s), 4, 3).select("url", "depth")


STORED = """
SELECT DISTINCT url, CASE json_type(e) WHEN 'VARCHAR' THEN e ->> '$' WHEN 'OBJECT' THEN CASE WHEN json_type(e, '$.href') = 'VARCHAR' THEN e ->> '$.href' WHEN json_type(e, '$.url') = 'VARCHAR' THEN e ->> '$.url' END END AS link FROM (
SELECT url, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) WHEN json_type(j) = 'OBJECT' THEN [j] END) AS e FROM (
SELECT url, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN (j ->> '$')::JSON END ELSE j END AS j FROM (SELECT url, CASE WHEN json_valid(links_json) THEN links_json::JSON END AS j FROM pages)))"""


@query(
    "crawl_pages",
    f"WITH RECURSIVE e AS ({STORED}), reach(url, depth) AS (SELECT DISTINCT url, 0 FROM frontier WHERE depth = 0 UNION SELECT e.link, depth + 1 FROM reach JOIN e USING (url) WHERE depth < 2 AND link IS NOT NULL) SELECT url, min(depth) AS depth, url IN (SELECT url FROM pages) AS ok FROM reach GROUP BY 1",
)
def crawl_pages(s, d):
    """The link graph of the stored pages, two hops from the frontier's start urls, without a page cap."""
    pages = table(s, d, "pages")
    corpus = pages.select("url", F.lit(200).alias("status"), F.lit("<p>p</p>").alias("content"), F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("elapsed"))
    seeds = ranked(table(s, d, "frontier").where("depth = 0").select("url").distinct(), ["url"])
    return crawl(s, seeds, corpus, 1 << 40, 2, False, links=records.stored_links(pages)).select("url", "depth", "ok")


@query("sitemap_pages", "SELECT * FROM (VALUES (1, 'https://s.test/1'), (2, 'https://s.test/2'), (3, 'https://s.test/3')) t(place, url)")
def sitemap_pages(s, d):
    corpus = s.createDataFrame(fixtures.SITEMAPS, "url string, status int, content string")
    found = sitemap.sitemap_urls(s, sitemap.discover("https://s.test/x") + ["https://s.test/broken.xml", "https://s.test/missing.xml"], corpus)
    return found.orderBy("path").coalesce(1).select((F.monotonically_increasing_id() + 1).cast("int").alias("place"), "url")


@query("book_listing", "SELECT * FROM (VALUES (0, 'https://pier.test/tides_7/index.html', 'https://pier.test/catalogue/page-2.html'), (1, 'https://pier.test/catalogue/ropes_9/index.html', 'https://pier.test/catalogue/page-2.html')) t(pos, book, next)")
def book_listing(s, d):
    rows = fixtures.books(s).withColumn("next", books.next_url(F.col("html"), F.col("url")))
    return rows.select("next", F.posexplode(books.listing_urls(F.col("html"), F.col("url"))).alias("pos", "book")).select("pos", "book", "next")


@query("book_details", "SELECT * FROM (VALUES ('https://pier.test/catalogue/tides_7/index.html', 'Tides for Cooks', 'c0ffee77', '£8.05', 'Four', 'Seafaring'), ('https://pier.test/catalogue/torn', 'Torn cover', NULL, NULL, NULL, NULL)) t(url, title, upc, price_excl_tax, rating, genre)")
def book_details(s, d):
    b = fixtures.books(s).where("url not like '%page-%'").select(books.book_record(F.col("html"), F.col("url")).alias("b"))
    return b.select("b.url", "b.title", "b.upc", "b.price_excl_tax", "b.rating", "b.genre")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
