import hashlib
import json
import urllib.robotparser
from urllib.parse import urljoin, urlparse

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions import columns as C
from webloom.operators import books, fetch, frontier, html, limiter, records, retry, robots, stats
from webloom.plans import fixtures
from webloom.plans.crawl import crawl
from webloom.sources import readers, sinks, sitemap

URLS = ["https://a.test/x", "http://A.test:80/p?q#f", "ftp://b.test/", "/x", "https:///x", "mailto:a@b", "", "https://u:p@c.test", "https://d.test/a b", "HTTPS://e.test"]


def one(spark, *values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_urls(spark):
    assert one(spark, *URLS, None, column=C.netloc) == [urlparse(u).netloc for u in URLS] + [None]
    assert one(spark, *URLS, None, column=C.is_valid_url) == [html.valid_url(u) for u in URLS] + [False]
    assert one(spark, None, "example.com/x", "https://h.test/p", "", column=C.bucket_key) == ["_global", "example.com", "h.test", "_global"]
    assert one(spark, "javascript:x", "JAVASCRIPT:x", "#a", "", "x", column=C.is_skipped_href) == [True, False, True, True, False]


def test_scalars(spark):
    assert one(spark, "  a  b\n", None, column=C.collapse) == ["a b", None]
    assert one(spark, "<a href=\"x\">'&amp;", column=C.html_escape) == ["&lt;a href=&quot;x&quot;&gt;&#x27;&amp;amp;"]
    assert one(spark, "HTTP 404", "HTTP x", None, column=C.http_status) == [404, None, None]
    assert one(spark, "HTTP 404: x", None, "", column=C.error_label) == ["HTTP 404", "Unknown", "Unknown"]
    assert one(spark, "text/html; charset=x", None, "", column=C.content_type) == ["text/html", "text/html", "text/html"]
    assert one(spark, "abcd", "abc", column=lambda v: C.shorten(v, 3)) == ["abc...", "abc"]


def test_page_quirks():
    base = "https://e.test/d/p"
    assert html.parse_html('<a href="http://[bad">x</a><a href="/ok">y</a>', base)["links"] == []
    assert html.parse_html("<title> </title>", base)["title"] == "" and html.parse_html('<meta property="og:title" content="OG">', base)["title"] == "OG"
    assert html.parse_html("<p>x<noscript><a href='/n'>n</a></noscript>", base)["links"] == []
    assert html.links(html.parse_tree("<noscript><a href='/n'>n</a></noscript>"), base) == ["https://e.test/n"]
    assert html.parse_html("<h1>a  <b>b</b></h1>", base)["headings"]["h1"] == ["a   b"]
    assert html.parse_html("<ul><li>a<ul><li>b</ul></ul>", base)["lists"] == [{"tag": "ul", "items": ["a b"]}, {"tag": "ul", "items": ["b"]}]
    assert html.parse_html("<table><tr><th>h<td>x<tr><td>1<th>z</table>", base)["tables"] == [{"headers": ["h"], "rows": [["1"]]}]
    assert html.parse_html(None, base)["error"] and html.parse_html("", base)["links"] == []
    assert html.parse_html("<p>unclosed <b>bold", base)["text"] == "unclosed bold"
    assert html.page_text(html.parse_tree("<main>m</main><p>p"), "main") == "m" and html.page_text(html.parse_tree("<main>m</main><p>p"), "article") == "m p"
    assert [html.urljoin(b, r) for b, r in [("http://e.com/a/b?x=1#f", "/c,"), ("http://e.com/a/", "?p=2"), ("http://e.com/a", "//o.com/x")]] == ["http://e.com/c,", "http://e.com/a/?p=2", "http://o.com/x"]


def test_long_page():
    deep = "<div>" * 5000 + "x"
    assert html.parse_html(deep, "https://e.test/")["text"] == "x"
    assert html.parse_html("<p>" + "word " * 200_000, "https://e.test/")["text_length"] == 999_999


def test_resolve(spark):
    refs = ["x", "/y", None, "http://[bad"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(refs)], "i int, r string")
    got = [r[0] for r in df.orderBy("i").select(html.resolve(F.lit("https://e.test/a/b"), F.col("r"))).collect()]
    assert got == [urljoin("https://e.test/a/b", "x"), "https://e.test/y", None, None]


FETCHED = "url string, status int, content string, content_type string, error string, elapsed double, page string"


def test_fetch(spark):
    rows = [("u1", 200, "<title>T</title>", "text/html; x", None, 0.5, "clash"), ("u1", 404, None, None, "HTTP 404", 0.1, None), ("u2", None, None, None, "HTTP 503: x", None, None), ("u3", 200, "", None, None, 0.1, None), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, FETCHED)
    got = {(r["url"], r["status"]): r["success"] for r in fetch.fetch_results(df).collect()}
    assert got == {("u1", 200): True, ("u1", 404): False, ("u2", 503): False, ("u3", 200): True, (None, None): False}
    bodies = dict(fetch.fetch_bodies(spark.createDataFrame([("u1",), ("u1",), ("zz",)], "url string"), df).collect())
    assert bodies == {"u1": "<title>T</title>", "zz": ""}
    pages = {(r["url"], r["status_code"]): r for r in fetch.fetch_and_parse(df, F.lit("now")).collect()}
    assert pages["u1", 200]["title"] == "T" and pages["u1", 200]["error"] is None and pages["u3", 200]["error"] == "Empty HTML string received" and pages["u2", 503]["fetch_elapsed"] is None
    assert fetch.fetch_and_parse(df.limit(0)).count() == 0


def test_retry(spark):
    kinds = [("http", 404, "PermanentError"), ("http", 503, "TransientError"), ("http", 429, "TransientError"), ("timeout", None, "TransientError"), ("connector", None, "NetworkError"), (None, 418, "PermanentError"), (None, None, "TransientError"), ("http", 599, "TransientError"), ("odd", None, "TransientError")]
    df = spark.createDataFrame([(i, k, s) for i, (k, s, _) in enumerate(kinds)], "i int, kind string, status int")
    assert [r[0] for r in df.orderBy("i").select(retry.classify(F.col("kind"), F.col("status"))).collect()] == [x for *_, x in kinds]
    rows = [("a", 1, "http", 503, "x"), ("a", 1, "http", 503, "x"), ("a", 2, "ok", None, None), ("a", 3, "http", 503, "never"), ("b", 1, "http", 404, "x"), ("b", 2, "http", 503, "never"), *(("c", k, "http", 429, "m") for k in range(1, 7))]
    log = retry.simulate(spark.createDataFrame(rows, "url string, attempt int, kind string, status int, message string"), max_retries=2)
    assert sorted(map(tuple, log.select("url", "attempt", "error_type", "next_retry_in").collect())) == [("a", 1, "TransientError", 2.0), ("b", 1, "PermanentError", None), ("c", 1, "TransientError", 30.0), ("c", 2, "TransientError", 30.0), ("c", 3, "TransientError", None)]


@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 40_000), st.integers(0, 3)), max_size=25), st.sampled_from([0.3, 1.0, 7.0]), st.sampled_from([0.0, 0.5]), st.booleans())
@example([("a", 0, 0), ("a", 0, 0)], 0.3, 0.0, True)
@example([("a", 0, 0), ("a", 0, 0), (None, 0, 0), (None, 0, 1)], 0.3, 0.5, False)
@settings(max_examples=12, deadline=None)
def test_limiter(spark, rows, gap, jitter, per_domain):
    df = spark.createDataFrame([(b, t / 10, s) for b, t, s in rows], "bucket string, arrival double, seq int")
    got = sorted(((r["bucket_key"], r["arrival_us"], r["seq"], r["start_us"], r["wait_us"]) for r in limiter.schedule(df, gap, slice_seconds=600, jitter=jitter, seed=3, per_domain=per_domain).collect()))
    want, last = [], {}
    for b, t, s in sorted((((b or "_global") if per_domain else "_global", t, s) for b, t, s in rows), key=lambda x: (x[0], x[1], x[2])):
        a, g = t * 100_000, round(gap * 1e6)
        late = (int(hashlib.md5(f"3:{b}:{a}:{s}".encode()).hexdigest()[:8], 16) * round(jitter * 1e6)) >> 32
        start = (a if b not in last else max(a, last[b] + g)) + late
        want.append((b, a, s, start, start - (a if b not in last else max(a, last[b]))))
        last[b] = start
    assert got == sorted(want)


def test_limiter_knobs(spark):
    assert limiter.required_gap(2.0) == 0.5 and limiter.required_gap(100, 0.3) == 0.3 and limiter.required_gap(0) == 1000
    df = spark.createDataFrame([("a", 0.0, 0), ("b", 0.0, 1), ("b", 0.0, 2)], "bucket string, arrival double, seq int")
    delays = spark.createDataFrame([("b", 5)], "bucket_key string, crawl_delay int")
    got = sorted((r["seq"], r["start_us"], r["fetch_us"]) for r in limiter.crawl_delayed(limiter.schedule(df, 1.0), delays).collect())
    assert got == [(0, 0, 0), (1, 0, 5_000_000), (2, 1_000_000, 6_000_000)]
    assert limiter.schedule(df.limit(0), 1.0, jitter=0.1).count() == 0


ROBOTS = ["User-agent: *\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 5", "User-agent: deskbot\nDisallow: /x\n\nUser-agent: *\nDisallow: /", "user-agent:*\nDisallow: /*.pdf$\nCrawl-delay: 1.5", "Disallow: /", "User-agent: a\nUser-agent: deskbot\r\nDisallow:\r\nDisallow: /q?x=1 # c", "User-agent: *\nDisallow: /caf%C3%A9\nAllow: /", "", "User-agent: *"]


def test_robots(spark):
    table = spark.createDataFrame([(f"https://h{i}.test", 200, t) for i, t in enumerate(ROBOTS)] + [("https://h0.test", 200, ""), ("https://n.test", 404, "User-agent: *\nDisallow: /"), (None, 200, None)], "origin string, status int, text string")
    paths = ["/", "/a", "/a/b", "/x", "/q?x=1", "/q.pdf", "/café", "/b?c=d&e=f"]
    urls = spark.createDataFrame([(f"https://h{i}.test{p}",) for i in range(len(ROBOTS)) for p in paths] + [("https://n.test/x",), ("https://other.test/x",), (None,)], "url string")
    got = {r["url"]: (r["allowed"], r["crawl_delay"]) for r in robots.decisions(urls, table, "DeskBot/1.0").collect()}
    for i, text in enumerate(ROBOTS):
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(text.splitlines())
        parser.modified()
        for p in paths:
            url = f"https://h{i}.test{p}"
            assert got[url] == (parser.can_fetch("DeskBot/1.0", url), parser.crawl_delay("DeskBot/1.0")), (text, p)
    assert got["https://n.test/x"] == got["https://other.test/x"] == got[None] == (True, None)


def test_frontier(spark):
    rows = [("u", 1, 0, 1.0, "pending", None), ("u", 0, 3, 2.0, "failed", None), ("v", 0, 1, 3.0, "pending", None), ("w", 0, 1, 2.5, "pending", None), ("v", 0, 1, 3.0, "pending", None), ("x", 0, 0, None, "visited", None)]
    df = spark.createDataFrame(rows, "url string, priority int, depth int, added_at double, state string, error string")
    assert [r["url"] for r in frontier.next_urls(df, 9).collect()] == ["w", "v", "u"]
    latest = frontier.states(df)
    assert frontier.failed(latest).collect() == [("u", "unknown")]
    assert frontier.frontier_stats(latest).first() == (2, 1, 1, 4)
    assert frontier.next_urls(df.limit(0), 3).count() == 0


def test_crawl_rules(spark):
    site = fixtures.site(spark)
    got = {r["url"]: r["depth"] for r in crawl(spark, ["https://quay.test/"], site, 10, 3, exclude=["sunk"]).collect()}
    assert got == {"https://quay.test/": 0, "https://quay.test/boats": 1, "https://quay.test/oars": 2, "https://quay.test/ash": 3}
    everywhere = {r["url"] for r in crawl(spark, ["https://quay.test/"], site, 10, 1, same_domain=False, include=["abroad", "/boats$"]).collect()}
    assert everywhere == {"https://quay.test/", "https://abroad.test/x", "https://quay.test/boats"}


def test_stats(spark):
    rows = spark.createDataFrame([(1.0, True), (3.0, True), (9.0, False)], "elapsed double, success boolean")
    assert stats.summary(rows, F.lit(2.0)).first() == (3, 2, 1, 2.0, 1.5, 2.0)
    counts = stats.domain_counts(spark.createDataFrame([("https://a.test/",), ("https://a.test/x",), ("/y",), (None,)], "url string"))
    assert stats.counts_as_map(counts, "domain", "pages").first()[0] == {"a.test": 2}
    none = spark.range(1).select(*(c.alias(n) for n, c in stats.progress(F.lit(0), F.lit(0), F.lit(5), 10, F.lit(1.0)).items())).first()
    assert none["eta_seconds"] is None and none["percent"] == 0.0


PAGE = "url string, title string, text string, links array<string>, metadata struct<title:string,description:string>, text_length int, links_count int, crawled_at string, status_code int, content_type string"


def page(url, title, at="2025-01-01"):
    return (url, title, 'a "quoted", text\nwith a line', ["x", "é"], ("t", None), 0, 2, at, None, None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([page("u1", "V1"), page("u2", None)], PAGE)
    flat = records.flat_record(df, F.lit("now"))
    sqlite = sinks.SqliteSink(str(tmp_path / "s.db"))
    many = sinks.build({"json": str(tmp_path / "j"), "csv": str(tmp_path / "c"), "table": str(tmp_path / "t")})
    many.write(df)
    many.write(df)
    assert not many.errors
    assert spark.read.json(str(tmp_path / "j")).count() == 4 and any('"title":null' in line for p in (tmp_path / "j").glob("*.json") for line in p.read_text().splitlines())
    back = readers.read_csv(spark, str(tmp_path / "c")).where("url = 'u1'").first()
    assert back["text"] == page("u1", "")[2] and json.loads(back["links"]) == ["x", "é"]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sqlite.write(flat)
    sqlite.write(records.flat_record(spark.createDataFrame([page("u1", "V2", "2025-01-02")], PAGE), F.lit("now")))
    assert sqlite.query("SELECT title, status_code, text_length FROM pages WHERE url = ?", ("u1",)) == [{"title": "V2", "status_code": 200, "text_length": 28}]
    assert sqlite.query("SELECT count(*) AS n FROM pages") == [{"n": 2}]


def test_multi_isolates(spark, tmp_path):
    class Broken:
        def write(self, df):
            raise OSError("disk")

        def stats(self):
            return {}

    both = sinks.MultiSink([Broken(), sinks.JsonSink(str(tmp_path / "j"))])
    both.write(spark.range(3).selectExpr("cast(id as string) url"))
    assert both.errors == ["Broken: disk"] and spark.read.json(str(tmp_path / "j")).count() == 3 and len(both.stats()) == 2


def test_retrying_writes():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 2:
            raise OSError

    sinks.with_retry(flaky, "x", base=0.0)
    assert len(calls) == 2
    with pytest.raises(ZeroDivisionError):
        sinks.with_retry(lambda: 1 / 0, "x", attempts=0, base=0.0)


def test_upsert(spark):
    df = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("u", 2, "c"), (None, 1, "n"), ("v", None, "z")], "url string, at int, v string")
    assert sorted(records.upsert(df, "url", ["at"]).collect(), key=str) == sorted([("u", 2, "c"), (None, 1, "n"), ("v", None, "z")], key=str)


def test_sql(spark):
    pages = spark.createDataFrame([(1, "u"), (2, "v")], "id int, url string")
    assert readers.sql(spark, pages, "SELECT url FROM pages WHERE id = ?", [2]).collect() == [("v",)]


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"max_pages": 5}')
    (tmp_path / "c.yaml").write_text("max_depth: 2\n")
    assert readers.load_config(str(tmp_path / "c.json")) == {"max_pages": 5} and readers.load_config(str(tmp_path / "c.yaml")) == {"max_depth": 2}
    with pytest.raises(FileNotFoundError):
        readers.load_config(str(tmp_path / "none.json"))


def test_books(spark):
    corpus = spark.createDataFrame([("https://b.test/catalogue/page-1.html", fixtures.LISTING), ("https://b.test/catalogue/page-2.html", fixtures.LISTING.replace("page-2", "page-1"))], "url string, content string")
    assert books.follow_listing(corpus, "https://b.test/catalogue/page-1.html", 10) == ["https://b.test/tides_7/index.html", "https://b.test/catalogue/ropes_9/index.html"]
    assert books.follow_listing(corpus, "https://b.test/catalogue/page-1.html", 1) == ["https://b.test/tides_7/index.html"]
    assert books.detail("<p>nothing", "u")["title"] == "Unknown" and books.next_page("<li class='next'>", "u") is None
    assert one(spark, "Â£8.05", "free", None, column=lambda v: books.price(v).cast("string")) == ["8.05", None, None]


def test_sitemap():
    assert sitemap.parse_sitemap("<urlset><url>") == (None, []) and sitemap.parse_sitemap(None) == (None, [])
    assert sitemap.discover("https://s.test/a/b") == ["https://s.test/sitemap.xml", "https://s.test/sitemap_index.xml"]


def test_report(spark, tmp_path):
    from webloom.operators.report import html_report, stats_json

    pages = spark.createDataFrame([(1, 'https://e.test/"><script>', "<b>T</b>", 3, 12345), (2, "u", None, None, None)], "id int, url string, title string, links_count int, text_length int")
    html_report(str(tmp_path / "r.html"), {"total": 2}, {"Status": {200: 1}}, pages, 1)
    text = (tmp_path / "r.html").read_text()
    assert "<script>" not in text and "<b>T" not in text and "12,345" in text and text.count("<tr>") == 6
    stats_json(str(tmp_path / "s.json"), {"é": 1, 200: {"a": None}})
    assert json.loads((tmp_path / "s.json").read_text()) == {"é": 1, "200": {"a": None}}


def test_crawl_with_sitemaps(spark):
    from webloom.plans.crawl import crawl_with_sitemaps

    corpus = fixtures.site(spark).unionByName(spark.createDataFrame([("https://quay.test/sitemap.xml", 200, "<urlset><url><loc>https://new.test/p</loc></url></urlset>", None, None, 0.1), ("https://new.test/p", 200, "<title>P</title>", None, None, 0.1)], fixtures.site(spark).schema))
    got = {r["url"]: (r["depth"], r["ok"]) for r in crawl_with_sitemaps(spark, ["https://quay.test/"], corpus, max_pages=3, max_depth=1).collect()}
    assert got == {"https://quay.test/": (0, True), "https://new.test/p": (0, True), "https://quay.test/boats": (1, True)}


def test_scrape(spark):
    corpus = spark.createDataFrame([("https://b.test/catalogue/page-1.html", fixtures.LISTING), ("https://b.test/tides_7/index.html", fixtures.BOOK)], "url string, content string")
    found, failed = books.scrape(corpus, "https://b.test/catalogue/page-1.html", 10)
    assert [r["upc"] for r in found.collect()] == ["c0ffee77"] and [r["url"] for r in failed.collect()] == ["https://b.test/catalogue/ropes_9/index.html"]


def test_cli(spark, tmp_path, capsys):
    from webloom.__main__ import main

    fixtures.site(spark).write.parquet(str(tmp_path / "corpus"))
    main(["crawl", "https://quay.test/", "--corpus", str(tmp_path / "corpus"), "--max-depth", "1", "--output", str(tmp_path / "out")])
    main(["query", str(tmp_path / "out"), "SELECT count(*) AS n FROM pages"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"n": 3}
    (tmp_path / "c.json").write_text('{"odd": 1}')
    with pytest.raises(SystemExit):
        main(["crawl", "--config", str(tmp_path / "c.json")])
