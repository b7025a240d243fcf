"""Small inline inputs for operators whose features no stored table has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGE = (
    '<html><head><title> Lantern repair </title><meta property="og:title" content="Lamps"><meta name="description" content="How a storm lantern is taken apart"><meta name="keywords" content="wick, brass"></head><body><main>'
    "<h1>Taking  <i>apart</i></h1><h2>Tools</h2><h3> </h3><p>Rag<br>oil &amp; pliers</p><script>let x = '</p>';</script><noscript><a href=\"/plain\">text</a></noscript>"
    '<a href="/parts">p</a> <a href="https://mill.test/wick?w=2&amp;c=7">w</a> <a href="/parts">p2</a> <a href="mailto:x@y.test">write</a> <a href="#end">e</a> <a href="../index">i</a>'
    '<img src="/glass.png" alt=" Cracked glass "><img src=""><img src="https://pics.test/burner.png">'
    "<table><tr><th>part<th>size</tr><tr><td>cap<td> 12 </tr><tr><td><table><tr><td>inner</td></tr></table></td></tr></table>"
    "<ul><li>clean</li><li>dry<ol><li>slowly</li></ol></li><li> </li></ul></main></body></html>"
)
PAGES = [("https://loom.test/shelf/one", PAGE), ("https://loom.test/blank", ""), ("https://loom.test/none", None), ("https://loom.test/odd", '<p>y<a href="http://[odd">q</a><a href="/fine">fine</a>')]

SITE = {
    "https://quay.test/": ["https://quay.test/boats", "https://abroad.test/x", "https://quay.test/sunk"], "https://isle.test/": ["https://isle.test/goats", "https://quay.test/boats"],
    "https://quay.test/boats": ["https://quay.test/oars", "https://quay.test/"], "https://isle.test/goats": ["https://isle.test/fenced/kid"], "https://quay.test/oars": ["https://quay.test/ash"],
}

SITEMAPS = [
    ("https://s.test/sitemap.xml", 200, '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> https://s.test/a.xml </loc></sitemap><sitemap><loc>https://s.test/b.xml</loc></sitemap></sitemapindex>'),
    ("https://s.test/a.xml", 200, "<urlset><url><loc>https://s.test/1</loc></url><url><loc>https://s.test/2</loc></url></urlset>"),
    ("https://s.test/b.xml", 200, "<urlset><url><loc>https://s.test/2</loc></url><url><loc>https://s.test/3</loc></url></urlset>"),
    ("https://s.test/broken.xml", 200, "<urlset><url>"), ("https://s.test/missing.xml", 404, None),
]

LISTING = '<section><article class="product_pod"><h3><a href="../../tides_7/index.html">T</a></h3></article><article class="wide product_pod"><a href="ropes_9/index.html"><img></a><a href="more">m</a></article><li class="next"><a href="page-2.html">on</a></li></section>'
BOOK = (
    '<ul class="breadcrumb"><li><a href="/">Start</a></li><li><a href="/all">All</a></li><li><a href="/sea">Seafaring</a></li><li>Tides</li></ul><h1>Tides for Cooks</h1><p class="star-rating Four"></p>'
    '<table class="table table-striped"><tr><th>UPC</th><td>c0ffee77</td></tr><tr><th>Product Type</th><td>Almanac</td></tr><tr><th>Price (excl. tax)</th><td>£8.05</td></tr><tr><th>Availability</th><td>In stock (3 available)</td></tr><tr><th>Number of reviews</th><td>5</td></tr></table>'
)


def pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGES, "url string, html string")


def site(spark: SparkSession) -> DataFrame:
    """Fetch results of a small site."""
    body = lambda url, links: f"<html><head><title>{url}</title></head><body>{''.join(f'<a href={chr(34)}{u}{chr(34)}>l</a>' for u in links)}</body></html>"
    return spark.createDataFrame([(u, 200, body(u, v), "text/html", None, 0.1) for u, v in SITE.items()] + [("https://isle.test/fenced/kid", 200, "<p>x</p>", None, None, 0.1)], "url string, status int, content string, content_type string, error string, elapsed double")


def site_robots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("https://isle.test", 200, "User-agent: *\nDisallow: /fenced")], "origin string, status int, text string")


def books(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("https://pier.test/catalogue/page-1.html", LISTING), ("https://pier.test/catalogue/tides_7/index.html", BOOK), ("https://pier.test/catalogue/torn", "<h1>Torn cover</h1>")], "url string, html string")
