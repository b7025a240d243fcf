"""Sitemaps of a corpus: url sets, indexes, discovery."""

from __future__ import annotations

from collections.abc import Iterable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from webloom.operators.fetch import latest
from webloom.session import checkpoint

PARSED = "kind string, locs array<string>"


def parse_sitemap(xml: str | None) -> tuple[str | None, list[str]]:
    """(root's local name, trimmed locations); nothing for malformed XML."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return None, []
    local = lambda tag: tag.rpartition("}")[2]
    return local(root.tag), [t for e in root.iter() if local(e.tag) == "loc" and (t := (e.text or "").strip())]


def sitemap(xml: Column) -> Column:
    @F.pandas_udf(StructType.fromDDL(PARSED))
    def run(xml: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_sitemap(x) for x in xml], columns=["kind", "locs"])

    return run(xml)


def sitemap_urls(spark: SparkSession, starts: Iterable[str], corpus: DataFrame) -> DataFrame:
    """(url, path): page urls of sitemaps in document order, indexes followed depth-first, each sitemap read once.

    ``corpus`` has url, status, content; other statuses than 200 and malformed files give nothing; of several contents
    of a url the greatest counts. ``path`` is the
    array of positions that orders the urls. The loop is over index levels.
    """
    level = spark.createDataFrame([(u, [i]) for i, u in enumerate(starts)], "url string, path array<int>")
    files = corpus.where("status = 200").select("url", "content")
    seen = level.select("url")
    out = spark.createDataFrame([], "url string, path array<int>")
    while True:
        own = latest(files.join(level.select("url"), "url", "left_semi"), "url", ("content",))
        read = checkpoint(level.join(own, "url").select("url", "path", sitemap(F.col("content")).alias("s")).select("path", "s.kind", F.posexplode("s.locs").alias("pos", "loc")))
        pages = read.where("kind = 'urlset'").select(F.col("loc").alias("url"), F.concat("path", F.array("pos")).alias("path"))
        out = out.union(pages)
        nested = read.where("kind = 'sitemapindex'").groupBy(F.col("loc").alias("url")).agg(F.min(F.concat("path", F.array("pos"))).alias("path"))
        level = checkpoint(nested.join(seen, "url", "left_anti"))
        if level.isEmpty():
            return out.groupBy("url").agg(F.min("path").alias("path"))
        seen = checkpoint(seen.union(level.select("url")))


def discover(base: str) -> list[str]:
    """Where a site's sitemap is looked for."""
    from urllib.parse import urlsplit

    parts = urlsplit(base)
    return [f"{parts.scheme}://{parts.netloc}{path}" for path in ("/sitemap.xml", "/sitemap_index.xml")]
