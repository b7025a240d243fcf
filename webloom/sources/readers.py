"""Reading back what was written, the SQL view over pages, configuration, and an optional live HTTP source."""

from __future__ import annotations

import json
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from webloom.schema import FETCH_RESULT


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def sql(spark: SparkSession, pages: DataFrame, statement: str, args=None, view: str = "pages") -> DataFrame:
    """A query over the pages view; positional ``?`` or named parameters.

    The view is the statement's own: other queries, however late they run, never see it.
    """
    own = f"{view}_{uuid.uuid4().hex}"
    pages.createOrReplaceTempView(own)
    try:
        first = f"WITH {view} AS (SELECT * FROM {own})"
        given = re.match(r"\s*WITH\s+(?!RECURSIVE\b)", statement, re.I)
        return spark.sql(f"{first}, {statement[given.end() :]}" if given else f"{first} {statement}", args=args)
    finally:
        spark.catalog.dropTempView(own)


def load_config(path: str) -> dict:
    """A JSON or YAML configuration; a missing file raises, an empty one is an empty dict."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml

            return yaml.safe_load(text) or {}
        except ImportError:
            pass
    return json.loads(text)


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _HttpReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.timeout = float(options.get("timeout", 10))
        self.parts = int(options.get("partitions", 4))

    def partitions(self):
        return [_Urls(self.urls[i :: self.parts]) for i in range(min(self.parts, max(1, len(self.urls))))]

    def read(self, partition):
        import time
        import urllib.error
        import urllib.request

        for url in partition.urls:
            began = time.monotonic()
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:  # noqa: S310
                    body = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
                    yield (url, answer.status, body, answer.headers.get("Content-Type"), None, time.monotonic() - began)
            except urllib.error.HTTPError as e:
                yield (url, e.code, None, None, f"HTTP {e.code}", time.monotonic() - began)
            except TimeoutError:
                yield (url, None, None, None, "TimeoutError", time.monotonic() - began)
            except OSError as e:
                yield (url, None, None, None, f"ClientError: {e}", time.monotonic() - began)


class HttpSource(DataSource):
    """``spark.read.format("webloom-http").option("urls", "one per line")``: live fetch results, where there is a network."""

    @classmethod
    def name(cls) -> str:
        return "webloom-http"

    def schema(self) -> str:
        return FETCH_RESULT

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(self.options)
