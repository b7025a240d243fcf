"""Stored page records: the flat form, exports and the upsert."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from webloom.functions.columns import falsy, falsy_number, html_escape
from webloom.functions.jsonx import BAD, clean, decode


def flat_record(pages: DataFrame, now: Column) -> DataFrame:
    """Nested page records as the ten stored columns; missing values get their falsy defaults."""
    text = falsy(F.col("text"), F.lit(""))
    to_json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    return pages.select(
        "url", falsy(F.col("title"), F.lit("")).alias("title"), text.alias("text"), F.coalesce(to_json("links"), F.lit("[]")).alias("links_json"), F.coalesce(to_json("metadata"), F.lit("{}")).alias("metadata_json"),
        falsy(F.col("crawled_at"), now).alias("crawled_at"), falsy_number(F.col("status_code"), F.lit(200)).alias("status_code"), falsy(F.col("content_type"), F.lit("text/html")).alias("content_type"),
        falsy_number(F.col("text_length"), F.char_length(text)).alias("text_length"), falsy_number(F.col("links_count"), F.coalesce(F.size("links"), F.lit(0))).alias("links_count"),
    )


def stored_links(pages: DataFrame, key: str = "url", column: str = "links_json") -> DataFrame:
    """(key, pos, link) of the addresses in a stored links JSON: strings, or an object's ``href`` or ``url``.

    Positions count all elements from 0. A text encoded twice counts as its content; null, empty and invalid texts and
    other elements give nothing; repeated rows repeat their links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, places, found = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                value = decode(text)
                for k, x in enumerate(value if isinstance(value, list) else [] if value is BAD else [value]):
                    if isinstance(x, dict):
                        x = x["href"] if isinstance(x.get("href"), str) else x.get("url")
                    if isinstance(x, str):
                        index.append(i)
                        places.append(k)
                        found.append(clean(x))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), pa.array(places, pa.int32()), pa.array(found, pa.string())], names=["key", "pos", "link"])

    plain = pages.select(F.col(key).alias("key"), F.col(column).cast("string").alias("j")).where("j is not null")
    return plain.mapInArrow(run, f"key {pages.schema[key].dataType.simpleString()}, pos int, link string").withColumnRenamed("key", key)


def upsert(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row per key by ``order`` (ties: the greatest row). A ranking aggregate combines before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    last = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order]))
    return rows.groupBy(key).agg(last.alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def csv_projection(df: DataFrame) -> DataFrame:
    """All columns as text: nested ones as JSON, nulls as the empty string."""
    out = []
    for f in df.schema.fields:
        column = F.to_json(f.name, {"ignoreNullFields": "false"}) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f.name).cast("string")
        out.append(F.coalesce(column, F.lit("")).alias(f.name))
    return df.select(*out)


def report_rows(pages: DataFrame, rows: int = 500) -> DataFrame:
    """The rows of the page table in a report: the first ``rows`` by id, values cut to size and escaped."""
    first = pages.orderBy("id").limit(rows)
    return first.select(
        "id", html_escape(F.col("url")).alias("href"), html_escape(F.substring("url", 1, 70)).alias("shown_url"), html_escape(F.substring(falsy(F.col("title"), F.lit("—")), 1, 60)).alias("title"),
        F.coalesce("links_count", F.lit(0)).cast("string").alias("links"), F.format_number(F.coalesce("text_length", F.lit(0)), 0).alias("text_length"),
    )
