"""Sinks for page records: JSON lines, CSV, SQLite, and several at once."""

from __future__ import annotations

import logging
import sqlite3
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol, TypeVar

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from webloom.operators.records import csv_projection, upsert

log = logging.getLogger(__name__)
T = TypeVar("T")

# The stored table.
DDL = (
    "CREATE TABLE IF NOT EXISTS pages (id INTEGER PRIMARY KEY AUTOINCREMENT, url TEXT UNIQUE NOT NULL, title TEXT, text TEXT, links_json TEXT, metadata_json TEXT, crawled_at TEXT, status_code INTEGER, content_type TEXT, text_length INTEGER, links_count INTEGER)",
    "CREATE INDEX IF NOT EXISTS idx_crawled_at ON pages (crawled_at)",
)
COLUMNS = ("url", "title", "text", "links_json", "metadata_json", "crawled_at", "status_code", "content_type", "text_length", "links_count")


class Sink(Protocol):
    def write(self, df: DataFrame) -> None: ...

    def stats(self) -> dict: ...


def with_retry(operation: Callable[[], T], label: str, attempts: int = 3, base: float = 0.2, factor: float = 2.0) -> T:
    """Run an operation up to ``attempts`` times (at least once), waiting longer each time, then raise its error."""
    for k in range(max(1, attempts)):
        try:
            return operation()
        except Exception:
            if k + 1 >= max(1, attempts):
                raise
            log.warning("%s failed, try %d", label, k + 1)
            time.sleep(base * factor**k)


def counted(df: DataFrame, save: Callable[[DataFrame], None], label: str) -> int:
    """Save rows, with retries, and tell how many there were; they are counted as they are written."""

    def attempt() -> int:
        seen = Observation()
        save(df.observe(seen, F.count(F.lit(1)).alias("n")))
        return seen.get["n"]

    return with_retry(attempt, label)


class JsonSink:
    """One object per line, appended; nulls are written."""

    def __init__(self, path: str):
        self.path, self.saved = path, 0

    def write(self, df: DataFrame) -> None:
        self.saved += counted(df, lambda rows: rows.write.mode("append").option("ignoreNullFields", "false").json(self.path), "json")

    def stats(self) -> dict:
        return {"format": "json", "file": self.path, "saved": self.saved}


class CsvSink:
    """A header per file and a fixed set of columns; nested values as JSON, nulls as the empty text."""

    def __init__(self, path: str):
        self.path, self.saved = path, 0

    def write(self, df: DataFrame) -> None:
        self.saved += counted(csv_projection(df), lambda rows: rows.write.mode("append").option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(self.path), "csv")

    def stats(self) -> dict:
        return {"format": "csv", "file": self.path, "saved": self.saved}


class TableSink:
    """The distributed upsert: one row per url over what is there and what comes, written beside and swapped in.

    By default a row that is written later replaces an earlier one, as a keyed insert does; of rows written at once the
    last by ``order`` counts. With ``newest`` the last by ``order`` counts always, so a late row of an older crawl
    changes nothing. The old copy is kept until the new one is in place, and is put back by the next write if a crash
    came in between.
    """

    def __init__(self, path: str, order: list[str] | None = None, newest: bool = False):
        self.path, self.order, self.newest, self.saved = path.rstrip("/"), order or ["crawled_at"], newest, 0

    def write(self, df: DataFrame) -> None:
        spark = df.sparkSession
        place = lambda suffix="": spark._jvm.org.apache.hadoop.fs.Path(self.path + suffix)
        fs = place().getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(place()) and fs.exists(place("-old")):
            self._move(fs, place("-old"), place())
        beside = f"-next-{uuid.uuid4().hex}"
        order = [*self.order, "_new"] if self.newest else ["_new", *self.order]

        def save(rows: DataFrame) -> None:
            rows = rows.withColumn("_new", F.lit(1))
            if fs.exists(place()):
                rows = rows.unionByName(spark.read.parquet(self.path).withColumn("_new", F.lit(0)))
            upsert(rows, "url", order).drop("_new").write.mode("overwrite").parquet(self.path + beside)

        self.saved += counted(df, save, "table")
        fs.delete(place("-old"), True)
        if fs.exists(place()):
            self._move(fs, place(), place("-old"))
        self._move(fs, place(beside), place())
        fs.delete(place("-old"), True)

    @staticmethod
    def _move(fs, source, target) -> None:
        if not fs.rename(source, target):
            raise OSError(f"cannot move {source} to {target}")

    def stats(self) -> dict:
        return {"format": "table", "file": self.path, "saved": self.saved}


class SqliteSink:
    """A single SQLite file for results that fit one: rows stream through the driver and replace those of their url."""

    def __init__(self, path: str, batch_size: int = 20):
        self.path, self.batch_size, self.saved = path, batch_size, 0

    def connect(self) -> sqlite3.Connection:
        Path(self.path).parent.mkdir(parents=True, exist_ok=True)
        connection = sqlite3.connect(self.path)
        for statement in DDL:
            connection.execute(statement)
        return connection

    def write(self, df: DataFrame) -> None:
        places = ", ".join("?" * len(COLUMNS))
        connection = self.connect()
        try:
            for batch in _batches(df.select(*COLUMNS).toLocalIterator(), self.batch_size):
                def save(batch=batch) -> None:
                    with connection:  # one transaction a batch
                        connection.executemany(f"INSERT OR REPLACE INTO pages ({', '.join(COLUMNS)}) VALUES ({places})", [tuple(r) for r in batch])

                with_retry(save, "sqlite")
                self.saved += len(batch)
        finally:
            connection.close()

    def query(self, sql: str, params: tuple = ()) -> list[dict]:
        connection = self.connect()
        try:
            cursor = connection.execute(sql, params)
            names = [d[0] for d in cursor.description]
            return [dict(zip(names, row)) for row in cursor.fetchall()]
        finally:
            connection.close()

    def stats(self) -> dict:
        return {"format": "sqlite", "file": self.path, "saved": self.saved}


def _batches(rows: Iterator, size: int) -> Iterator[list]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held


class MultiSink:
    """Several sinks; one that fails doesn't keep the others from writing."""

    def __init__(self, sinks: list[Sink]):
        self.sinks, self.errors = sinks, []

    def write(self, df: DataFrame) -> None:
        kept = df.persist()
        try:
            for sink in self.sinks:
                try:
                    sink.write(kept)
                except Exception as e:  # noqa: BLE001
                    self.errors.append(f"{type(sink).__name__}: {e}")
                    log.error("sink failed: %s", e)
        finally:
            kept.unpersist()

    def stats(self) -> dict:
        return {f"{type(s).__name__}[{i}]": s.stats() for i, s in enumerate(self.sinks)}


def build(output: dict) -> Sink | None:
    """Sink of an output configuration with the keys json, csv, sqlite and table; none, one or several."""
    kinds = {"json": JsonSink, "csv": CsvSink, "sqlite": SqliteSink, "table": TableSink}
    sinks = [make(output[k]) for k, make in kinds.items() if k in output]
    return None if not sinks else sinks[0] if len(sinks) == 1 else MultiSink(sinks)
