"""Streaming twins of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from webloom.sources.sinks import Sink


class _Limiter(StatefulProcessor):
    """State per bucket: the last start; requests of a batch are served in order of arrival and sequence."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "start_us bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["arrival_us", "seq"])
        last = self.last.get()[0] if self.last.exists() else None
        starts, waits = [], []
        for arrival in batch["arrival_us"]:
            ready = arrival if last is None else max(arrival, last)
            start = arrival if last is None else max(arrival, last + self.gap)
            starts.append(start)
            waits.append(start - ready)
            last = start
        self.last.update((int(last),))
        yield pd.DataFrame({"bucket": key[0], "arrival_us": batch["arrival_us"], "seq": batch["seq"], "start_us": starts, "wait_us": waits})

    def close(self) -> None:
        pass


def limit(stream: DataFrame, gap: float) -> DataFrame:
    """Polite start times of a stream of (bucket, arrival, seq); across batches a late request is served when it comes."""
    rows = stream.select(F.coalesce("bucket", F.lit("_global")).alias("bucket"), F.round(F.col("arrival") * 1_000_000).cast("bigint").alias("arrival_us"), "seq").where("arrival_us is not null")
    return rows.groupBy("bucket").transformWithStateInPandas(_Limiter(round(gap * 1_000_000)), "bucket string, arrival_us bigint, seq bigint, start_us bigint, wait_us bigint", "append", "None")


def new_urls(stream: DataFrame, column: str = "url") -> DataFrame:
    """Urls never seen before in the stream; the state lives for the whole crawl."""
    return stream.dropDuplicates([column])


def save(stream: DataFrame, sink: Sink, checkpoint: str) -> DataStreamWriter:
    """Write each micro-batch to a sink; a repeated batch after a failure is harmless for upserting sinks."""
    return stream.writeStream.foreachBatch(lambda batch, _: sink.write(batch)).option("checkpointLocation", checkpoint)
