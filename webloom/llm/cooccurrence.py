"""Pairs of items that occur together, by stripes and log-likelihood ratio.

Stripes: for each item an associative array of the neighbours it was seen with. Arrays are combined inside a map
task, shuffled by item and merged by key. A pair is kept in the stripe of its *rarer* item, so that a hot item has
hardly a stripe of its own: the stripe of an item seen n times holds at most the items seen at least n times, of which
there are at most total/n. No group is ever collected whole for a hot item and nothing is salted, capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.jsonx import BAD, clean, decode
from webloom.session import checkpoint

#: Pairs a map task holds before it combines them into stripes.
FLUSH = 4_000_000
#: A dictionary of up to this many bytes of strings is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20


def addresses(text: str | None) -> list[str]:
    """The distinct addresses of a links JSON text: strings, or an object's ``href`` or ``url``; nulls are ignored."""
    value = decode(text)
    if value is BAD:
        return []
    found = {}
    for x in value if isinstance(value, list) else [value]:
        if isinstance(x, dict):
            x = x["href"] if isinstance(x.get("href"), str) else x.get("url")
        if isinstance(x, str):
            found[x] = None
    return [*found]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct items of each row, led by a null that stands for the row itself."""
    for batch in batches:
        lists = [[None, *x] if (x := addresses(t)) else [] for t in batch.column(0).to_pylist()]
        try:
            column = pa.array(lists, pa.list_(pa.string()))
        except UnicodeEncodeError:
            column = pa.array([[x if x is None else clean(x) for x in row] for row in lists], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([column], names=["items"])


def item_rows(df: DataFrame, column: str) -> DataFrame:
    """``items ARRAY<STRING>`` of every row with at least one item; the first element is null and counts rows."""
    return df.select(F.col(column).cast("string").alias("j")).where("j is not null").mapInArrow(_items, "items array<string>").where("size(items) > 0")


def _combine(a: np.ndarray, b: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b), sorted, with the sums of n (or their counts)."""
    if not len(a):
        return a, b, np.zeros(0, np.int64)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return a[at], b[at], np.add.reduceat(n[order], at) if n is not None else np.diff(np.append(at, len(a)))


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        a, b, n = _combine(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), None)
        heads = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, int)
        offsets = pa.array(np.append(heads, len(a)).astype(np.int32))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(a[heads]), pa.ListArray.from_arrays(offsets, pa.array(b)), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64)))], names=["a", "neighbours", "counts"])

    for batch in batches:
        column = batch.column(0)
        values, offsets = np.asarray(column.values), np.asarray(column.offsets).astype(np.int64)
        lengths = np.diff(offsets)
        for k in np.unique(lengths[lengths > 1]):  # rows of one length at a time: their pairs are two gathers
            starts = offsets[:-1][lengths == k]
            if k * (k - 1) // 2 > FLUSH:  # a long row on its own, an item at a time
                for start in starts:
                    row = values[start : start + k]
                    for i in range(k - 1):
                        held.append((np.full(k - i - 1, row[i]), row[i + 1 :]))
                        size += k - i - 1
                        if size >= FLUSH:
                            yield flush()
                            size = 0
                continue
            i, j = np.triu_indices(k, 1)
            rows = values[starts[:, None] + np.arange(k)]
            step = max(1, FLUSH // len(i))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                held.append((part[:, i].ravel(), part[:, j].ravel()))
                size += part.shape[0] * len(i)
                if size >= FLUSH:
                    yield flush()
                    size = 0
    if held:
        yield flush()


def _merge(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

        def out(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            keep = n >= least
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b, n)], names=["a", "b", "n_ab"])

        for batch in batches:  # sorted by a: all but the last item's stripe are complete
            stripes = batch.column(1)
            a = np.repeat(np.asarray(batch.column(0)), np.diff(np.asarray(stripes.offsets)))
            b, n = np.asarray(stripes.flatten()), np.asarray(batch.column(2).flatten())
            if rest is not None:
                a, b, n = (np.concatenate(x) for x in zip(rest, (a, b, n)))
            a, b, n = _combine(a, b, n)
            if len(a):
                cut = np.searchsorted(a, a[-1])
                rest = a[cut:], b[cut:], n[cut:]
                yield out(a[:cut], b[:cut], n[:cut])
        if rest is not None:
            yield out(*rest)

    return run


def log_likelihood(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Dunning's G² of the two-by-two table of rows with a, with b, with both and with neither."""

    def xlogx(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    cells = [x.cast("double") for x in (n_ab, n_a - n_ab, n_b - n_ab, n - n_a - n_b + n_ab)]
    sides = [x.cast("double") for x in (n_a, n - n_a, n_b, n - n_b)]
    return 2 * (sum(map(xlogx, cells), F.lit(0.0)) - sum(map(xlogx, sides), F.lit(0.0)) + xlogx(n.cast("double")))


def cooccurrences(df: DataFrame, column: str, min_count: int = 5, min_llr: float = 0.0) -> DataFrame:
    """Pairs item_a < item_b in at least ``min_count`` rows: n_ab, n_a, n_b, n (rows with an item), lift, llr.

    Counts rows, not distinct records: repeated rows count again. Null, empty and invalid texts hold no item; an
    empty table gives an empty result. Only ``column`` is read. Pairs whose G² is below ``min_llr`` are left out.
    """
    counts = item_rows(df, column).select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    words = checkpoint(counts.where((F.col("n") >= min_count) | F.col("item").isNull()).select("item", "n", F.monotonically_increasing_id().alias("id")))
    total, size = words.agg(F.max(F.when(F.col("item").isNull(), F.col("n"))), F.sum(F.octet_length("item") + 24)).first()
    words = words.where("item is not null")
    small = (size or 0) <= BROADCAST_BYTES
    one = F.broadcast(words) if small else words
    rows = item_rows(df, column).select(F.monotonically_increasing_id().alias("row"), F.slice("items", 2, 1 << 30).alias("items"))
    known = rows.select("row", F.explode("items").alias("item")).join(one, "item").groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("ids"))
    stripes = known.select("ids").where("size(ids) > 1").mapInArrow(_stripes, "a bigint, neighbours array<bigint>, counts array<bigint>")
    pairs = stripes.repartition("a").sortWithinPartitions("a").mapInArrow(_merge(min_count), "a bigint, b bigint, n_ab bigint")
    for side in "ab":
        names = words.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("item").alias(f"item_{side}"))
        pairs = pairs.join(F.broadcast(names) if small else names, side)
    n = F.lit(total or 0).cast("bigint")
    flip = F.col("item_a") > F.col("item_b")
    pairs = pairs.select(
        F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b"), "n_ab",
        F.when(flip, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(flip, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"), n.alias("n"),
    )
    pairs = pairs.withColumn("lift", F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).withColumn("llr", log_likelihood(*map(F.col, ("n_ab", "n_a", "n_b", "n"))))
    return pairs.where(F.col("llr") >= min_llr) if min_llr > 0 else pairs
