"""Token ids of whole texts by a public byte-level tokenizer read from a local rank file."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenizing pattern that belongs to the 50k byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANKS = os.environ.get("WEBLOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Texts over this many characters are cut at boundaries that no token crosses.
LONG = 20_000
#: A token never spans: the start of white space, the end of a run of letters, the end of a run of digits.
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])")


@lru_cache(maxsize=4)
def encoding(ranks: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file; one per worker process. The file must lie at this path on every executor."""
    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(ranks), pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = LONG) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut only where every token ends."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None or cut.start() >= len(text):
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, ranks: str = RANKS) -> list[int]:
    """Ids of one text, special strings taken as ordinary text; an empty list for null and empty."""
    if not text:
        return []
    own = encoding(ranks)
    if len(text) <= LONG:
        return own.encode_ordinary(text)
    return [i for part in pieces(text) for i in own.encode_ordinary(part)]


def decode(ids: list[int], ranks: str = RANKS) -> str:
    """The text of ids: bytes are joined first, so a character that spans tokens is whole again."""
    return encoding(ranks).decode_bytes(ids).decode("utf-8")


def token_ids(df: DataFrame, key: str, column: str, ranks: str = RANKS) -> DataFrame:
    """Key and ``ids ARRAY<INT>`` of every row, the text taken exactly as stored.

    Null and empty texts give an empty list. Each text is encoded whole; long ones are cut at safe boundaries only.
    Rows are independent: no shuffle, repeated rows stay, other columns are not read. A map over batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = [np.array(encode(t, ranks), np.int32) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["key", "ids"])

    plain = df.select(F.col(key).alias("key"), F.col(column).cast("string").alias("text"))
    return plain.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)
