"""Test items that leaked into a corpus: CGK embedding, bit sampling, exact edit verification.

Every run of ``words`` consecutive words of a test item is a window, and so is every such run of a document. The CGK
embedding walks through a window with a pointer that a random bit of (step, word) moves on or not; edit distance in
words becomes Hamming distance between walks. Places of the walk are sampled as the bits of a locality-sensitive
hash, again and again with other walks, until pairs within ``max_edits`` collide with the wanted recall, which is
measured on random edits before the search. Equal windows collide always. Candidates are verified by exact edit
distance.

Documents are read once, however many items there are: a filter of fixed size of the items' keys is sent to all
workers, the few windows of documents that pass it are joined to the items' windows by key, and no item comes to the
driver.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import checkpoint

WORDS = regex.compile(r"[\p{L}\p{N}\p{M}]+")
INVISIBLE = regex.compile(r"[\p{Cf}\p{Variation_Selector}\u034f\u115f\u1160\u17b4\u17b5]+")
#: Bits of the filter of item keys, in chunks; each key sets two.
FILTER_BITS, CHUNK_BITS = 1 << 26, 1 << 16
#: Up to so many windows of items are broadcast to the documents' windows, counted first; more are joined by shuffle.
BROADCAST_WINDOWS = 100_000
#: Walks at most, and places of each at least; pairs and seed of the calibration.
MOST_WALKS, LEAST_PLACES, PAIRS = 24, 4, 400
#: Places sampled when windows must be equal: enough to tell most apart, the rest is left to the verification.
EQUAL_PLACES = 16
#: Windows of documents walked at once.
STEP = 400_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits; case, Unicode form and invisible characters do not matter."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).casefold())
        return WORDS.findall(text)
    return WORDS.findall(text.lower())


@lru_cache(maxsize=1 << 18)
def _symbol(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def symbols(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_symbol, words), np.uint64, len(words))


def edited(window: np.ndarray, edits: int, random: np.random.Generator) -> np.ndarray:
    """A window of the same length within ``edits`` edits: substitutions, and insertions with deletions."""
    out = list(window)
    left = edits
    while left:
        fresh = np.uint64(random.integers(1, 1 << 63))
        if left >= 2 and random.random() < 0.5:
            out.insert(random.integers(0, len(out) + 1), fresh)
            del out[random.integers(0, len(out))]
            left -= 2
        else:
            out[random.integers(0, len(out))] = fresh
            left -= 1
    return np.array(out, np.uint64)


@lru_cache
def plan(words: int, max_edits: int, recall: float) -> tuple[int, int]:
    """(walks, sampled places) by which random windows within ``max_edits`` collide with the recall, measured here.

    Of the numbers of places that reach it within ``MOST_WALKS`` walks the most selective is taken; if none does, the
    fewest places with all walks.
    """
    if max_edits == 0:
        return 1, min(3 * words, EQUAL_PLACES)
    random = np.random.default_rng(104_729)
    windows = random.integers(1, 1 << 63, (PAIRS, words), dtype=np.uint64)
    others = np.stack([edited(w, max_edits, random) for w in windows])
    both = np.concatenate([windows.ravel(), others.ravel()])
    starts = np.arange(2 * PAIRS) * words
    for places in range(3 * words, LEAST_PLACES - 1, -1):
        met = np.zeros(PAIRS, bool)
        for walk in range(MOST_WALKS):
            keys = window_keys(both, starts, words, walk, places)
            met |= keys[:PAIRS] == keys[PAIRS:]
            if met.mean() >= recall + (1 - recall) / 2:
                return walk + 1, places
            if walk == 7 and met.mean() < recall / 4:
                break  # hopeless with so many places
    return MOST_WALKS, LEAST_PLACES


def window_keys(sequence: np.ndarray, starts: np.ndarray, words: int, walk: int, places: int) -> np.ndarray:
    """The sampled hash of the CGK walk of each window ``sequence[start : start + words]``."""
    random = np.random.default_rng(7919 + walk)
    length = 3 * words
    factors = random.integers(1, 1 << 63, length, dtype=np.uint64) | np.uint64(1)
    sampled = np.zeros(length, bool)
    sampled[random.permutation(length)[:places]] = True
    last = int(np.flatnonzero(sampled)[-1]) + 1
    padded = np.append(sequence, np.uint64(0))
    pointer = starts.astype(np.int64)
    stop = pointer + words
    key = np.full(len(starts), np.uint64(walk + 1))
    for step in range(last):
        inside = pointer < stop
        symbol = np.where(inside, padded[np.minimum(pointer, len(sequence))], np.uint64(0))
        if sampled[step]:
            key = (key ^ symbol) * MIX
            key ^= key >> np.uint64(29)
        pointer += (((symbol * factors[step]) >> np.uint64(63)) & inside).astype(np.int64)
    return key


def edit_distance(a: list[str], b: list[str], most: int) -> int:
    """Levenshtein distance in words; anything above ``most`` may come out as ``most + 1``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most or most == 0:
        return most + 1
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def _windows(tokens: list[list[str]], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence of all symbols, owner, place, start in the sequence) of the windows of some texts."""
    counts = np.array([max(0, len(t) - words + 1) for t in tokens], np.int64)
    bounds = np.cumsum([0] + [len(t) for t in tokens])
    owner = np.repeat(np.arange(len(tokens)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return symbols([w for t in tokens for w in t]), owner, place, bounds[owner] + place


def _places_in_filter(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(((keys * np.uint64(f)) >> np.uint64(38)) & np.uint64(FILTER_BITS - 1) for f in (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _item_windows(words: int, walks: int, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                tokens = [words_of(t) for t in part.column(1).to_pylist()]
                sequence, owner, place, starts = _windows(tokens, words)
                runs = pa.array([" ".join(tokens[o][p : p + words]) for o, p in zip(owner, place)], pa.string())
                ids = part.column(0).take(pa.array(owner))
                for walk in range(walks):
                    yield pa.RecordBatch.from_arrays([pa.array(window_keys(sequence, starts, words, walk, places).astype(np.int64)), ids, runs], names=["key", "item", "run"])

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The touched chunks of the filter that the keys of a task make."""
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        for at in _places_in_filter(batch.column(0).to_numpy().astype(np.uint64)):
            bits[at.astype(np.int64)] = True
    rows = bits.reshape(-1, CHUNK_BITS)
    touched = np.flatnonzero(rows.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(touched, pa.int64()), pa.array([np.packbits(rows[i], bitorder="little").tobytes() for i in touched], pa.binary())], names=["chunk", "bits"])


def _united(table: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()])
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


def key_filter(keyed: DataFrame) -> np.ndarray:
    """The bits of the filter of ``key``, united chunk by chunk; at most ``FILTER_BITS`` of them reach the driver."""
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    step = CHUNK_BITS // 8
    schema = "chunk bigint, bits binary"
    for chunk, bits in keyed.select("key").mapInArrow(_chunks, schema).groupBy("chunk").applyInArrow(_united, schema).collect():
        out[chunk * step : (chunk + 1) * step] = np.frombuffer(bits, np.uint8)
    return out


def leaks(documents: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, words: int = 12, max_edits: int = 0, recall: float = 0.99) -> DataFrame:
    """Distinct (doc_key, item_key) of every document and test item with a common run of ``words`` words.

    With ``max_edits`` the two runs may differ by so many substitutions, insertions and deletions. Null and empty texts,
    and texts of fewer words than a window, match nothing; repeated rows and items found by several windows give one row.
    Other columns are not read.
    """
    walks, places = plan(words, max_edits, recall)
    doc_type, item_type = documents.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    source = items.select(F.col(item_key).alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    known = checkpoint(source.mapInArrow(_item_windows(words, walks, places), f"key bigint, item {item_type}, run string"))
    shared = documents.sparkSession.sparkContext.broadcast(key_filter(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                tokens = [words_of(t) for t in part.column(1).to_pylist()]
                sequence, owner, place, starts = _windows(tokens, words)
                for low in range(0, len(starts), STEP):
                    some = slice(low, low + STEP)
                    for walk in range(walks):
                        keys = window_keys(sequence, starts[some], words, walk, places)
                        hit = np.ones(len(keys), bool)
                        for spot in _places_in_filter(keys):
                            hit &= (bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                        hit = np.flatnonzero(hit)
                        own, spots = owner[some][hit], place[some][hit]
                        runs = [" ".join(tokens[o][p : p + words]) for o, p in zip(own, spots)]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(keys[hit].astype(np.int64)), pa.array(runs, pa.string())], names=["doc", "key", "window"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [edit_distance(a.split(" "), b.split(" "), max_edits) <= max_edits for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["doc", "item"]).filter(pa.array(near, pa.bool_()))

    plain = documents.select(F.col(doc_key).alias("doc"), F.col(doc_text).cast("string").alias("text")).where("text is not null")
    seen = plain.mapInArrow(run, f"doc {doc_type}, key bigint, window string")
    few = known.count() <= BROADCAST_WINDOWS
    joined = seen.join(F.broadcast(known) if few else known.hint("merge"), "key").select("doc", "item", "window", "run")
    found = joined.mapInArrow(verified, f"doc {doc_type}, item {item_type}").distinct()
    return found.withColumnRenamed("doc", doc_key).withColumnRenamed("item", item_key)
