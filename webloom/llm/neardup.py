"""Near-duplicate pages by tiled bit-map comparison.

A page is the set of its runs of three words; of that set a bit map is kept. Two sets within the wanted Jaccard
similarity j differ in at most (1 - j) / (1 + j) of the sum of their sizes, and exclusive-or of their bit maps never
shows more differences than there are: so bit counts under that radius are a sure filter, and tile pairs are skipped
whole when their population counts alone differ beyond it. What passes is verified on the sets themselves. Bit maps
grow with their page (four bits a run, a power of two), so long pages do not saturate them; the longer map of two is
folded to the length of the shorter.

All tiles against all would be quadratic, so tiles are only built of pages that share a band of minima (``ROWS`` of
them, ``BANDS`` bands: a pair at the threshold itself is missed once in a thousand, a closer one practically never).
Pages of a band that more than ``HOT`` of them share are banded again, by more minima a band (``DEEP_ROWS``,
``DEEP_BANDS``: as sure, and a hundred times as selective for pages that have a tenth in common); what is still large is
spread over several tile pairs. Exact copies are one page throughout: the result is a class for each page and the links
between classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.mainbody import main_content
from webloom.session import checkpoint

#: Bits of a map: at least, at most.
BITS, MOST_BITS = 1 << 10, 1 << 16
ROWS, BANDS = 3, 52
DEEP_ROWS, DEEP_BANDS = 5, 220
#: Pages of a band from which on it is banded again.
HOT = 1 << 16
#: Pages of one band in a tile at most; more are spread over several, and each pair of tiles is a group of its own.
TILE = 1 << 14
#: Pairs of ids a task holds before it passes them on.
FLUSH = 1_000_000
#: Copies of one page in a block, when copies are paired.
COPIES = 1024
#: Pages compared at once within a task.
STEP = 512
#: So many ids of candidates are broadcast to pick their pages; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
HAN = regex.compile(r"\p{Han}")


def _family(rows: int, bands: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    random = np.random.default_rng(20_011 + rows)
    return rows, bands, random.integers(1, 1 << 63, rows * bands, dtype=np.uint64) | np.uint64(1), random.integers(0, 1 << 63, rows * bands, dtype=np.uint64)


PLAIN, DEEP = _family(ROWS, BANDS), _family(DEEP_ROWS, DEEP_BANDS)


def shingles(text: str, least_words: int = 60, run: int = 3) -> np.ndarray | None:
    """Sorted hashes of the distinct runs of words (of characters in Chinese), or None for texts with too few words."""
    text = text.casefold()
    if 2 * len(HAN.findall(text)) > len(text) - text.count(" ") - text.count("\n"):
        words = [c for c in text if c.isalnum()]
    else:
        words = WORD.findall(text)
    if len(words) < max(least_words, run):
        return None
    return np.unique(np.fromiter((xxhash.xxh64_intdigest("\0".join(w)) for w in zip(*(words[i:] for i in range(run)))), np.uint64, len(words) - run + 1))


def bit_map(values: np.ndarray) -> bytes:
    size = min(MOST_BITS, max(BITS, 1 << (4 * len(values) - 1).bit_length()))
    bits = np.zeros(size, np.uint8)
    bits[(values >> np.uint64(11)) % np.uint64(size)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bit maps as rows of 64-bit words, brought to fewer words: what the shorter map would have been."""
    return maps if maps.shape[1] == words else np.bitwise_or.reduce(maps.reshape(len(maps), -1, words), axis=1)


def bands(values: np.ndarray, family=PLAIN) -> np.ndarray:
    """A hash for each band, of the minima of its rows."""
    rows, count, factors, offsets = family
    low = np.full(rows * count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 4096):  # long texts in parts
        mixed = values[at : at + 4096, None] * factors + offsets
        mixed ^= mixed >> np.uint64(32)
        low = np.minimum(low, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(0))
    key = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(rows - ROWS)
    for row in low.reshape(count, rows).T:
        key = (key ^ row) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(31)
    return key.astype(np.int64)


def _body_shingles(text: str | None, title: str | None, least_words: int) -> np.ndarray | None:
    return shingles("\n".join(main_content(text, title)), least_words) if text else None


def _lists(keys: list[np.ndarray], count: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * count), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))


def _signatures(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                index, digests, sizes, maps, keys = [], [], [], [], []
                for i, (t, h) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    values = _body_shingles(t, h, least_words)
                    if values is not None:
                        index.append(i)
                        digests.append(xxhash.xxh3_128_digest(values.tobytes()))
                        sizes.append(len(values))
                        maps.append(bit_map(values))
                        keys.append(bands(values))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index, pa.int64())), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary()), _lists(keys, BANDS)], names=["id", "digest", "size", "bits", "bands"])

    return run


def _sets(least_words: int, deep: bool):
    """The sets themselves, or their deep bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                values = [_body_shingles(t, h, least_words) for t, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                column = _lists([bands(v, DEEP) for v in values], DEEP_BANDS) if deep else pa.array([v.tobytes() for v in values], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), column], names=["id", "values"])

    return run


Block = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, sizes, maps of one length


def _blocks(ids: np.ndarray, sizes: np.ndarray, maps: list[bytes]) -> list[Block]:
    lengths = np.array([len(m) for m in maps])
    out = []
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out.append((ids[at], sizes[at], np.frombuffer(b"".join(maps[i] for i in at), np.uint64).reshape(-1, n // 8)))
    return out


def _close(left: Block, right: Block, same: bool, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids within the radius, by tiles of rising population counts."""
    words = min(left[2].shape[1], right[2].shape[1])

    def ordered(block: Block):
        maps = fold(block[2], words)
        counts = np.bitwise_count(maps).sum(1, dtype=np.int64)
        order = np.argsort(counts, kind="stable")
        return block[0][order], block[1][order], maps[order], counts[order]

    one = ordered(left)
    two = one if same else ordered(right)
    for i in range(0, len(one[0]), STEP):
        a, na, ma, ca = (x[i : i + STEP] for x in one)
        for j in range(i if same else 0, len(two[0]), STEP):
            b, nb, mb, cb = (x[j : j + STEP] for x in two)
            if max(cb[0] - ca[-1], ca[0] - cb[-1]) > radius * (na.max() + nb.max()):
                continue  # population counts alone differ beyond the radius
            differ = np.zeros((len(a), len(b)), np.uint32)
            for word in range(words):
                differ += np.bitwise_count(ma[:, word, None] ^ mb[None, :, word])
            x, y = np.nonzero(differ <= radius * (na[:, None] + nb[None, :]) + 1e-9)
            keep = x < y if same and i == j else a[x] != b[y]
            yield np.minimum(a[x], b[y])[keep], np.maximum(a[x], b[y])[keep]


def _compare(similarity: float):
    radius = (1 - similarity) / (1 + similarity)

    def group(side: np.ndarray, ids: np.ndarray, sizes: np.ndarray, maps: list[bytes], one: int, two: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if one == two:
            blocks = _blocks(ids, sizes, maps)
            for i, left in enumerate(blocks):
                yield from _close(left, left, True, radius)
                for right in blocks[i + 1 :]:
                    yield from _close(left, right, False, radius)
        else:
            halves = [_blocks(ids[at], sizes[at], [maps[i] for i in at]) for at in (np.flatnonzero(side == x) for x in (one, two))]
            for left in halves[0]:
                for right in halves[1]:
                    yield from _close(left, right, False, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tiles(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, one, two, side, ids, sizes = (table.column(c).to_numpy() for c in ("key", "one", "two", "tile", "id", "size"))
            sizes, maps = sizes.astype(np.int64), table.column("bits").to_pylist()
            heads = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
            found, count = [], 0

            def flush() -> pa.RecordBatch:
                pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found)]), axis=1)
                return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

            for a, b in zip(heads, np.append(heads[1:], len(key))):
                if b - a < 2:
                    continue
                for pair in group(side[a:b], ids[a:b], sizes[a:b], maps[a:b], one[a], two[a]):
                    found.append(pair)
                    count += len(pair[0])
                    if count >= FLUSH:
                        yield flush()
                        found, count = [], 0
            if found:
                yield flush()

        size = 0
        for batch in batches:  # sorted by tile pair: all but the last one are complete
            held.append(batch)
            size += batch.num_rows
            if size < TILE:
                continue
            table = pa.Table.from_batches(held)
            last = [table.column(c)[-1].as_py() for c in ("key", "one", "two")]
            same = np.logical_and.reduce([table.column(c).to_numpy() == v for c, v in zip(("key", "one", "two"), last)])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield from tiles(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size = table.num_rows - cut
        if held:
            yield from tiles(pa.Table.from_batches(held))

    return run


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= similarity * (len(x) + len(y) - common) - 1e-9:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])

    return run


def _of(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """The pages of some ids: the ids are broadcast if they are few, counted first, else joined by shuffle."""
    return pages.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge"), "id", "left_semi").select("id", "text", "title")


def _shared(keyed: DataFrame) -> DataFrame:
    """(key, n) of the bands of two pages or more; counts are combined before the shuffle."""
    return checkpoint(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))


def _links(pages: DataFrame, representatives: DataFrame, similarity: float, least_words: int, hot: int) -> DataFrame:
    """(a, b), a < b: verified pairs of representatives. ``pages`` has id, text, title.

    Estimates of exploded rows are far too low, so every join on bands is told to be by sorted shuffle: nothing that
    grows with the pages is broadcast, and skewed bands are split at run time.
    """
    keyed = representatives.select("id", F.explode("bands").alias("key"))
    shared = _shared(keyed)
    placed = keyed.join(shared.where(F.col("n") <= hot).hint("merge"), "key")
    large = shared.where(F.col("n") > hot)
    if not large.isEmpty():
        ids = checkpoint(keyed.join(large.hint("merge"), "key").select("id").distinct())
        deep = checkpoint(_of(pages, ids).mapInArrow(_sets(least_words, True), "id bigint, values array<bigint>")).select("id", F.explode("values").alias("key"))
        placed = placed.unionByName(deep.join(_shared(deep).hint("merge"), "key"))
    survivors = placed.join(representatives.select("id", "size", "bits").hint("merge"), "id")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    spread = survivors.withColumn("tiles", tiles).withColumn("tile", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    grouped = spread.select("key", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "tile", "id", "size", "bits")
    near = grouped.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two").mapInArrow(_compare(similarity), "a bigint, b bigint")
    pairs = checkpoint(near.distinct())
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = checkpoint(_of(pages, ids).mapInArrow(_sets(least_words, False), "id bigint, values binary"))
    left, right = sets.select(F.col("id").alias("a"), F.col("values").alias("x")), sets.select(F.col("id").alias("b"), F.col("values").alias("y"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(_verify(similarity), "a bigint, b bigint")


def near_duplicates(df: DataFrame, key: str, text: str, title: str, similarity: float = 0.5, least_words: int = 60, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(id, class_id) of every page with enough words, and (a, b), a < b: the classes whose pages have that similarity.

    A class holds the pages with the same set of word runs and is named by the smallest of their ids; similarity is the
    Jaccard similarity of the three-word runs of main bodies. Null, empty and short texts are in no class; ``key`` is a
    unique BIGINT; texts are compared whole whatever their length; a null title is no hindrance. Other columns are not
    read. An empty table gives empty results.
    """
    pages = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"), F.col(title).cast("string").alias("title")).where("text is not null")
    signed = checkpoint(pages.mapInArrow(_signatures(least_words), "id bigint, digest binary, size int, bits binary, bands array<bigint>"))
    chosen = signed.groupBy("digest").agg(F.min(F.struct("id", "size", "bits", "bands")).alias("r"))
    representatives = checkpoint(chosen.select("digest", "r.*"))
    classes = signed.select("id", "digest").join(representatives.select("digest", F.col("id").alias("class_id")).hint("merge"), "digest").select("id", "class_id")
    return checkpoint(classes), _links(pages, representatives, similarity, least_words, hot)


def pairs(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every two pages of one class or of linked ones.

    As many rows as there are pairs: a large class is paired in blocks of ``COPIES`` pages, so that no task pairs it
    alone.
    """
    sized = classes.join(classes.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").hint("merge"), "class_id")
    blocks = F.ceil(F.col("n") / COPIES).cast("int")
    spread = sized.select("class_id", "id", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), blocks.alias("blocks"))
    one = spread.select("class_id", F.col("id").alias("p"), F.col("block").alias("left"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("right"))
    two = spread.select("class_id", F.col("id").alias("q"), F.col("block").alias("right"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("left"))
    within = one.join(two.hint("merge"), ["class_id", "left", "right"]).where("p < q").select("p", "q")
    members = classes.select(F.col("class_id").alias("a"), F.col("id").alias("p"))
    between = links.join(members.hint("merge"), "a").join(members.select(F.col("a").alias("b"), F.col("p").alias("q")).hint("merge"), "b").select("p", "q")
    return between.union(within).select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))
