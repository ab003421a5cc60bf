"""Benchmark decontamination with SimHash over item-sized windows.

Words are runs of letters, digits and non-ASCII characters, lower-cased in ASCII. An item of m
words is compared with windows of m words of every text (the whole text where it is shorter).
A window's 64-bit SimHash is the bit majority over its five-word shingles, repeats counted.

Only windows that can be similar at all are fingerprinted. Two windows of a and b shingles with
similarity t share at least t / (1 + t) * (a + b) of them, so a window with fewer shingles of the
item is left out; the others are counted out of the places of shared shingles, wherever those
stand in the item. The fingerprints of windows and items meet in eight blocks of eight bits: of
two fingerprints within ``radius`` bits some block differs by at most radius / 8. The Hamming
distance drops the rest, and candidates are verified by the exact weighted similarity: sum of the
smaller counts of each shingle over the sum of the larger, 0.8 or more.

Where no shingle counts twice about 10 of 64 bits differ at similarity 0.8, with a deviation of 3;
the radius of 24 leaves no pair out that chance would not need many millions of tries for. Windows
and items that repeat a shingle are verified whatever their bits.

The benchmark goes to the tasks in slices of at most ``SLICE_ITEMS`` items and
``SLICE_BYTES`` of text, each broadcast; a larger benchmark takes more passes.

Defined cases: items without a word match nothing; items of fewer than five words are one
shingle of all their words; null texts match nothing; repeated rows and items are reported each;
an empty table on either side gives an empty result; other columns are ignored or carried.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import arrays as ar

SHINGLE = 5
SLICE_ITEMS = 4096
SLICE_BYTES = 8 << 20
CELLS = 1 << 18  # shingles of the windows that are fingerprinted at a time

#: Bytes that are no part of a word: ASCII except letters and digits.
BREAK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def simhashes(shingles: np.ndarray) -> np.ndarray:
    """Bit majority over every row of shingle hashes."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(*shingles.shape, 8), axis=2, bitorder="little")
    return np.packbits(2 * bits.sum(axis=1, dtype=np.int32) > shingles.shape[1], axis=1, bitorder="little").view("<u8")[:, 0]


@dataclass
class Index:
    """One slice of the benchmark: shingles with their items and places, fingerprints, blocks."""

    ids: list
    words: np.ndarray  # words of each item
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by length: hash, first, item, place
    counts: list[Counter]
    prints: np.ndarray
    near: np.ndarray  # [block, value, item]: the item's block is within reach of the value
    repeats: np.ndarray  # the item holds a shingle twice
    radius: int


def build_index(ids: list, texts: list[str | None], radius: int) -> Index:
    kept, words, counts, prints, entries = [], [], [], [], defaultdict(list)
    for item, text in zip(ids, texts):
        data = FOLD[np.frombuffer((text or "").encode(), np.uint8)]
        starts, ends, _ = ar.word_spans(data, np.array([0, len(data)]), BREAK)
        if not len(starts):
            continue
        n = min(SHINGLE, len(starts))
        shingles = ar.window_hashes(ar.span_hashes(data, starts, ends), n)
        entries[n] += [(int(h), len(kept), place) for place, h in enumerate(shingles)]
        kept.append(item)
        words.append(len(starts))
        counts.append(Counter(shingles.tolist()))
        prints.append(simhashes(shingles[None, :])[0])
    grams = {}
    for n, rows in entries.items():
        rows.sort()
        table = np.array([h for h, _, _ in rows], np.uint64)
        first = np.flatnonzero(np.concatenate([[True], table[1:] != table[:-1]]))
        grams[n] = (table[first], np.append(first, len(rows)), np.array([i for _, i, _ in rows]), np.array([p for _, _, p in rows]))
    prints = np.array(prints, np.uint64)
    blocks = prints.view(np.uint8).reshape(-1, 8) if len(prints) else np.zeros((0, 8), np.uint8)
    values = np.arange(256, dtype=np.uint8)
    near = np.bitwise_count(values[None, :, None] ^ blocks.T[:, None, :]) <= radius // 8
    repeats = np.array([sum(c.values()) > len(c) for c in counts], bool)
    return Index(kept, np.array(words, np.int64), grams, counts, prints, near, repeats, radius)


def _hits(hashes: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the text, item, place in the item) of every shared shingle."""
    keys, first, item, place = table
    sieve = np.zeros(1 << 16, bool)
    sieve[keys >> np.uint64(48)] = True
    some = np.flatnonzero(sieve[hashes >> np.uint64(48)])
    at = np.minimum(np.searchsorted(keys, hashes[some]), len(keys) - 1)
    same = keys[at] == hashes[some]
    some, at = some[same], at[same]
    n = first[at + 1] - first[at]
    flat = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(some, n), item[flat], place[flat]


def find(data: np.ndarray, offsets: np.ndarray, index: Index, similarity: float) -> list[tuple]:
    """(row, item, first word, words, differing bits, similarity) of the best window of each row and item."""
    data = FOLD[data]
    starts, ends, rows = ar.word_spans(data, offsets, BREAK)
    words = ar.span_hashes(data, starts, ends)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    best: dict[tuple, tuple] = {}
    for n, table in index.grams.items():
        shingles = ar.window_hashes(words, n)
        whole = rows[: len(shingles)] == rows[n - 1:] if len(shingles) else np.zeros(0, bool)
        at, item, _ = _hits(np.where(whole, shingles, np.uint64(0)), table)
        keep = whole[at]
        # One hit a place and item, by item and place.
        hits = np.unique(item[keep].astype(np.int64) * len(rows) + at[keep])
        if not len(hits):
            continue
        item, at = hits // len(rows), hits % len(rows)
        first, length, item = _windows(item, at, rows, bounds, n, index, similarity)
        for size in np.unique(length).tolist():
            own = np.flatnonzero(length == size)
            step = max(1, min(1024, CELLS // size))
            for part in range(0, len(own), step):
                some = own[part:part + step]
                _verify(first[some], item[some], size, n, shingles, index, similarity, rows, bounds, best)
    return [(row, item, *found) for (row, item), found in sorted(best.items())]


def _windows(item: np.ndarray, at: np.ndarray, rows: np.ndarray, bounds: np.ndarray, n: int, index: Index, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, shingles and item of every window with as many hits as the similarity needs.

    A window whose first hit is hit i holds hit i + need - 1 too, so the windows of hit i are
    one interval of first words, and intervals of different hits of an item don't meet.
    """
    row = rows[at]
    low, high = bounds[row], bounds[row + 1]
    size = np.minimum(index.words[item], high - low)
    length, total = size - n + 1, index.words[item] - n + 1
    need = np.maximum(1, np.ceil(similarity / (1 + similarity) * (length + total) - 1e-9).astype(np.int64))
    mine = np.arange(len(at))
    last = np.minimum(mine + need - 1, len(at) - 1)
    enough = (mine + need <= len(at)) & (item[last] == item) & (row[last] == row)
    joined = np.concatenate([[False], (item[1:] == item[:-1]) & (row[1:] == row[:-1])])
    after = np.where(joined, np.concatenate([[0], at[:-1]]) + 1, low)
    begin = np.maximum(np.maximum(low, after), at[last] - length + 1)
    count = np.where(enough, np.maximum(0, np.minimum(at, high - size) - begin + 1), 0)
    first = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
    return first, np.repeat(length, count), np.repeat(item, count)


def _verify(first: np.ndarray, item: np.ndarray, length: int, n: int, shingles: np.ndarray, index: Index, similarity: float, rows: np.ndarray, bounds: np.ndarray, best: dict) -> None:
    held = shingles[first[:, None] + np.arange(length)]
    prints = simhashes(held)
    blocks = prints.view(np.uint8).reshape(-1, 8)
    near = np.zeros(len(first), bool)
    for b in range(8):
        near |= index.near[b, blocks[:, b], item]
    bits = np.bitwise_count(prints ^ index.prints[item])
    # The radius covers sets of different shingles; one that counts several times can turn any number of bits.
    ordered = np.sort(held, axis=1)
    exact = (ordered[:, 1:] == ordered[:, :-1]).any(axis=1) | index.repeats[item]
    for w in np.flatnonzero((near & (bits <= index.radius)) | exact).tolist():
        row, i, start = int(rows[first[w]]), int(item[w]), int(first[w])
        start -= int(bounds[row])
        old = best.get((row, i), (0, 0, 0, 0, 0.0, 0))[-2:]
        if (-1.0, start) >= old and old[0]:
            continue  # an equal window stands no later
        mine = Counter(held[w].tolist())
        common = sum(min(c, mine[h]) for h, c in index.counts[i].items() if h in mine)
        got = common / (length + max(1, int(index.words[i]) - n + 1) - common)
        if got >= similarity and (-got, start) < old:
            best[row, i] = (start, length + n - 1, int(bits[w]), got, -got, start)


def _slices(benchmark: DataFrame, item: str, text: str, radius: int) -> Iterator[Index]:
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    count = max(1, -(-n * 2 // SLICE_ITEMS), -(-size * 2 // SLICE_BYTES)) if n > SLICE_ITEMS or size > SLICE_BYTES else 1
    for s in range(count):
        got = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == s).toPandas()
        yield build_index(got["item"].tolist(), got["text"].tolist(), radius)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 24, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item, at_word, n_words, differing_bits, similarity: the best window of each text and item that match."""
    spark = docs.sparkSession
    ar.small_batches(spark)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item}` {benchmark.schema[item].dataType.simpleString()}, at_word long, n_words long, differing_bits int, similarity double"
    names, out = [key, item, "at_word", "n_words", "differing_bits", "similarity"], None
    for index in _slices(benchmark, item, item_text, radius):
        shared = spark.sparkContext.broadcast(index)
        kind = benchmark.schema[item].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch], shared=shared, kind=kind) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for part, data, offsets in ar.chunks(batches, "t"):
                found = find(data, offsets, index, similarity)
                if found:
                    items = pa.array([index.ids[f[1]] for f in found], pa.int64() if kind == "bigint" else None)
                    cols = [pa.array([f[i] for f in found], t) for i, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.int32()), (5, pa.float64()))]
                    yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array([f[0] for f in found])), items, *cols], names)

        got = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)
        out = got if out is None else out.union(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 24, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that match no item, with all their columns."""
    spark = docs.sparkSession
    ar.small_batches(spark)
    for index in _slices(benchmark, item, item_text, radius):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part, data, offsets in ar.chunks(batches, text):
                keep = np.ones(part.num_rows, bool)
                keep[[f[0] for f in find(data, offsets, shared.value, similarity)]] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
