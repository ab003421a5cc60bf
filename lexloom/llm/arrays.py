"""Arrow batches as numpy arrays: text bytes, words, hashes, runs.

Everything here works on one bounded chunk of whole texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

CHUNK_BYTES = 1 << 20
BATCH_ROWS = 512

# White space as the contracts name it: space and the five controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_REACH = 4096
with np.errstate(over="ignore"):
    _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_REACH - 1, _ODD, np.uint64))])


def small_batches(spark: SparkSession) -> None:
    """Let a batch hold few rows: texts can be long and a batch is held whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and the n + 1 offsets into them; a null text is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64, len(column) + 1, column.offset * 8)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Whole rows of about ``CHUNK_BYTES`` of text together: slice of the batch, bytes, offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
            yield batch.slice(first, last - first), data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
            first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words end at white space and at the end of their text."""
    gap = space[data]
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    word = ~gap
    starts = np.flatnonzero(word & (breaks[:-1] | np.concatenate([[True], gap[:-1]])[: len(data)]))
    ends = np.flatnonzero(word & (breaks[1:] | np.concatenate([gap[1:], [True]])[: len(data)])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """64-bit hashes of disjoint ascending spans: polynomials of the bytes, mixed with the length."""
    out = np.zeros(len(starts), np.uint64)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + block, "right")))
            low, high = int(starts[first]), int(ends[last - 1])
            own = starts[first:last] - low
            size = ends[first:last] - starts[first:last]
            at = np.arange(high - low) - np.repeat(own, np.diff(np.append(own, high - low)))
            inside = at < np.repeat(size, np.diff(np.append(own, high - low)))
            value = (data[low:high].astype(np.uint64) + np.uint64(1)) * _POWERS[at % _REACH]
            value *= np.uint64(2) * (at // _REACH).astype(np.uint64) + np.uint64(1)
            value[~inside] = 0
            out[first:last] = mix(np.add.reduceat(value, own) + size.astype(np.uint64) * _ODD)
            first = last
    return out


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every run of n word hashes, doubling the length where it can."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        got, length, power = words.copy(), 1, _ODD
        for bit in bin(n)[3:]:
            got = got[: len(got) - length] * power + got[length:]
            length, power = 2 * length, power * power
            if bit == "1":
                got = got[:-1] * _ODD + words[length: length + len(got) - 1]
                length, power = length + 1, power * _ODD
    return mix(got[: len(words) - n + 1])


def per_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    return np.bincount(rows, values, n_rows).astype(np.int64)
