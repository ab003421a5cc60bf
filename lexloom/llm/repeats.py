"""Repeated byte strings across documents, from suffix arrays and their interval trees.

A string of ``WINDOW`` bytes is found by content: of its 16-byte pieces the one of least hash
is its anchor, so equal strings have equal anchors wherever they stand. That cuts the suffixes
of all texts into groups that can be sorted apart, by the hash of the anchor:

1. Every text's anchors are dealt by hash. Those that two texts share survive. An anchor that
   comes in several texts of one chunk is dealt on in 64 parts, so a passage of every
   document doesn't meet in one task.
2. Every surviving anchor gives the stretch of text whose strings have it as anchor. Equal
   stretches are one row with the least and the largest id of their texts.
3. Per anchor, an enhanced suffix array (order and common prefix lengths) is built over the
   suffixes of its stretches. A stack scan gives the intervals of the prefix tree; those whose
   left neighbours differ are the maximal repeats, each with all its suffixes.
4. Repeats that reach a text of smaller id are brought back to all stretches, and the removed
   runs of a text are the union of its repeats.

Repeats are maximal within a stretch; a longer passage comes as a chain of repeats, each with
all its occurrences, whose union is the passage. Equal texts are one text in all steps: a copy
with a larger id than the smallest is removed from end to end.

Defined cases: a null text is empty; texts shorter than ``WINDOW`` bytes keep all; a null id is
larger than all others and null ids don't remove each other; rows of equal id don't either,
whatever their texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom import session
from lexloom.llm import arrays as ar

WINDOW = 50
PIECE = 16
SPAN = WINDOW - PIECE + 1  # pieces in a window
LAST = (1 << 63) - 1
PARTS = 64


def anchors(data: np.ndarray, offsets: np.ndarray, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash of the anchor, first window, windows) of every run of windows with one anchor."""
    found = [[], [], [], []]
    data = np.ascontiguousarray(data)
    row_ends = offsets[1:]
    for low in range(0, max(0, len(data) - WINDOW + 1), block):
        high = min(low + block, len(data) - WINDOW + 1)
        part = data[low:high + WINDOW - 1]
        words = np.ndarray((len(part) - 7,), "<u8", part, 0, (1,))
        with np.errstate(over="ignore"):
            h = ar.mix(words[: len(part) - PIECE + 1] * np.uint64(0x9E3779B97F4A7C15) + ar.mix(words[8:]))
        at = np.arange(len(h), dtype=np.uint64)
        least = (h & ~np.uint64(63)) | (at & np.uint64(63))
        span = 1
        while 2 * span <= SPAN:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < SPAN:
            least = np.minimum(least[: len(least) - (SPAN - span)], least[SPAN - span:])
        first = np.arange(len(least))
        anchor = first + (((least & np.uint64(63)).astype(np.int64) - first) & 63)
        row = np.searchsorted(row_ends, first + low, "right")
        ok = first + low + WINDOW <= row_ends[row]
        new = np.ones(len(first), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (ok[1:] != ok[:-1])
        starts = np.flatnonzero(new)
        n = np.diff(np.append(starts, len(first)))
        starts, n = starts[ok[starts]], n[ok[starts]]
        for out, got in zip(found, (row[starts], h[anchor[starts]], starts + low, n)):
            out.append(got)
    kinds = (np.int64, np.uint64, np.int64, np.int64)
    return tuple(np.concatenate(x).astype(k) if x else np.zeros(0, k) for x, k in zip(found, kinds))


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, t1, part: the distinct anchors of every text; part 0 of an anchor shared inside the chunk only tells so."""
    for part, data, offsets in ar.chunks(batches, "text"):
        row, h, _, _ = anchors(data, offsets)
        t1 = part.column("t1").to_numpy(zero_copy_only=False)[row]
        order = np.lexsort((t1, h))
        h, t1 = h[order], t1[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (t1[1:] != t1[:-1])
        h, t1 = h[once], t1[once]
        if not len(h):
            continue
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        shared = np.repeat(np.diff(np.append(first, len(h))) > 1, np.diff(np.append(first, len(h))))
        where = np.where(shared, 1 + (t1 & (PARTS - 1)), 0).astype(np.int16)
        tell = first[shared[first]]
        yield pa.RecordBatch.from_arrays([
            _long(np.concatenate([h, h[tell]])), _long(np.concatenate([t1, np.zeros(len(tell), np.int64)])),
            pa.array(np.concatenate([where, np.full(len(tell), -1, np.int16)])),
        ], ["h", "t1", "part"])


def _surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, t1 of the anchors of two texts; rows come sorted by h."""
    def out(h: np.ndarray, t1: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(h):
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.append(first, len(h)))
            told = np.maximum.reduceat(part != 0, first)  # a chunk has seen two texts
            two = np.minimum.reduceat(t1, first) != np.maximum.reduceat(t1, first)
            keep = np.repeat(told | two, n) & (part >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(t1[keep])], ["h", "t1"])

    yield from _grouped(batches, ("h", "t1", "part"), out)


def _grouped(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], out) -> Iterator[pa.RecordBatch]:
    """Calls ``out`` with the columns of whole groups of the first one, by which the rows are sorted."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        got = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        cut = int(np.searchsorted(got[0], got[0][-1], "left"))
        if cut or (held and held[-1][0][-1] != got[0][0]):
            held.append([g[:cut] for g in got])
            yield from out(*(np.concatenate(x) for x in zip(*held)))
            held = []
        held.append([g[cut:] for g in got])
    if held:
        yield from out(*(np.concatenate(x) for x in zip(*held)))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """t1, t2, m, at, h, stretch: where each surviving anchor's windows start, and their bytes."""
    for part, data, offsets in ar.chunks(batches, "text"):
        row, h, first, n = anchors(data, offsets)
        lists = part.column("hs").combine_chunks() if isinstance(part.column("hs"), pa.ChunkedArray) else part.column("hs")
        alive = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        with np.errstate(over="ignore"):
            salt = np.uint64(0xD6E8FEB86659FD93)
            keep = np.isin(ar.mix(h + row.astype(np.uint64) * salt), ar.mix(alive + owner.astype(np.uint64) * salt))
        row, h, first, n = row[keep], h[keep], first[keep], n[keep]
        raw = data.tobytes()
        own = pa.array(row)
        yield pa.RecordBatch.from_arrays([
            *(part.column(c).take(own) for c in ("t1", "t2", "m")), pa.array(first - offsets[row]), _long(h),
            pa.array([raw[a:a + k + WINDOW - 1] for a, k in zip(first.tolist(), n.tolist())], pa.binary()),
        ], ["t1", "t2", "m", "at", "h", "stretch"])


def suffix_array(stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, offset, common prefix with the suffix before) of the suffixes of at least WINDOW bytes, in
    order, and the byte before each. Suffixes are ordered by their first WINDOW bytes (by hash, which keeps
    equal ones together) and then as strings. Prefixes shorter than WINDOW count as 0.
    """
    data = np.frombuffer(b"".join(stretches) + bytes(2 * WINDOW), np.uint8)
    size = np.fromiter(map(len, stretches), np.int64, len(stretches))
    begin = np.cumsum(size) - size
    n = size - WINDOW + 1
    own = np.repeat(np.arange(len(size)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = begin[own] + offset
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    with np.errstate(over="ignore"):
        head = np.zeros(len(at), np.uint64)
        for i in (0, 8, 16, 24, 32, 40, WINDOW - 8):
            head = ar.mix(head * np.uint64(0x9E3779B97F4A7C15) + words[at + i])
    order = np.argsort(head)
    twin = head[order][1:] == head[order][:-1]
    some = np.zeros(len(order), bool)
    some[1:] |= twin
    some[:-1] |= twin
    order = order[some]  # a string that comes once is no repeat
    at, own, offset, head = at[order], own[order], offset[order], head[order]
    rest = size[own] - offset - WINDOW
    reach = int(rest.max(initial=0))
    tail = data[np.minimum(at[:, None] + WINDOW + np.arange(reach), len(data) - 1)].astype(np.int16) + 1
    tail[np.arange(reach) >= rest[:, None]] = 0
    order = np.lexsort((*tail.T[::-1], head)) if reach else np.argsort(head, kind="stable")
    at, own, offset, head, rest, tail = at[order], own[order], offset[order], head[order], rest[order], tail[order]
    lcp = np.zeros(len(at), np.int64)
    if len(at):
        differ = tail[1:] != tail[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), reach) if reach else np.zeros(len(at) - 1, np.int64)
        common = np.minimum(common, np.minimum(rest[1:], rest[:-1]))
        same = head[1:] == head[:-1]
        lcp[1:] = np.where(same, WINDOW + common, 0)
    left = np.where(offset > 0, data[np.maximum(at - 1, 0)].astype(np.int64), -1 - own)  # a stretch's start has no left byte
    return own, offset, lcp, left


def maximal_repeats(lcp: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(length, first, end) of the tree's intervals of WINDOW bytes or more whose left bytes differ.

    A stack scan; the left bytes of an interval are told by one value, or by None once they differ.
    """
    stack: list[list] = []
    held = left.tolist()
    for i, length in enumerate([*lcp[1:].tolist(), 0] if len(lcp) else []):
        start, byte = i, held[i]
        while stack and stack[-1][0] > length:
            deep, start, inner = stack.pop()
            byte = byte if inner == byte else None
            if byte is None:
                yield deep, start, i + 1
        if length >= WINDOW:
            if stack and stack[-1][0] == length:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == byte else None
            else:
                stack.append([length, start, byte])
        elif stack:
            raise AssertionError("intervals are closed at every break")
    # the stack is empty: the scan ends with length 0


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, stretch hash, and the repeats that reach a smaller id than the stretch's largest: offset, length, least id."""
    def out(h, c, stretch, low, high) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, int]] = [
            (i, 0, len(stretch[i]), int(low[i])) for i in np.flatnonzero(low < high).tolist()
        ]
        # A group with one stretch has no more repeats.
        many = np.flatnonzero(np.concatenate([[False], h[1:] == h[:-1]]) | np.concatenate([h[1:] == h[:-1], [False]]))
        first = 0
        while first < len(many):  # whole groups, about 16,384 stretches at a time
            last = first + int(np.searchsorted(h[many[first:]], h[many[min(first + (1 << 14), len(many)) - 1]], "right"))
            rows += _repeats_of(many[first:last], stretch, low, high)
            first = last
        rows.sort()
        if rows:
            own = np.array([r[0] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array(c[own]), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3))], ["h", "c", "off", "len", "low"])

    yield from _grouped(batches, ("h", "c", "stretch", "low", "high"), out)


def _repeats_of(some: np.ndarray, stretch: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int, int]]:
    own, offset, lcp, left = suffix_array([stretch[i] for i in some.tolist()])
    ids = low[some][own]
    rows = []
    for length, first, end in maximal_repeats(lcp, left):
        least = int(ids[first:end].min())
        for k in range(first, end):
            i = int(some[own[k]])
            if least < low[i]:  # texts above the stretch's own least id lose all of it already
                rows.append((i, int(offset[k]), length, least))
    return rows


def _id(key: str):
    return F.coalesce(F.col(key).cast("long"), F.lit(LAST))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", used: list[DataFrame] | None = None) -> DataFrame:
    """t1, t2 (hashes of the text), start, length, least: the maximal repeats of every text that reach a smaller id.

    ``used`` gets the written tables that the result reads; those of the steps before are deleted.
    """
    ar.small_batches(docs.sparkSession)
    rows = docs.select(_id(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), F.col(text)).alias("t2"))
    dealt = rows.select("t1", "text").mapInArrow(_dealt, "h long, t1 long, part short")
    alive = session.save(_spread(dealt).mapInArrow(_surviving, "h long, t1 long").groupBy("t1").agg(F.collect_list("h").alias("hs")), "repeat-anchors")
    firsts = rows.groupBy("t1", "t2").agg(F.min("id").alias("m"))
    held = alive.join(firsts, "t1").select("hs", "t1", "t2", F.col("m").alias("id"))
    texts = rows.join(held, ["t1", "t2", "id"]).select("text", "hs", "t1", "t2", F.col("id").alias("m"))
    found = session.save(texts.mapInArrow(_stretches, "t1 long, t2 long, m long, at long, h long, stretch binary"), "repeat-stretches")
    session.discard(alive)
    c = F.xxhash64("stretch")
    kinds = found.groupBy("h", "stretch").agg(F.min("m").alias("low"), F.max("m").alias("high"))
    kinds = session.save(kinds.select("h", c.alias("c"), "stretch", "low", "high"), "repeat-kinds")
    reach = session.save(kinds.repartition("h").sortWithinPartitions("h").mapInArrow(_reach, "h long, c long, off long, len long, low long"), "repeat-reach")
    session.discard(kinds)
    if used is not None:
        used += [found, reach]
    where = found.select("t1", "t2", "m", "at", "h", c.alias("c"))
    return where.join(reach, ["h", "c"]).where("low < m").select("t1", "t2", (F.col("at") + F.col("off")).alias("start"), F.col("len").alias("length"), F.col("low").alias("least"))


def _spread(dealt: DataFrame) -> DataFrame:
    """Rows with part 0 and -1 of an anchor together, the others in parts of their own."""
    return dealt.repartition(F.col("h"), F.greatest(F.col("part"), F.lit(0).cast("short"))).sortWithinPartitions("h")


def _union(starts: list[int], lengths: list[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, (s + n for s, n in zip(starts, lengths)))):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, spans (removed runs: start, end), n_removed, n_spans, kept (bytes) of every row."""
    rows = docs.select(F.col(key).alias("k"), _id(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), F.col(text)).alias("t2"))
    used: list[DataFrame] = []
    runs = repeats(docs, key, text, used).groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "length")).alias("runs"))
    runs = session.save(runs, "repeat-runs")
    session.discard(*used)
    firsts = rows.groupBy("t1", "t2").agg(F.min("id").alias("m"))
    facts = firsts.join(runs, ["t1", "t2"], "left")
    held = rows.join(facts, ["t1", "t2"]).select("k", F.coalesce("text", F.lit("")).cast("binary").alias("text"), (F.col("id") > F.col("m")).alias("copy"), F.col("runs.start").alias("starts"), F.col("runs.length").alias("lengths"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, copy, starts, lengths in zip(*(batch.column(c).to_pylist() for c in ("text", "copy", "starts", "lengths"))):
                n = len(text)
                spans = ([(0, n)] if n >= WINDOW else []) if copy else _union(starts or [], lengths or [])
                ends = [0, *(e for _, e in spans)]
                kept = b"".join(text[a:b] for a, b in zip(ends, [*(s for s, _ in spans), n]))
                out.append((n, [{"start": a, "end": b} for a, b in spans], n - len(kept), len(spans), kept))
            cols = list(zip(*out)) if out else [()] * 5
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = (pa.int64(), span, pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("k"), *(pa.array(list(c), t) for c, t in zip(cols, kinds))], ["k", "n_bytes", "spans", "n_removed", "n_spans", "kept"])

    return held.mapInArrow(run, f"k {kind}, n_bytes long, spans array<struct<start: long, end: long>>, n_removed long, n_spans long, kept binary").withColumnRenamed("k", key)
