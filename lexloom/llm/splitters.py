"""Sharding by sampled splitters.

Records are drawn with probability in proportion to their size; quantiles of the drawn keys
cut the key order into many fine ranges. The exact bytes of every range are then counted,
and overfull ranges are cut again by splitters drawn from their own records. Ranges are
dealt to shards, largest first to the lightest shard, so shards come out nearly equal.
Positions in a shard are the range's offset plus the rank in its range, so no task ever
orders a whole shard.

The key is (doc_id, hash of the text); a null id sorts first. Rows equal in both are alike,
so an overfull range of such rows is cut by a third part, the row's place in its input split.

The driver holds the boundaries and the totals of the ranges: both are bounded by
``fine_ranges`` and by the number of cuts of overfull ranges, whatever the input's size.

Defined cases: a null text has size 1 and the crc of the empty text; an empty table gives an
empty result; other columns are carried or ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = ("k1", "k2", "k3")


@dataclass(frozen=True)
class Plan:
    """Boundaries (ascending key triples) and, for every range, its shard and first slot."""

    bounds: np.ndarray
    shard: list[int]
    first: list[int]


def record_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple = ()) -> DataFrame:
    """What is carried of each row as ``row`` (all columns by default), its size, and the three parts of its key.

    The third part tells equal rows apart by their place in the input. Several passes work it out
    anew, so ``docs`` has to be a stored table (a file scan): there a place is the same in every pass.
    """
    return docs.select(
        F.struct(*(carry or [F.col(f"`{c}`") for c in docs.columns])).alias("row"), record_size(text).alias("size"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text).alias("k2"),
        F.xxhash64(F.monotonically_increasing_id()).alias("k3"),
    )


def range_of(bounds: np.ndarray) -> Column:
    """Number of boundaries at or below the row's key."""
    order = np.ascontiguousarray(bounds)
    firsts = order[:, 0]

    def place(k1: pd.Series, k2: pd.Series, k3: pd.Series) -> pd.Series:
        parts = [k.to_numpy() for k in (k1, k2, k3)]
        low, high = np.searchsorted(firsts, parts[0], "left"), np.searchsorted(firsts, parts[0], "right")
        at = high.copy()
        for i in np.flatnonzero(low < high):
            own = (parts[1][i], parts[2][i])
            at[i] = low[i] + sum((b, c) <= own for b, c in order[low[i]:high[i], 1:].tolist()) if high[i] - low[i] < 64 else low[i] + _bisect(order[low[i]:high[i], 1:], own)
        return pd.Series(at.astype(np.int32))

    return F.pandas_udf(place, "int")(*PARTS)


def _bisect(bounds: np.ndarray, own: tuple[int, int]) -> int:
    low, high = 0, len(bounds)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if (bounds[mid, 0], bounds[mid, 1]) <= own else (low, mid)
    return low


def draw(rows: DataFrame, total: int, want: int) -> np.ndarray:
    """Keys of about ``want`` draws; a row of s bytes is drawn s * want / total times on average."""
    wanted = F.col("size") * F.lit(want / total)
    chance = F.pmod(F.xxhash64("k1", "k2", "k3", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor(wanted) + (chance < wanted - F.floor(wanted)).cast("int")).cast("long")
    got = rows.select(*PARTS, times.alias("times")).where("times > 0").toPandas()
    keys = got[list(PARTS)].to_numpy(np.int64)
    order = np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))
    return np.repeat(keys[order], got["times"].to_numpy()[order], axis=0)


def quantiles(keys: np.ndarray, n: int) -> np.ndarray:
    at = (np.arange(1, n) * len(keys) // n) if len(keys) else np.zeros(0, int)
    return np.unique(keys[at], axis=0)


def merged(bounds: np.ndarray, more: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([bounds, more]), axis=0)


def plan(rows: DataFrame, shards: int, fine_ranges: int, draws_per_range: int = 16, overfull: float = 2.0) -> Plan:
    """``rows`` is cheap to read again: it has size and the key parts only."""
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    none = np.zeros((0, 3), np.int64)
    if not n_rows:
        return Plan(none, [0], [0])
    bounds = quantiles(draw(rows, total, draws_per_range * fine_ranges), fine_ranges)
    fair = max(1.0, total / fine_ranges)
    for _ in range(2):
        held = _held(rows, bounds)
        full = held[(held["bytes"] > overfull * fair) & (held["n"] > 1)]
        if not len(full):
            break
        inside = rows.withColumn("r", range_of(bounds)).where(F.col("r").isin([int(r) for r in full["r"]]))
        keys = draw(inside, int(full["bytes"].sum()), int(draws_per_range * full["bytes"].sum() / fair))
        pieces = [quantiles(part, int(np.ceil(b / fair)) + 1) for part, b in zip(_by_range(keys, bounds, full["r"]), full["bytes"])]
        more = merged(bounds, np.concatenate([none, *pieces]))
        if len(more) == len(bounds):
            break
        bounds = more
    held = _held(rows, bounds)
    shard, first = [0] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    load = [(0, s, 0) for s in range(shards)]
    for r, size, n in sorted(held[["r", "bytes", "n"]].itertuples(index=False), key=lambda x: (-x[1], x[0])):
        b, s, slots = heapq.heappop(load)
        shard[r], first[r] = s, slots
        heapq.heappush(load, (b + int(size), s, slots + int(n)))
    return Plan(bounds, shard, first)


def _held(rows: DataFrame, bounds: np.ndarray) -> pd.DataFrame:
    return rows.groupBy(range_of(bounds).alias("r")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("r").toPandas()


def _by_range(keys: np.ndarray, bounds: np.ndarray, ranges) -> list[np.ndarray]:
    at = np.array([_bisect3(bounds, tuple(k)) for k in keys.tolist()], np.int64)
    return [keys[at == r] for r in ranges]


def _bisect3(bounds: np.ndarray, own: tuple) -> int:
    low, high = 0, len(bounds)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if tuple(bounds[mid]) <= own else (low, mid)
    return low


def assign(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", fine_ranges: int | None = None, carry: tuple = ()) -> DataFrame:
    """``row``, size, shard and gapless slot of every row; ``row`` holds ``carry`` or all columns.

    ``fine_ranges`` defaults to 256 for each shard. Plans for tables beyond a few TB should
    raise it so that a range fits a task.
    """
    rows = keyed(docs, key, text, carry)
    made = plan(rows.select("size", *PARTS), shards, fine_ranges or 256 * shards)
    table = docs.sparkSession.createDataFrame(pd.DataFrame({"r": np.arange(len(made.shard), dtype=np.int32), "shard": np.array(made.shard, np.int32), "first": np.array(made.first, np.int64)}))
    inside = Window.partitionBy("r").orderBy(*PARTS)
    return (
        rows.withColumn("r", range_of(made.bounds)).withColumn("rank", F.row_number().over(inside))
        # One row a range, a number that the driver set: a broadcast of proven size.
        .join(F.broadcast(table), "r")
        .select("row", "size", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"))
    )
