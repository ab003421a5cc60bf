"""String similarity (SCL-13) and exact candidate keys for similarity joins.

Two scores are used: normalized insert/delete similarity for linkage and
longest-block similarity for word search.  Both need a common subsequence, so a
pair that reaches a threshold cannot differ by more than a bounded number of
inserts and deletes.  Cutting one string into one piece more than that bound
leaves at least one piece untouched, at a position that can shift only a
little.  Joining on the pieces finds every pair above the threshold without
comparing all pairs; only those candidates are scored.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len(a) + len(b)), with the LCS from bit vectors."""
    total = len(a) + len(b)
    if not total:
        return 100.0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    mask = (1 << len(a)) - 1
    free = mask
    for ch in b:
        hit = free & places.get(ch, 0)
        free = ((free + hit) | (free - hit)) & mask
    common = len(a) - free.bit_count()
    return (1.0 - (total - 2 * common) / total) * 100.0


def block_ratio(a: str, b: str) -> float:
    """Longest matching blocks, found recursively."""
    return SequenceMatcher(a=a, b=b).ratio() * 100.0


@F.pandas_udf(T.DoubleType())
def indel_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(a, b) for a, b in zip(left, right)])


@F.pandas_udf(T.DoubleType())
def block_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([block_ratio(a, b) for a, b in zip(left, right)])


def allowed_edits(total_length: Column, threshold: float) -> Column:
    """Most inserts and deletes a pair of this summed length may need."""
    return F.floor(total_length * (100.0 - threshold) / 100.0 + 1e-9).cast("int")


def _pieces(length: Column, edits: Column) -> Column:
    """(index, start, width) of edits+1 near-equal pieces of a string of this length."""
    n = edits + 1
    return F.transform(
        F.sequence(F.lit(0), edits),
        lambda i: F.struct(
            i.alias("i"),
            F.floor(i * length / n).cast("int").alias("start"),
            (F.floor((i + 1) * length / n) - F.floor(i * length / n)).cast("int").alias("width"),
        ),
    )


def similar_pairs(
    left: DataFrame,
    right: DataFrame,
    scope: list[str],
    threshold: float,
    prefix: int | None = None,
    length_band: int | None = None,
) -> DataFrame:
    """Distinct pairs (scope, value_left, value_right) that may reach ``threshold``.

    ``left`` and ``right`` hold ``scope`` columns and a ``value`` column of
    distinct strings.  With ``prefix`` the first characters must agree (one
    character for values of length three), with ``length_band`` the lengths may
    differ by no more than that.  Nothing above the threshold is lost.
    """
    value, n = F.col("value"), F.length("value")
    loss = (100.0 - threshold) / 100.0
    spread = F.ceil(n * loss / (1 - loss) * 2).cast("int") if length_band is None else F.lit(length_band)
    head = F.when(n >= 4, prefix).otherwise(1) if prefix else F.lit(0)

    def sized(rows: DataFrame, own: str, other: str) -> DataFrame:
        lengths = F.sequence(F.greatest(n - spread, F.lit(1)), n + spread)
        out = rows.select(*scope, "value", n.alias(own), F.explode(lengths).alias(other))
        edits = allowed_edits(F.col(own) + F.col(other), threshold)
        return out.withColumn("edits", edits).where(F.abs(F.col(own) - F.col(other)) <= F.col("edits"))

    # The left side decides the prefix length, so the right side offers both.
    l = sized(left, "ll", "rl").withColumn("head", head)
    r = sized(right, "rl", "ll")
    if prefix:
        r = r.withColumn("head", F.when(F.col("ll") >= 4, prefix).otherwise(1)).where(n >= F.col("head"))
    else:
        r = r.withColumn("head", F.lit(0))
    keys = [*scope, "ll", "rl", "i", "key"]

    def tail_key(start: Column, width: Column) -> Column:
        return F.concat(F.substring(value, F.lit(1), F.col("head")), F.lit("\u0001"), F.substring(value, start + 1, width))

    right_keys = r.select(
        *scope, "value", "ll", "rl", "head",
        F.explode(_pieces(F.col("rl") - F.col("head"), F.col("edits"))).alias("p"),
    ).select(
        *scope, F.col("value").alias("value_right"), "ll", "rl", F.col("p.i").alias("i"),
        tail_key(F.col("head") + F.col("p.start"), F.col("p.width")).alias("key"),
    )
    gap = F.col("ll") - F.col("rl")
    back, forth = F.floor((F.col("edits") - gap) / 2), F.floor((F.col("edits") + gap) / 2)
    left_keys = (
        l.select(
            *scope, "value", "ll", "rl", "head", "edits",
            F.explode(_pieces(F.col("rl") - F.col("head"), F.col("edits"))).alias("p"),
        )
        .withColumn("shift", F.explode(F.sequence((-back).cast("int"), forth.cast("int"))))
        .withColumn("at", F.col("p.start") + F.col("shift"))
        .where((F.col("at") >= 0) & (F.col("at") + F.col("p.width") <= F.col("ll") - F.col("head")))
        .select(
            *scope, F.col("value").alias("value_left"), "ll", "rl", F.col("p.i").alias("i"),
            tail_key(F.col("head") + F.col("at"), F.col("p.width")).alias("key"),
        )
        .distinct()
    )
    # An edit costs no more than an insert and a delete, so the edit distance obeys the same
    # bound; it is worked out in the JVM and stops at the bound.
    most = allowed_edits(F.length("value_left") + F.length("value_right"), threshold)
    return (
        left_keys.join(right_keys, keys)
        .where(F.col("value_left") != F.col("value_right"))
        .select(*scope, "value_left", "value_right").distinct()
        .withColumn("most", most).where("levenshtein(value_left, value_right, most) >= 0").drop("most")
    )
