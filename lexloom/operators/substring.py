"""Substring search over distinct texts: a stored posting table of short grams (LEX-11, CUR-6, REF-13).

Every distinct text has one row for each distinct gram of one to three characters. The table is cut
into folders by a hash of the gram and sorted by gram, so that a search reads the folder and the
row groups of one gram: the rarest three-character gram of its needle, or the needle itself when it
is shorter. What the gram finds is verified against the whole needle, so the result is that of
``contains`` on all texts. A gram that most texts share spreads over several files.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GRAM = 3
BUCKETS = 64


def _grams(text: Column) -> Column:
    """Distinct grams of one to ``GRAM`` characters."""
    def of(size: int) -> Column:
        places = F.sequence(F.lit(1), F.length(text) - size + 1)
        cut = F.transform(places, lambda i: F.substring(text, i, F.lit(size)))
        return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in range(1, GRAM + 1)]))


def _bucket(gram: Column, buckets: int) -> Column:
    return (F.crc32(gram.cast("binary")) % buckets).cast("int")


def needle_grams(needle: str) -> list[str]:
    """Grams that a text with the needle must have: of full size, or the needle when it is shorter."""
    return sorted({needle[i:i + GRAM] for i in range(max(1, len(needle) - GRAM + 1))})


def build(texts: DataFrame, column: str, path: str, buckets: int = BUCKETS) -> None:
    """Write postings and gram counts of the distinct values of a column; null and empty values are left out."""
    distinct = texts.select(F.col(column).alias("text")).where("text <> ''").distinct()
    rows = distinct.select(F.explode(_grams(F.col("text"))).alias("gram"), "text").withColumn("bucket", _bucket(F.col("gram"), buckets))
    placed = rows.repartitionByRange("bucket", "gram", "text").sortWithinPartitions("bucket", "gram")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = distinct.sparkSession.read.schema("gram string, text string, bucket int").parquet(f"{path}/postings")
    counts = stored.groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")


class SubstringIndex:
    """A posting table written by ``build``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, text string, bucket int").parquet(f"{self.path}/postings")

    def counts(self) -> DataFrame:
        return self.spark.read.schema("gram string, n bigint, bucket int").parquet(f"{self.path}/counts")

    def _of(self, rows: DataFrame, grams: list[str]) -> DataFrame:
        buckets = sorted({zlib.crc32(g.encode()) % self.buckets for g in grams})
        return rows.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))

    def find(self, needle: str) -> DataFrame:
        """``text`` of every distinct text that contains the needle; an empty needle finds all texts."""
        if not needle:
            return self.postings().where(F.length("gram") == 1).select("text").distinct()
        grams = needle_grams(needle)
        known = {r.gram: r.n for r in self._of(self.counts(), grams).collect()}  # a row for each gram of the needle
        rarest = min(grams, key=lambda g: (known.get(g, 0), g))
        return self._of(self.postings(), [rarest]).where(F.contains("text", F.lit(needle))).select("text")

    def find_many(self, needles: DataFrame) -> DataFrame:
        """(needle, text) for every distinct non-empty value of ``needle``."""
        size = F.length("needle")
        places = F.sequence(F.lit(1), F.greatest(size - GRAM + 1, F.lit(1)))
        parts = needles.select("needle").where("needle <> ''").distinct().select(
            "needle", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring("needle", i, F.lit(GRAM))))).alias("gram")
        ).withColumn("bucket", _bucket(F.col("gram"), self.buckets))
        weighed = parts.join(self.counts(), ["bucket", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
        best = weighed.groupBy("needle").agg(F.min_by(F.struct("bucket", "gram"), F.struct("n", "gram")).alias("g"), F.min("n").alias("n"))
        wanted = best.where("n > 0").select("needle", "g.bucket", "g.gram")
        return self.postings().join(wanted, ["bucket", "gram"]).where(F.contains("text", F.col("needle"))).select("needle", "text")
