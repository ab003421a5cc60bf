"""Stored listings whose deep pages are read from one range of their order (LEX-13, OCC-4, CUR-7).

Rows are dealt by sampled splitters into ranges of one order, scope first, each range a folder.
Beside them stands a table with the rows that every scope has in every range and in the ranges
before it. A page at any offset is found in that table; then its ranges alone are read and sorted,
so the cost of page ten million is that of the first. Totals come from the same table.

The order has to be total (end it with a column that tells rows apart), else rows that tie change
places between runs. Ties of the whole order share a range, however many they are. Nulls stand
where Spark puts them: first when ascending, last when descending. A scope without rows has no
page and no total; a page beyond the end is empty or short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

#: Rows of a range on average; a range is sorted by one task.
RANGE_ROWS = 200_000


class PagedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, scope: list[str], order: list[tuple[str, bool]]) -> None:
        """``order``: columns and whether each descends."""
        self.spark, self.path, self.schema, self.scope, self.order = spark, path.rstrip("/"), schema, list(scope), list(order)

    @classmethod
    def create(cls, rows: DataFrame, path: str, scope: list[str], order: list[tuple[str, bool]], range_rows: int = RANGE_ROWS) -> PagedTable:
        """Write all (stored) rows as a new table; they are counted, sampled and then dealt."""
        table = cls(rows.sparkSession, path, rows.schema, scope, order)
        ranges = -(-max(1, rows.count()) // range_rows)
        sort = [*[F.col(c) for c in scope], *table._sort()]
        dealt = rows.repartitionByRange(ranges, *sort).withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *sort)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part").parquet(f"{table.path}/rows")
        counts = table._stored().groupBy(*scope, "part").agg(F.count("*").alias("n"))
        # One row for each range that a scope reaches.
        before = F.sum("n").over(Window.partitionBy(*scope).orderBy("part")) - F.col("n")
        counts.withColumn("before", before).write.mode("overwrite").parquet(f"{table.path}/counts")
        return table

    def _sort(self) -> list[Column]:
        return [F.col(c).desc() if down else F.col(c).asc() for c, down in self.order]

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("part", T.IntegerType())])).parquet(f"{self.path}/rows")

    def _counts(self) -> DataFrame:
        fields = [*[self.schema[c] for c in self.scope], *[T.StructField(c, t) for c, t in (("part", T.IntegerType()), ("n", T.LongType()), ("before", T.LongType()))]]
        return self.spark.read.schema(T.StructType(fields)).parquet(f"{self.path}/counts")

    def _same(self, left: DataFrame, right: DataFrame) -> Column:
        """Equal scopes, nulls included, of a table and one whose scope columns are marked."""
        return reduce(lambda a, c: a & left[c].eqNullSafe(right[f"k_{c}"]), self.scope, F.lit(True))

    def totals(self) -> DataFrame:
        """Rows of every scope."""
        return self._counts().groupBy(*self.scope).agg(F.sum("n").alias("total"))

    def page(self, limit: int, offset: int = 0, **scope) -> DataFrame:
        """One page of one scope, in order, with ``place`` from one."""
        found = self._counts().where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
        rows = self._stored()
        for name in self.scope:
            same = F.col(name).eqNullSafe(F.lit(scope[name]).cast(self.schema[name].dataType))
            found, rows = found.where(same), rows.where(same)
        # The ranges of one page: one or two, unless the page is larger than a range.
        parts = sorted((r.part, r.before) for r in found.select("part", "before").collect())
        first = parts[0][1] if parts else 0
        cut = rows.where(F.col("part").isin([p for p, _ in parts])).orderBy(*self._sort()).limit(offset - first + limit)
        placed = cut.withColumn("place", F.row_number().over(Window.orderBy(*self._sort())) + F.lit(first))
        return placed.where(F.col("place") > offset).select(*self.schema.names, F.col("place").cast("bigint").alias("place")).orderBy("place")

    def pages(self, requests: DataFrame) -> DataFrame:
        """Rows of many pages with ``place``, unordered; requests: scope columns, ``offset`` and ``size``.

        Ranges without a request are not read; rows that several requests ask for come once for each.
        """
        wanted = requests.select(*[F.col(c).alias(f"k_{c}") for c in self.scope], "offset", "size")
        counts = self._counts()
        meets = self._same(counts, wanted) & (counts["before"] < wanted["offset"] + wanted["size"]) & (counts["before"] + counts["n"] > wanted["offset"])
        asked = counts.join(wanted, meets).select(*[f"k_{c}" for c in self.scope], F.col("part").alias("k_part"), "before", "offset", "size")
        # At most as many numbers as there are ranges.
        parts = sorted(r.k_part for r in asked.select("k_part").distinct().collect())
        rows = self._stored().where(F.col("part").isin(parts))
        placed = rows.withColumn("at", F.row_number().over(Window.partitionBy(*self.scope, "part").orderBy(*self._sort())))
        place = F.col("before") + F.col("at")
        inside = (place > F.col("offset")) & (place <= F.col("offset") + F.col("size"))
        hits = placed.join(asked, self._same(placed, asked) & (placed["part"] == asked["k_part"]) & inside)
        return hits.select(*self.schema.names, place.cast("bigint").alias("place"))
