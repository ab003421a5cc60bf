"""Stored tables with point lookups and updates by key (SNK-4, SNK-5, SNK-7, REF-12).

Rows lie in folders by a hash of their key and are sorted by key inside, with Bloom filters on the
key columns. A lookup reads one folder, and there the row groups whose bounds and filters admit the
key. An update finds the folders of the changed keys first, reads those and writes them again by
Spark's dynamic partition overwrite; the others are not touched. Updates replace whole keys, so one
that runs again, also after it was cut off half way, gives the same table. One writer at a time.

Spark leaves a folder alone when nothing is written into it. So every write puts one row that is
not ``live`` into each folder that it touches: a folder that loses its last key is written too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

BUCKETS = 64


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, list(key), buckets

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> KeyedTable:
        """Write all rows as a new table; a null in a key column is a value like any other."""
        table = cls(rows.sparkSession, path, rows.schema, key, buckets)
        table._write(rows, list(range(buckets)), "overwrite")
        return table

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("live", T.BooleanType()), T.StructField("bucket", T.IntegerType())])
        for field in schema.fields:
            field.nullable = True
        return self.spark.read.schema(schema).parquet(self.path)

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.where("live").select(self.schema.names)

    def _write(self, rows: DataFrame, touched: list[int], mode: str = "overwrite") -> None:
        placed = rows.select(self.schema.names).withColumns({"live": F.lit(True), "bucket": self._bucket()})
        marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int").select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], F.lit(False).alias("live"), "bucket"
        )
        # Large folders are split over several tasks, small ones share one.
        dealt = placed.unionByName(marks).hint("rebalance", "bucket").sortWithinPartitions("bucket", *self.key)
        out = dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket")
        for name in self.key:
            out = out.option(f"parquet.bloom.filter.enabled#{name}", "true")
        out.parquet(self.path)
        self.spark.catalog.refreshByPath(self.path)

    def read(self) -> DataFrame:
        return self._live(self._stored())

    def touched(self, keys: DataFrame) -> list[int]:
        """Folders of the keys: at most ``buckets`` numbers."""
        return sorted(r.b for r in keys.select(self._bucket().alias("b")).distinct().collect())

    def _same(self, left: DataFrame, right: DataFrame) -> Column:
        """Equal keys, nulls included, of a table and one whose key columns are marked."""
        out = F.lit(True)
        for name in self.key:
            out = out & left[name].eqNullSafe(right[f"k_{name}"])
        return out

    def _marked(self, keys: DataFrame) -> DataFrame:
        return keys.select(*[F.col(c).alias(f"k_{c}") for c in self.key]).distinct()

    def lookup(self, **values) -> DataFrame:
        """Rows of one key."""
        one = self.spark.range(1).select(*[F.lit(values[c]).cast(self.schema[c].dataType).alias(c) for c in self.key])
        rows = self._stored().where(F.col("bucket") == self.touched(one)[0])
        for name in self.key:
            rows = rows.where(F.col(name) == F.lit(values[name]) if values[name] is not None else F.col(name).isNull())
        return self._live(rows)

    def lookup_many(self, keys: DataFrame) -> DataFrame:
        """Rows of all given keys; reads their folders only."""
        rows, wanted = self._stored().where(F.col("bucket").isin(self.touched(keys))), self._marked(keys)
        return self._live(rows.join(wanted, self._same(rows, wanted), "left_semi"))

    def replace(self, new: DataFrame, scopes: DataFrame | None = None) -> list[int]:
        """Everything under the keys of ``scopes`` (by default those of ``new``) goes, new rows come in; the folders written."""
        scopes = new if scopes is None else scopes
        gone = scopes.select(self.key).unionByName(new.select(self.key))
        touched = self.touched(gone)
        if touched:
            old, keys = self._stored().where(F.col("bucket").isin(touched)), self._marked(gone)
            kept = self._live(old.join(keys, self._same(old, keys), "left_anti"))
            self._write(kept.unionByName(new.select(self.schema.names)), touched)
        return touched

    def delete(self, keys: DataFrame) -> list[int]:
        return self.replace(self.read().limit(0), keys)
