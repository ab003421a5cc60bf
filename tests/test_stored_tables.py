"""Substring index and keyed tables against plain scans."""

import collections
import os
import random

from pyspark.sql import functions as F

from lexloom.operators.keyed import KeyedTable
from lexloom.operators.substring import SubstringIndex, build


def test_substrings_equal_contains(spark, tmp_path):
    rng = random.Random(3)
    texts = sorted({"".join(rng.choice("աբգde'% ") for _ in range(rng.randint(1, 12))) for _ in range(400)})
    frame = spark.createDataFrame([(t,) for t in [*texts, texts[0], "", None]], "form string")
    build(frame, "form", str(tmp_path / "index"), buckets=8)
    index = SubstringIndex(spark, str(tmp_path / "index"), buckets=8)
    needles = ["ա", "de", "աբգ", "de'%", "% ", texts[7], texts[9][:4], "zzz", "աբzգ", "no such text at all"]
    for needle in needles[:3] + needles[-2:] + [""]:
        assert collections.Counter(r.text for r in index.find(needle).collect()) == collections.Counter(t for t in texts if needle in t)
    many = index.find_many(spark.createDataFrame([(n,) for n in [*needles, needles[0], "", None]], "needle string"))
    want = collections.Counter((n, t) for n in set(needles) for t in texts if n in t)
    assert collections.Counter((r.needle, r.text) for r in many.collect()) == want


def test_search_reads_one_gram(spark, tmp_path):
    frame = spark.range(3000).select(F.concat(F.lit("w"), F.hex(F.xxhash64("id"))).alias("form"))
    build(frame, "form", str(tmp_path))
    found = SubstringIndex(spark, str(tmp_path)).find("A7B")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "EqualTo(gram,A7B)" in plan and "Exchange" not in plan


def _files(path):
    return {d: sorted(f for f in os.listdir(path / d) if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("bucket=")}


def test_keyed_updates_touch_their_folders(spark, tmp_path):
    rows = [("o", f"k{n % 50}", n) for n in range(120)] + [(None, "k1", 7), ("o", None, 8)]
    schema = "owner string, k string, n bigint"
    table = KeyedTable.create(spark.createDataFrame(rows, schema), str(tmp_path), ["owner", "k"], buckets=16)
    bag = lambda df: collections.Counter(map(tuple, df.collect()))
    assert bag(table.read()) == collections.Counter(rows)
    assert bag(table.lookup(owner="o", k="k3")) == collections.Counter(r for r in rows if r[:2] == ("o", "k3"))
    assert bag(table.lookup(owner=None, k="k1")) == collections.Counter({(None, "k1", 7): 1})
    assert bag(table.lookup_many(spark.createDataFrame([("o", "k4", 0), ("o", None, 0), ("x", "k1", 0)], schema))) == collections.Counter(r for r in rows if r[1] in ("k4", None))
    before, new = _files(tmp_path), spark.createDataFrame([("o", "k3", -1)], schema)
    for _ in range(2):  # a repeated run gives the same table
        assert len(table.replace(new)) == 1
        want = [r for r in rows if r[:2] != ("o", "k3")] + [("o", "k3", -1)]
        assert bag(table.read()) == collections.Counter(want)
    after = _files(tmp_path)
    assert sum(before[d] != after[d] for d in before) == 1 and set(before) == set(after) and len(before) == 16
    table.delete(spark.createDataFrame([(r[0], r[1], 0) for r in rows], schema))
    assert table.read().count() == 0
    table.replace(new, spark.createDataFrame([("o", "k9", 0)], schema))
    assert bag(table.read()) == collections.Counter({("o", "k3", -1): 1})


def test_lookup_reads_one_folder(spark, tmp_path):
    frame = spark.range(5000).select(F.lit("o").alias("owner"), F.hex("id").alias("k"), "id")
    table = KeyedTable.create(frame, str(tmp_path), ["owner", "k"], buckets=32)
    found = table.lookup(owner="o", k="7D0")
    assert [r.id for r in found.collect()] == [2000]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,7D0)" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
