"""Line dedup by distinct-site spread, in DataFrame operations only.

Every line hash gets a HyperLogLog sketch of the sites that show it; sketches merge in the
aggregation, so a line on every page of the corpus still shuffles one sketch a task. Lines
whose estimate lies clear of the threshold are decided by it. Lines near the threshold, by
five standard errors, get an exact count of distinct sites. Lines on ``min_sites`` sites or
more are boilerplate, and all their occurrences are removed.

Lines are compared without white space at their ends, by two independent 64-bit hashes. Blank
lines are no lines in this sense: they are never counted or removed. What is removed from a
text depends on the text alone, so equal texts are one row in the join that brings line
numbers back, and documents are never regrouped from their lines.

Defined cases: a null text has no lines and stays null; a null site is a site of its own;
repeated rows and ties are treated alike; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import session
from lexloom.functions import text as tx

ENDS = " \t\r\x0b\x0c"
LINE = ("h1", "h2")
TEXT = ("t1", "t2")


def _hashes(value: Column, names: tuple[str, str]) -> list[Column]:
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(7), value).alias(names[1])]


def lines(docs: DataFrame, site: str = "source", text: str = "text") -> DataFrame:
    """t1, t2 (the text), site, at (line number), h1, h2 (the line) of every line that isn't blank."""
    rows = docs.select(*_hashes(F.col(text), TEXT), F.xxhash64(site).alias("site"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(ENDS))).where("line <> ''")
    return rows.select(*TEXT, "site", "at", *_hashes(F.col("line"), LINE))


def boilerplate(found: DataFrame, min_sites: int = 10, precision: int = 12) -> DataFrame:
    """h1, h2 of the lines shown by at least ``min_sites`` sites."""
    margin = max(1, math.ceil(5 * 1.04 / math.sqrt(1 << precision) * min_sites))
    spread = found.groupBy(*LINE).agg(F.hll_sketch_agg("site", F.lit(precision)).alias("sketch"))
    spread = spread.select(*LINE, F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - margin)
    spread = session.save(spread, "line-spread")
    near = spread.where(F.col("sites") <= min_sites + margin).select(*LINE)
    exact = found.join(near, list(LINE), "left_semi").groupBy(*LINE).agg(F.countDistinct("site").alias("sites"))
    return spread.where(F.col("sites") > min_sites + margin).select(*LINE).union(exact.where(F.col("sites") >= min_sites).select(*LINE))


def without_boilerplate(docs: DataFrame, min_sites: int = 10, key: str = "doc_id", site: str = "source", text: str = "text", precision: int = 12) -> DataFrame:
    """key, n_lines, n_removed and the text that is left, of every row."""
    found = session.save(lines(docs, site, text), "lines")
    marks = found.select(*TEXT, "at", *LINE).join(boilerplate(found, min_sites, precision), list(LINE), "left_semi")
    gone = marks.groupBy(*TEXT).agg(F.collect_set("at").alias("gone"))
    rows = docs.select(F.col(key), F.col(text).alias("text"), *_hashes(F.col(text), TEXT)).join(gone, list(TEXT), "left")
    all_lines = F.split("text", "\n")
    # The set difference hashes the positions and the lines are split once, so a text costs time in line with its length.
    kept = tx.bind(all_lines, lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "gone"), lambda at: F.get(ls, at)), "\n"))
    return rows.select(
        key,
        F.when(F.col("text").isNull(), 0).otherwise(F.size(all_lines)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )


SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), t AS (SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS core FROM l),
b AS (SELECT core FROM t WHERE core <> '' GROUP BY core HAVING count(DISTINCT coalesce(source, '<none>')) >= 10)
SELECT d.doc_id, coalesce(len(string_split(any_value(d.text), chr(10))), 0)::BIGINT AS n_lines,
  count(b.core)::BIGINT AS n_removed,
  CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE coalesce(string_agg(t.line, chr(10) ORDER BY t.pos) FILTER (WHERE b.core IS NULL), '') END AS text
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN b ON b.core = t.core
GROUP BY d.doc_id
"""
