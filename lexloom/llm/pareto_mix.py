"""Mixing sources to target weights by Pareto order sampling.

Targets: sources share the mix by weight; a target stops at ``cap`` times its source's size
and the excess goes to the others by weight. Copies: within a source a document of size s is
worth c * s**power expected copies, at most ``cap``, where c is solved so that the expected
words meet the target. The whole copies are certain. For the fraction p that is left, the
document is ranked by (u / (1 - u)) / (p / (1 - p)) with a uniform u, and the documents of
lowest rank are taken until the source's remaining words are reached: a sample of fixed size
(in words) with unequal inclusion probabilities. What is missing then, less than the document at
the cut, is closed by the one document left out whose size comes nearest to it.

Nothing depends on one task holding a source. c comes from sums per (source, size class), of
which there are a bounded number. The cut comes from two rounds of sums over a fixed grid of
rank cells, and only the last cell's rows are ordered.

u comes from a hash of seed, id, source and text, so reruns agree whatever the partitions.

Defined cases: a null text has size 0 and takes 0 words; a null source is a source of its
own, last in order; rows equal in id, source and text are counted together and share what
is taken copy by copy; an empty table gives an empty result; other columns are ignored, or
carried by ``mixed``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom import session
from lexloom.llm.golay import fresh

WORD = r"[^\x20\x09-\x0D]+"
GRID = 1 << 12


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # for the sources in order, repeating
    cap: int = 3  # most copies of a document, and of a source
    share: float = 1.0  # size of the mix against the size of all documents
    power: float = 0.25  # how expected copies grow with a document's size
    classes: int = 8  # size classes for each doubling of the size
    seed: int = 11


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``target`` to a table with one row for each ``source`` and its ``source_size``.

    The reshared excess ends where the sources with the least room for their weight are at
    their caps and the others share the rest. Sorted by room, the level of the others rises
    with every source that is rightly capped and falls after, so the highest is the answer.
    The windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(mix.weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("room", mix.cap * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("room", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("room", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("level", (mix.share * F.sum("source_size").over(all_rows) - F.coalesce(mix.cap * F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after))
    final = F.max("level").over(all_rows)
    return rows.withColumn("target", F.least(F.col("weight") * final, (mix.cap * F.col("source_size")).cast("double"))).select("source", "source_size", "target")


def _copies(units: DataFrame, mix: Mix) -> DataFrame:
    """Per (source, size class): source_size, target, expected copies of a document."""
    sums = units.where("size > 0").groupBy("source", "class").agg(F.sum(F.col("size") * F.col("times")).alias("words")).withColumnRenamed("source", "_s")
    sized = units.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"))
    goal = targets(sized, mix)
    held = goal.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    held = held.withColumn("worth", F.pow(F.lit(2.0), F.col("class") * (mix.power / mix.classes)))
    own = Window.partitionBy("source").orderBy(F.col("class").desc())
    before, after = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(0, Window.unboundedFollowing)
    # The classes of most worth reach the cap first: with the k first at the cap, c is what the rest needs.
    need = F.col("target") - F.coalesce(mix.cap * F.sum("words").over(before), F.lit(0))
    held = held.withColumn("c", need / F.sum(F.col("words") * F.col("worth")).over(after))
    # As with targets, the highest c is the answer.
    c = F.max("c").over(Window.partitionBy("source"))
    copies = F.round(F.least(F.lit(float(mix.cap)), F.greatest(F.lit(0.0), c * F.col("worth"))), 9)
    return held.select("source", "source_size", "target", "class", F.coalesce(copies, F.lit(0.0)).alias("copies"))


def _cell(value: Column, low: Column, width: Column) -> Column:
    return F.least(F.lit(GRID - 1), F.greatest(F.lit(0), F.floor((value - low) / width * GRID))).cast("int")


def _cut(rows: DataFrame, left: str, cell: str) -> DataFrame:
    """Per source: the cell in which the running words pass what is left, and what is left there."""
    sums = rows.groupBy("source", cell).agg(F.sum("weight").alias("words"), F.first(left).alias("left"))
    upto = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("words").over(upto))
    return sums.where("upto >= left").groupBy("source").agg(F.min_by(F.struct(F.col(cell).alias("at"), (F.col("left") - F.col("upto") + F.col("words")).alias("rest")), cell).alias("cut"))


def _with_cut(rows: DataFrame, cut: DataFrame, name: str) -> DataFrame:
    return rows.join(cut.select(F.col("source").alias("_s"), F.col("cut").alias(name)), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def sample(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """id, h1, h2, source, size, source_size, target, copies of every row; h1 and h2 are hashes of the text."""
    units = docs.select(
        F.col(key).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), F.col(text)).alias("h2"),
    ).groupBy("id", "source", "size", "h1", "h2").agg(F.count("*").alias("times"))
    units = units.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2("size") * mix.classes).cast("int")))
    units = session.save(units, "mix-units")
    worth = session.save(_copies(units, mix), "mix-copies")
    rows = units.alias("u").join(worth.alias("w"), F.expr("u.source <=> w.source and u.class <=> w.class"), "left").select("u.*", "w.source_size", "w.target", "w.copies")
    totals = worth.select(F.col("source").alias("_s"), F.col("source_size").alias("_n"), F.col("target").alias("_t")).distinct()
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "id", "source", "size", "h1", "h2", "times", F.coalesce("source_size", "_n").alias("source_size"), F.coalesce("target", "_t").alias("target"), F.coalesce("copies", F.lit(0.0)).alias("copies"),
    )
    u = (F.pmod(F.xxhash64(F.lit(mix.seed), "id", "source", "h1", "h2"), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    whole = F.floor(F.col("copies")).cast("int")
    rows = rows.withColumn("whole", whole).withColumn("p", F.col("copies") - F.col("whole"))
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    # odds / (1 + odds) keeps the order and lies in (0, 1)
    rows = rows.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), odds / (1 + odds))).withColumn("weight", F.col("size") * F.col("times"))
    rows = session.save(rows, "mix-rows")
    sure = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("weight") * F.col("whole"))).alias("left"))
    open_rows = _with_left(rows.where("rank is not null"), sure).withColumn("c1", _cell(F.col("rank"), F.lit(0.0), F.lit(1.0)))
    cut1 = session.save(_cut(open_rows, "left", "c1"), "mix-cut")
    inner = _with_cut(open_rows, cut1, "k1").where("c1 = k1.at").withColumn("rest", F.col("k1.rest"))
    inner = inner.withColumn("c2", _cell(F.col("rank"), F.col("c1") / GRID, F.lit(1.0 / GRID)))
    cut2 = session.save(_cut(inner, "rest", "c2"), "mix-cut")
    last = _with_cut(inner, cut2, "k2").where("c2 = k2.at")
    upto = Window.partitionBy("source").orderBy("rank", "id", "h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("room", F.col("k2.rest") - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    fit = F.least(F.col("times"), F.greatest(F.lit(0), F.floor(F.col("room") / F.col("size")))).cast("long")
    last = last.select("id", "source", "h1", "h2", fit.alias("fit"))
    marked = _with_cut(_with_cut(rows, cut1, "k1"), cut2, "k2").alias("r").join(last.alias("l"), F.expr("r.id <=> l.id and r.source <=> l.source and r.h1 = l.h1 and r.h2 = l.h2"), "left").select("r.*", "l.fit")
    c1 = _cell(F.col("rank"), F.lit(0.0), F.lit(1.0))
    c2 = _cell(F.col("rank"), c1 / GRID, F.lit(1.0 / GRID))
    below = F.col("k1").isNull() | (c1 < F.col("k1.at")) | ((c1 == F.col("k1.at")) & (F.col("k2").isNull() | (c2 < F.col("k2.at"))))
    extra = F.when(F.col("rank").isNull(), 0).when(F.col("fit").isNotNull(), F.col("fit")).when(below, F.col("times")).otherwise(0)
    taken = session.save(marked.select(*UNIT, "source_size", "target", "times", "whole", "rank", extra.cast("long").alias("extra")), "mix-taken")
    return _closed(taken, mix)


UNIT = ("id", "h1", "h2", "source", "size")


def _closed(taken: DataFrame, mix: Mix) -> DataFrame:
    """Adds to every source the one document left out whose size comes nearest to what is missing."""
    words = F.col("size") * (F.col("times") * F.col("whole") + F.col("extra"))
    gap = taken.groupBy("source").agg((F.first("target") - F.sum(words)).alias("left"))
    off = F.abs(F.col("size") - F.col("left"))
    out = _with_left(taken.where((F.col("extra") < F.col("times")) & (F.col("whole") < mix.cap) & (F.col("size") > 0)), gap).where(off < F.col("left"))
    best = out.groupBy("source").agg(F.min_by(F.struct("id", "h1", "h2"), F.struct(off, "rank", "id", "h1", "h2")).alias("add"))
    held = taken.join(best.select(F.col("source").alias("_s"), "add"), F.col("source").eqNullSafe(F.col("_s")), "left")
    mine = F.coalesce(F.struct("id", "h1", "h2").eqNullSafe(F.col("add")), F.lit(False)) & F.col("add").isNotNull()
    return held.select(*UNIT, "source_size", "target", "times", "whole", (F.col("extra") + mine.cast("int")).alias("extra"))


def _with_left(rows: DataFrame, sure: DataFrame) -> DataFrame:
    return rows.join(sure.select(F.col("source").alias("_s"), "left"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def one_by_one(units: DataFrame) -> DataFrame:
    """The rows that equal rows stand for, each with its ``copies``."""
    step = 4096
    blocks = units.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / step))))
    in_block = F.least(F.lit(step), F.col("times") - F.col("b") * step)
    each = blocks.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), in_block - 1)))
    return each.withColumn("copies", F.col("whole") + (F.col("b") * step + F.col("i") < F.col("extra")).cast("int")).drop("b", "i")


def mixed(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row as often as it is taken, with all its columns."""
    h1, h2, n, e, at, id_, src, x1, x2, times = (fresh(docs, x) for x in ("h1", "h2", "n", "e", "at", "id_", "src", "x1", "x2", "times"))
    got = sample(docs, mix, key, text, source).where("size > 0 and (whole > 0 or extra > 0)")
    plans = got.select(*(F.col(a).alias(b) for a, b in (("id", id_), ("source", src), ("h1", x1), ("h2", x2), ("times", times), ("whole", n), ("extra", e))))
    keyed = docs.withColumns({h1: F.xxhash64(text), h2: F.xxhash64(F.lit(7), F.col(text))})
    on = F.col(key).eqNullSafe(F.col(id_)) & F.col(source).eqNullSafe(F.col(src)) & (F.col(h1) == F.col(x1)) & (F.col(h2) == F.col(x2))
    held = keyed.join(plans, on)
    # Only rows that are repeated and of which a part is taken need a number.
    single = held.where((F.col(times) == 1) | (F.col(e) == 0) | (F.col(e) == F.col(times))).withColumn(at, F.col(n) + (F.col(e) > 0).cast("int"))
    parts = session.save(held.where((F.col(times) > 1) & (F.col(e) > 0) & (F.col(e) < F.col(times))), "mix-parts")
    if not parts.isEmpty():
        own = Window.partitionBy(id_, src, x1, x2).orderBy(F.lit(0))
        single = single.unionByName(parts.withColumn(at, F.col(n) + (F.row_number().over(own) <= F.col(e)).cast("int")))
    return single.where(F.col(at) > 0).withColumn(at, F.explode(F.sequence(F.lit(1), F.col(at)))).select(*docs.columns)
