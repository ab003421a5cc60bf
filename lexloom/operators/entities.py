"""Named-entity dictionary and annotated-corpus index (NER)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.functions import text as tx
from lexloom.operators.lexicon import first_values

ENTITY_TYPES = ("PER", "ORG", "LOC")
CONTEXT_LIMIT = 5
GOLD_CONFIDENCE, SILVER_CONFIDENCE = 0.85, 0.55


def spans(tokens: Column, labels: Column) -> Column:
    """NER-1: array of (surface, entity_type) in a sentence.

    ``B`` or a change of type starts a span, ``I`` continues it, a bare label
    counts as ``B``; any other prefix of the same type ends it.
    """
    tagged = F.transform(
        F.arrays_zip(tokens.alias("token"), labels.alias("label")),
        lambda x: F.struct(
            x["token"].alias("token"),
            tx.strip(F.coalesce(x["label"], F.lit(""))).alias("label"),
        ),
    )
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<struct<surface:string,entity_type:string>>")

    def closed(acc: Column) -> Column:
        return F.when(
            acc["kind"].isNotNull(),
            F.concat(acc["done"], F.array(F.struct(acc["words"].alias("surface"), acc["kind"].alias("entity_type")))),
        ).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        label = x["label"]
        dashed = F.contains(label, F.lit("-"))
        prefix = F.when(dashed, F.substring_index(label, "-", 1)).otherwise("B")
        kind = F.upper(F.when(dashed, F.regexp_replace(label, "^[^-]*-", "")).otherwise(label))
        outside = (label == "O") | (label == "")
        starts = ~outside & ((prefix == "B") | ~F.coalesce(acc["kind"] == kind, F.lit(False)))
        goes_on = ~outside & ~starts & (prefix == "I")
        return F.struct(
            F.when(goes_on, acc["done"]).otherwise(closed(acc)).alias("done"),
            F.when(goes_on, F.concat(acc["words"], F.lit(" "), x["token"])).when(starts, x["token"]).otherwise(none).alias("words"),
            F.when(goes_on | starts, kind).otherwise(none).alias("kind"),
        )

    start = F.struct(empty.alias("done"), none.alias("words"), none.alias("kind"))
    return F.aggregate(tagged, start, step, closed)


def mentions(sentences: DataFrame) -> DataFrame:
    """NER-1 on a table (source_id, seq, tokens, labels): one row per entity span."""
    return sentences.select(
        "source_id", "seq", F.array_join("tokens", " ").alias("context"),
        F.posexplode(spans(F.col("tokens"), F.col("labels"))).alias("pos", "span"),
    ).select(
        "source_id", "seq", "pos", "context", F.col("span.surface").alias("entity_surface"),
        tx.normalize_token(F.col("span.surface")).alias("normalized_surface"),
        F.col("span.entity_type").alias("entity_type"),
    )


def supported(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("normalized_surface") != "") & F.col("entity_type").isin(*ENTITY_TYPES))


def entity_dictionary(found: DataFrame, sources: DataFrame) -> DataFrame:
    """NER-2: entries per source, surface and type with count, first surface and contexts."""
    key = ["source_id", "normalized_surface", "entity_type"]
    rows = supported(found)
    order = F.struct("seq", "pos")
    counts = rows.groupBy(*key).agg(
        F.count("*").alias("occurrence_count"), F.min_by("entity_surface", order).alias("entity_surface")
    )
    contexts = first_values(rows, key, {"sample_contexts": F.col("context")}, order, CONTEXT_LIMIT)
    return counts.join(contexts, key).join(sources.select("source_id", "source_kind"), "source_id").select(
        *key, "entity_surface", "occurrence_count", source_confidence(F.col("source_kind")).alias("confidence"), "sample_contexts"
    )


def source_confidence(kind: Column) -> Column:
    return F.when(kind == "gold", GOLD_CONFIDENCE).otherwise(SILVER_CONFIDENCE)


def import_summary(sentences: DataFrame, found: DataFrame) -> DataFrame:
    """NER-3: sentences, entities, entries and skipped spans per source."""
    ok = (F.col("normalized_surface") != "") & F.col("entity_type").isin(*ENTITY_TYPES)
    entry = F.when(ok, F.struct("normalized_surface", "entity_type"))
    spans_ = found.groupBy("source_id").agg(
        F.count_if(ok).alias("entity_count"), F.count_if(~ok).alias("skipped_entity_count"),
        F.count_distinct(entry).alias("entry_count"),
    )
    total = sentences.groupBy("source_id").agg(F.count("*").alias("sentence_count"))
    zero = F.lit(0).cast("bigint")
    return total.join(spans_, "source_id", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("entity_count", "skipped_entity_count", "entry_count")}
    )


def type_counts(entries: DataFrame) -> DataFrame:
    """NER-3: dictionary entries by type."""
    return entries.groupBy("source_id", "entity_type").agg(F.count("*").alias("entries"))


# Annotated corpus ------------------------------------------------------------------


def corpus_index(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """NER-4: (surface, lemma) counts and lemma totals, each with distinct sources.

    ``tokens``: source_id, surface, lemma, both normalized.
    """
    per_source = tokens.groupBy("surface", "lemma", "source_id").agg(F.count("*").alias("n"))
    by_surface = per_source.groupBy("surface", "lemma").agg(
        F.sum("n").alias("token_count"), F.count("*").alias("source_count")
    )
    by_lemma = per_source.groupBy("lemma", "source_id").agg(F.sum("n").alias("n")).groupBy("lemma").agg(
        F.sum("n").alias("token_count"), F.count("*").alias("source_count")
    )
    return by_surface, by_lemma


def corpus_lookup(queries: DataFrame, by_surface: DataFrame, by_lemma: DataFrame, limit: int | None = None) -> DataFrame:
    """NER-5: ranked lemmas of a form by count; a form without any is looked up as a lemma itself.

    Readers of a kept table apply their own limits to ``lemma_rank``.

    ``queries``: normalized_form, distinct.
    """
    order = Window.partitionBy("surface").orderBy(F.col("token_count").desc(), "lemma")
    ranked = by_surface.withColumn("lemma_rank", F.row_number().over(order))
    top = ranked if limit is None else ranked.where(F.col("lemma_rank") <= limit)
    direct = queries.join(top, F.col("normalized_form") == F.col("surface")).drop("surface")
    rest = queries.join(by_surface.select(F.col("surface").alias("normalized_form")).distinct(), "normalized_form", "left_anti")
    as_lemma = rest.join(by_lemma, F.col("normalized_form") == F.col("lemma")).withColumn("lemma_rank", F.lit(1))
    cols = ["normalized_form", "lemma", "token_count", "source_count", "lemma_rank"]
    return direct.select(*cols).unionByName(as_lemma.select(*cols))
