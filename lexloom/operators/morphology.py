"""Morphology rows around an external tagger (MOR)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.functions import text as tx

MAX_SEQUENCES, MAX_TOKENS = 8, 256
BLANK_VALUES = ("", "_", "-")


def document_tokens(occ: DataFrame) -> DataFrame:
    """MOR-1: words of documents in order, one sequence per page."""
    return occ.select(
        "owner_id", "document_id", "page_id", "page_number", F.lit("imported_book").alias("source_type"),
        F.concat(F.lit("page:"), "page_id").alias("sequence_key"),
        F.col("char_start").alias("position"), F.col("token").alias("token_surface"),
        F.col("normalized_token").alias("token_normalized"), "has_armenian", "has_latin", "has_digits",
    )


def distinct_tokens(words: DataFrame, scope: list[str]) -> DataFrame:
    """MOR-1 for taggers that judge a word by itself: every word once per owner and scope, with its number of occurrences."""
    return words.groupBy(
        "owner_id", *scope, F.col("token").alias("token_surface"), F.col("normalized_token").alias("token_normalized"),
        "has_armenian", "has_latin", "has_digits",
    ).agg(F.count("*").alias("n"))


def slice_tokens(slices: DataFrame, stages: Column, key: list[str]) -> DataFrame:
    """The same from slices with ``spellings`` (``lexicon.slice_words``), one row per stage, token and ``key``; no text is read."""
    own = F.array(F.struct(F.col("normalized_form").alias("token"), F.col("occurrence_count").alias("n")))
    rows = slices.select(
        "owner_id", *key, F.explode(stages).alias("language_stage"), "normalized_form", F.coalesce("spellings", own).alias("spellings")
    ).select("owner_id", *key, "language_stage", "normalized_form", F.inline("spellings"))
    counted = rows.groupBy(
        "owner_id", *key, "language_stage", F.col("token").alias("token_surface"), F.col("normalized_form").alias("token_normalized")
    ).agg(F.sum("n").alias("n"))
    return with_flags(counted).select("owner_id", *key, "language_stage", "token_surface", "token_normalized", "has_armenian", "has_latin", "has_digits", "n")


def with_flags(rows: DataFrame) -> DataFrame:
    """What skip reasons ask of a token, as the occurrence table has it."""
    token = F.col("token_surface")
    plain = tx.plain_script(token)
    known = plain.isNotNull()
    return rows.withColumns({
        "has_armenian": F.when(known, plain == "armenian").otherwise(tx.has_primary(token)),
        "has_latin": F.when(known, plain == "latin").otherwise(tx.has_latin(token)),
        "has_digits": F.when(known, False).otherwise(tx.has_digits(token)),
    })


def entry_tokens(entries: DataFrame) -> DataFrame:
    """MOR-1: words of wordlist entries, one sequence per entry."""
    token = F.col("t.token")
    return (
        entries.select("owner_id", "source_id", "entry_id", F.explode(tx.token_spans(F.col("surface_form"))).alias("t"))
        .where(tx.is_word(token))
        .select(
            "owner_id", "source_id", "entry_id", F.lit("reference_source").alias("source_type"),
            F.concat(F.lit("entry:"), "entry_id").alias("sequence_key"), F.col("t.char_start").alias("position"),
            token.alias("token_surface"), tx.normalize_token(token).alias("token_normalized"),
            tx.has_primary(token).alias("has_armenian"), tx.has_latin(token).alias("has_latin"),
            tx.has_digits(token).alias("has_digits"),
        )
    )


def scope_eligible(profile: Column, stage: Column, model_key: str = "xcl", eastern_available: bool = True, only_classical: bool = True) -> Column:
    """MOR-2: whether a document or source is analyzed at all."""
    p, s = F.lower(tx.strip(F.coalesce(profile, F.lit("")))), F.lower(tx.strip(F.coalesce(stage, F.lit(""))))
    return (
        F.when((p == f"{model_key}_pie") | p.startswith("xcl"), True)
        .when((p != "") & (p.startswith("eastern") | (p == "hye_pie")), eastern_available)
        .when(p != "", False)
        .when(F.lit(not only_classical), True)
        .when(s == "classical", True)
        .when(s == "eastern", eastern_available)
        .otherwise(False)
    )


def analysis_profile(profile: Column, stage: Column, default: str = "classical") -> Column:
    """MOR-2: model profile of a scope."""
    p, s = F.lower(tx.strip(F.coalesce(profile, F.lit("")))), F.lower(tx.strip(F.coalesce(stage, F.lit(""))))
    return F.when(p.startswith("xcl") | (s == "classical"), "classical").when(p.startswith("eastern"), "eastern").otherwise(default)


def skip_reason() -> Column:
    """MOR-3."""
    return (
        F.when(F.coalesce("token_normalized", F.lit("")) == "", "token_normalized_empty")
        .when(~F.col("has_armenian"), "token_not_armenian")
        .when(F.col("has_latin") | F.col("has_digits"), "token_not_supported_for_pie")
    )


def batch_sizes(lengths: list[int], max_sequences: int = MAX_SEQUENCES, max_tokens: int = MAX_TOKENS) -> list[int]:
    """MOR-4: number of sequences of every tagger call, first come first served."""
    sizes: list[int] = []
    count = tokens = 0
    for n in lengths:
        if count and (count >= max_sequences or tokens + n > max_tokens):
            sizes.append(count)
            count = tokens = 0
        count += 1
        tokens += n
    return sizes + [count] if count else sizes


Tagger = Callable[[list[list[str]]], list[list[dict]]]


def tag_sequences(tokens: DataFrame, tagger: Tagger) -> DataFrame:
    """MOR-4/5: run a pluggable tagger over token sequences inside the tasks.

    ``tokens``: sequence_key, position, token_surface.  A sequence is a page or
    an entry, so collecting its words is bounded; a partition streams through
    the tagger in small calls.
    """
    packed = tokens.groupBy("sequence_key").agg(
        F.array_sort(F.collect_list(F.struct("position", "token_surface"))).alias("words")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            at = 0
            lists = [[w["token_surface"] for w in words] for words in frame["words"]]
            for size in batch_sizes([len(x) for x in lists]):
                chunk = slice(at, at + size)
                at += size
                rows = []
                for key, words, tags in zip(frame["sequence_key"][chunk], frame["words"][chunk], tagger(lists[chunk])):
                    ok = len(tags) == len(words)
                    for i, w in enumerate(words):
                        tag = tags[i] if ok else {}
                        rows.append((key, w["position"], tag.get("lemma"), tag.get("pos"), tag.get("features"),
                                     None if ok else "token_count_mismatch"))
                yield pd.DataFrame(rows, columns=["sequence_key", "position", "raw_lemma", "raw_pos", "raw_features", "problem"])

    return packed.mapInPandas(
        run, "sequence_key string, position int, raw_lemma string, raw_pos string, raw_features string, problem string"
    )


def optional_text(value: Column) -> Column:
    v = tx.strip(value)
    return F.when(~v.isin(*BLANK_VALUES), v)


def parse_features(value: Column) -> Column:
    """SCL-18: feature string to a map of value lists; flags become ``true``."""
    items = F.filter(F.transform(F.split(tx.strip(value), r"\|"), tx.strip), lambda x: ~x.isin("", "-"))

    def values(item: Column) -> Column:
        raw = tx.strip(F.regexp_replace(item, "^[^=]*=", ""))
        many = F.filter(F.transform(F.split(raw, ","), tx.strip), lambda x: x != "")
        listed = F.when(F.contains(raw, F.lit(",")), F.array_sort(F.array_distinct(many))).otherwise(F.array(raw))
        return F.when(~F.contains(item, F.lit("=")), F.array(F.lit("true"))).when(~raw.isin(*BLANK_VALUES), listed)

    pairs = F.transform(
        items,
        lambda x: F.struct(
            F.when(F.contains(x, F.lit("=")), tx.strip(F.substring_index(x, "=", 1))).otherwise(x).alias("k"), values(x).alias("v")
        ),
    )

    def as_map(kept: Column) -> Column:
        # A later value of the same key wins, as in a plain dictionary.
        last = F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda q: q["k"] == p["k"]))
        return F.when(F.size(kept) > 0, F.map_from_entries(last))

    text = tx.strip(value)
    kept = F.filter(pairs, lambda p: p["v"].isNotNull())
    return F.when(value.isNotNull() & ~text.isin("", "_"), tx.bind(kept, as_map))


def fallback_features(columns: Column) -> Column:
    """SCL-18: other tagger columns as features when the feature column says nothing."""
    reserved = ("token", "form", "word", "surface", "lemma", "pos", "upos", "xpos", "feats", "morph")
    return F.map_filter(columns, lambda k, v: ~k.isin(*reserved) & v.isNotNull() & ~v.isin(*BLANK_VALUES))


def analyses(tokens: DataFrame, predictions: DataFrame, model_key: Column | str) -> DataFrame:
    """MOR-5: completed, failed or skipped row for every token.

    ``predictions``: sequence_key, position, raw_lemma, raw_pos, raw_features, problem.
    """
    lemma, pos = optional_text(F.col("raw_lemma")), optional_text(F.col("raw_pos"))
    rows = (
        tokens.withColumn("reason", skip_reason())
        .join(predictions, ["sequence_key", "position"], "left")
        .withColumns({"lemma": lemma, "pos": pos, "morph_features": parse_features(F.col("raw_features"))})
    )
    return finish_rows(rows, model_key)


def finish_rows(rows: DataFrame, model_key: Column | str) -> DataFrame:
    """MOR-5: status and failure reason from skip reason and prediction."""
    usable = F.col("lemma").isNotNull() | F.col("pos").isNotNull() | F.col("morph_features").isNotNull()
    done = F.col("reason").isNull() & F.col("problem").isNull() & usable
    return rows.withColumn("done", done).select(
        *[c for c in rows.columns if c not in ("reason", "problem", "lemma", "pos", "morph_features", "raw_lemma", "raw_pos", "raw_features")],
        F.when(F.col("done"), F.col("lemma")).alias("lemma"),
        F.when(F.col("done"), tx.normalize_token(F.col("lemma"))).alias("lemma_normalized"),
        F.when(F.col("done"), F.col("pos")).alias("pos"),
        F.when(F.col("done"), F.col("morph_features")).alias("morph_features"),
        (F.lit(model_key) if isinstance(model_key, str) else model_key).alias("model_key"),
        F.when(F.col("reason").isNotNull(), "skipped").when(F.col("done"), "completed").otherwise("failed").alias("analysis_status"),
        F.coalesce("reason", F.when(~F.col("done"), F.coalesce("problem", F.lit("empty_prediction")))).alias("failure_reason"),
    )


def document_summary(rows: DataFrame) -> DataFrame:
    """MOR-6: counts by status and distinct lemmas per document."""
    status = F.col("analysis_status")
    counts = rows.groupBy("owner_id", "document_id").agg(
        F.count("*").alias("analyzed_occurrence_count"),
        F.count_if(status == "completed").alias("completed_count"),
        F.count_if(status == "skipped").alias("skipped_count"),
        F.count_if(status == "failed").alias("failed_count"),
    )
    lemmas = (
        rows.where((status == "completed") & (F.coalesce("lemma_normalized", F.lit("")) != ""))
        .select("owner_id", "document_id", "lemma_normalized").distinct()
        .groupBy("owner_id", "document_id").agg(F.count("*").alias("distinct_lemma_count"))
    )
    return counts.join(lemmas, ["owner_id", "document_id"], "left").withColumn(
        "distinct_lemma_count", F.coalesce("distinct_lemma_count", F.lit(0).cast("bigint"))
    )


def word_distribution(rows: DataFrame) -> DataFrame:
    """MOR-7: counts of lemmas, parts of speech and feature values per form.

    ``rows``: one row per occurrence, or one per distinct word with its number ``n``.
    """
    number = F.sum("n") if "n" in rows.columns else F.count("*")
    done = rows.where(F.col("analysis_status") == "completed")
    features = F.flatten(F.transform(
        F.map_entries(F.coalesce("morph_features", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>")))),
        lambda e: F.transform(e["value"], lambda v: F.struct(F.concat(F.lit("feature:"), e["key"]).alias("kind"), v.alias("value"))),
    ))
    basic = F.array(
        F.struct(F.lit("lemma").alias("kind"), F.coalesce("lemma", "lemma_normalized").alias("value")),
        F.struct(F.lit("pos").alias("kind"), F.col("pos").alias("value")),
    )
    return (
        done.select("owner_id", *[c for c in rows.columns if c == "n"], F.col("token_normalized").alias("normalized_form"), F.explode(F.concat(basic, features)).alias("d"))
        .where(F.coalesce("d.value", F.lit("")) != "")
        .groupBy("owner_id", "normalized_form", F.col("d.kind").alias("kind"), F.col("d.value").alias("value"))
        .agg(number.alias("n"))
    )


def ranked_distribution(distribution: DataFrame) -> DataFrame:
    """MOR-7: values of a kind by count, then value."""
    order = Window.partitionBy("owner_id", "normalized_form", "kind").orderBy(F.col("n").desc(), "value")
    return distribution.withColumn("value_rank", F.row_number().over(order))


def word_counts(rows: DataFrame) -> DataFrame:
    """MOR-7: analysis counts per form."""
    status = F.col("analysis_status")
    return rows.groupBy("owner_id", F.col("token_normalized").alias("normalized_form")).agg(
        F.count("*").alias("analyzed_occurrence_count"),
        F.count_if(status == "completed").alias("completed_count"),
        F.count_if(status == "skipped").alias("skipped_count"),
        F.count_if(status == "failed").alias("failed_count"),
    )


def best_lemmas(distribution: DataFrame) -> DataFrame:
    """MOR-8: most frequent lemma of a form, ties by value, and the number of candidates."""
    return distribution.where(F.col("kind") == "lemma").groupBy("owner_id", "normalized_form").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("n"), "value")).alias("best_lemma"),
        F.count("*").alias("lemma_candidates"),
    )


def summary_payload(lemma_counts: DataFrame, pos_counts: DataFrame, feature_counts: DataFrame, key: list[str]) -> DataFrame:
    """DSC-31: top five lemmas and parts of speech, top ten features per key."""
    def top(rows: DataFrame, kind: str, limit: int) -> DataFrame:
        order = Window.partitionBy(*key).orderBy(F.col("n").desc(), "value")
        return rows.withColumn("value_rank", F.row_number().over(order)).where(F.col("value_rank") <= limit).withColumn("kind", F.lit(kind))

    return top(lemma_counts, "lemma", 5).unionByName(top(pos_counts, "pos", 5)).unionByName(top(feature_counts, "feature", 10))


def adapted_features(raw: Column, columns: Column) -> Column:
    """SCL-18: features of the feature column, else of the tagger's other columns, as lists of values."""
    def listed(k: Column, v: Column) -> Column:
        many = F.filter(F.transform(F.split(tx.strip(v), ","), tx.strip), lambda x: x != "")
        return F.when(F.contains(v, F.lit(",")), F.array_sort(F.array_distinct(many))).otherwise(F.array(tx.strip(v)))

    others = F.transform_values(fallback_features(columns), listed)
    return F.coalesce(parse_features(raw), F.when(F.size(others) > 0, others))
