"""Reference status with latest-result semantics (STA)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FORM_KEY = ["owner_id", "normalized_form"]
SUMMARY = ["reference_match_count", "best_source", "best_form", "best_type", "best_score"]


def type_order() -> Column:
    """Exact before normalized before fuzzy."""
    return F.when(F.col("match_type") == "exact", 0).when(F.col("match_type") == "normalized", 1).otherwise(2)


def latest_results(results: DataFrame, runs: DataFrame) -> DataFrame:
    """STA-1: result of the newest completed source-first run per entry."""
    done = runs.where((F.col("status") == "completed") & (F.col("direction") == "source_to_internal")).select(
        "run_id", F.col("created_seq").alias("run_seq")
    )
    order = F.struct("run_seq", "run_id", "result_seq", "result_id")
    names = [c for c in results.columns if c not in ("entry_id",)]
    return (
        results.where(F.col("entry_id").isNotNull()).join(done, "run_id")
        .groupBy("entry_id").agg(F.max_by(F.struct(*names), order).alias("r"))
        .select("entry_id", *[F.col(f"r.{n}").alias(n) for n in names])
    )


def _summary(key: list[str], rows: DataFrame, order: Column, best: list[Column], count: Column | None = None) -> DataFrame:
    fields = F.struct(*best)
    return rows.groupBy(*key).agg(
        (F.count("*") if count is None else count).alias("reference_match_count"), F.min_by(fields, order).alias("b")
    ).select(
        *key, "reference_match_count",
        F.col("b.best_source").alias("best_source"), F.col("b.best_form").alias("best_form"),
        F.col("b.best_type").alias("best_type"), F.col("b.best_score").alias("best_score"),
    )


def source_first(latest: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """Summary of matched latest results by ``key``, entries counted once."""
    named = latest.where(F.col("match_status") == "matched").join(
        sources.select("owner_id", "source_id", "display_name"), ["owner_id", "source_id"]
    )
    distinct = named.groupBy(*key, "entry_id").agg(
        F.first("display_name").alias("display_name"), F.first("target_label").alias("target_label")
    )
    return _summary(
        key, distinct, F.struct("display_name", "target_label", "entry_id"),
        [F.col("display_name").alias("best_source"), F.col("target_label").alias("best_form"),
         F.lit("normalized").alias("best_type"), F.lit(None).cast("double").alias("best_score")],
    )


def direct_summary(matches: DataFrame, sources: DataFrame, target_type: str) -> DataFrame:
    """STA-7: stored direct matches by target key."""
    rows = matches.where(F.col("target_type") == target_type).drop("display_name").join(
        sources.select("owner_id", "source_id", "display_name"), ["owner_id", "source_id"]
    )
    order = F.struct(
        type_order().alias("t"), (-F.coalesce("match_score", F.lit(0.0))).alias("s"), "display_name", "matched_form", "entry_id"
    )
    return _summary(
        ["owner_id", "target_key"], rows, order,
        [F.col("display_name").alias("best_source"), F.col("matched_form").alias("best_form"),
         F.col("match_type").alias("best_type"), F.col("match_score").alias("best_score")],
    )


def exact_summary(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """STA-8: active entries of the same normalized form."""
    rows = entries.join(sources.where("is_active").select("owner_id", "source_id", "display_name"), ["owner_id", "source_id"])
    return _summary(
        FORM_KEY, rows, F.struct("display_name", "surface_form"),
        [F.col("display_name").alias("best_source"), F.col("surface_form").alias("best_form"),
         F.lit("normalized").alias("best_type"), F.lit(100.0).alias("best_score")],
    )


def _pack(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    return rows.select(*key, F.struct(*SUMMARY).alias(name))


def _unpack(rows: DataFrame, keep: list[str], chosen: Column) -> DataFrame:
    return rows.withColumn("s", chosen).select(
        *keep, F.col("s").isNotNull().alias("has_reference_match"),
        F.coalesce("s.reference_match_count", F.lit(0).cast("bigint")).alias("reference_match_count"),
        *[F.col(f"s.{c}").alias(c) for c in SUMMARY[1:]],
    )


def group_status(forms: DataFrame, latest: DataFrame, matches: DataFrame, entries: DataFrame, sources: DataFrame) -> DataFrame:
    """STA-2: source-first, else stored direct match, else an active entry of the form."""
    direct = direct_summary(matches, sources, "lexicon_group").withColumnRenamed("target_key", "normalized_form")
    out = (
        forms.select(*FORM_KEY)
        .join(_pack(source_first(latest, sources, FORM_KEY), FORM_KEY, "a"), FORM_KEY, "left")
        .join(_pack(direct, FORM_KEY, "b"), FORM_KEY, "left")
        .join(_pack(exact_summary(entries, sources), FORM_KEY, "c"), FORM_KEY, "left")
    )
    return _unpack(out, FORM_KEY, F.coalesce("a", "b", "c"))


def lexeme_values(lexemes: DataFrame, lexeme_forms: DataFrame) -> DataFrame:
    """STA-9: canonical forms and all forms, one below the other."""
    return lexemes.select("owner_id", "lexeme_id", F.col("canonical_normalized_form").alias("normalized_form")).unionByName(
        lexeme_forms.select("owner_id", "lexeme_id", "normalized_form")
    )


def lexeme_status(lexemes: DataFrame, lexeme_forms: DataFrame, latest: DataFrame, matches: DataFrame, entries: DataFrame, sources: DataFrame) -> DataFrame:
    """STA-3: status over canonical and all forms of a lexeme."""
    key = ["owner_id", "lexeme_id"]
    values = lexeme_values(lexemes, lexeme_forms).where(F.col("normalized_form") != "").distinct()
    # The named source is not filtered by owner twice: latest results carry the owner.
    covered_rows = values.join(latest, FORM_KEY)
    covered = covered_rows.select(*key).distinct().withColumn("covered", F.lit(True))
    direct = direct_summary(matches, sources, "lexeme").withColumnRenamed("target_key", "lexeme_id")
    exact = values.join(exact_summary(entries, sources), FORM_KEY)
    best_exact = exact.groupBy(*key).agg(
        F.min_by(F.struct(*SUMMARY), F.struct("best_source", "best_form", "normalized_form")).alias("c")
    )
    out = (
        lexemes.select(*key)
        .join(_pack(source_first(covered_rows, sources, key), key, "a"), key, "left")
        .join(covered, key, "left")
        .join(_pack(direct, key, "b"), key, "left")
        .join(best_exact, key, "left")
    )
    chosen = F.coalesce("a", F.when(F.col("covered").isNull(), F.col("b")), "c")
    return _unpack(out, key, chosen)


def entry_status(entries: DataFrame, latest: DataFrame, matches: DataFrame, sources: DataFrame) -> DataFrame:
    """STA-4: latest result of an entry, else its stored direct matches."""
    fields = [
        "match_status", "match_count", "exists_in_lexicon", "found_in_books", "matching_lexeme_count",
        "best_lexeme_id", "best_document_id", "best_page_number",
    ]
    named = latest.join(sources.select("owner_id", "source_id", "display_name"), ["owner_id", "source_id"]).select(
        "entry_id", F.struct("display_name", "target_label", *fields).alias("a")
    )
    rows = matches.drop("display_name").join(sources.select("owner_id", "source_id", "display_name"), ["owner_id", "source_id"])
    order = F.struct(
        type_order().alias("t"), (-F.coalesce("match_score", F.lit(0.0))).alias("s"), "display_name", "matched_form", "target_key"
    )
    direct = rows.groupBy("entry_id").agg(
        F.count("*").alias("n"),
        F.min_by(F.struct("display_name", "matched_form", "match_type", "match_score"), order).alias("m"),
    ).select("entry_id", F.struct("n", "m").alias("b"))
    a, b = F.col("a"), F.col("b")
    covered, matched = a.isNotNull(), F.coalesce(F.col("a.match_status") == "matched", F.lit(False))
    use_direct = ~covered & b.isNotNull()
    zero = F.lit(0).cast("bigint")
    return entries.select("owner_id", "source_id", "entry_id").join(named, "entry_id", "left").join(direct, "entry_id", "left").select(
        "owner_id", "source_id", "entry_id",
        (matched | use_direct).alias("has_reference_match"),
        F.when(matched, F.col("a.match_count")).when(use_direct, F.col("b.n")).otherwise(zero).alias("reference_match_count"),
        F.when(matched, F.col("a.display_name")).when(use_direct, F.col("b.m.display_name")).alias("best_source"),
        F.when(matched, F.col("a.target_label")).when(use_direct, F.col("b.m.matched_form")).alias("best_form"),
        F.when(covered, F.col("a.match_status")).when(use_direct, "matched").alias("latest_match_status"),
        F.when(covered, F.col("a.exists_in_lexicon")).when(use_direct, True).alias("exists_in_lexicon"),
        F.when(covered, F.col("a.found_in_books")).when(use_direct, False).alias("found_in_books"),
        F.coalesce("a.matching_lexeme_count", zero).alias("matching_lexeme_count"),
        F.col("a.best_lexeme_id").alias("best_lexeme_id"),
        F.col("a.best_document_id").alias("best_document_id"),
        F.col("a.best_page_number").alias("best_page_number"),
    )


def matched_group_keys(latest: DataFrame, matches: DataFrame, entries: DataFrame, sources: DataFrame) -> DataFrame:
    """STA-5 for groups: matched forms, uncovered direct matches, forms of active entries."""
    seen = latest.where(F.col("normalized_form") != "")
    first = seen.where(F.col("match_status") == "matched").select(*FORM_KEY)
    direct = (
        matches.where(F.col("target_type") == "lexicon_group").select("owner_id", F.col("target_key").alias("normalized_form"))
        .distinct().join(seen.select(*FORM_KEY).distinct(), FORM_KEY, "left_anti")
    )
    exact = entries.join(sources.where("is_active").select("owner_id", "source_id"), ["owner_id", "source_id"], "left_semi").select(*FORM_KEY)
    return first.unionByName(direct).unionByName(exact).distinct()


def matched_lexeme_keys(lexemes: DataFrame, lexeme_forms: DataFrame, latest: DataFrame, matches: DataFrame) -> DataFrame:
    """STA-5 for lexemes: the same without the entry union."""
    key = ["owner_id", "lexeme_id"]
    hits = lexeme_values(lexemes, lexeme_forms).distinct().join(latest.select(*FORM_KEY, "match_status"), FORM_KEY)
    first = hits.where(F.col("match_status") == "matched").select(*key)
    direct = (
        matches.where(F.col("target_type") == "lexeme").select("owner_id", F.col("target_key").alias("lexeme_id"))
        .distinct().join(hits.select(*key).distinct(), key, "left_anti")
    )
    return first.unionByName(direct).distinct()


def matched_entries(latest: DataFrame, matches: DataFrame) -> DataFrame:
    """STA-6: entries with a matched latest result, or a direct match if never covered."""
    first = latest.where(F.col("match_status") == "matched").select("owner_id", "entry_id")
    direct = matches.where(F.col("entry_id").isNotNull()).select("owner_id", "entry_id").distinct().join(
        latest.select("owner_id", "entry_id").distinct(), ["owner_id", "entry_id"], "left_anti"
    )
    return first.unionByName(direct).distinct()
