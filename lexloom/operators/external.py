"""Cached results of external dictionaries (EXT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.functions import profiles as pf, text as tx

TTL_HOURS = 24
LOCAL_TITLE = "Nayiri Corpus (Local Dataset)"  # fixed value shown with corpus results


def latest_cache(cache: DataFrame, mode: str | None = None) -> DataFrame:
    """EXT-1: newest cache row per provider, query and mode."""
    rows = cache if mode is None else cache.where(F.col("search_mode") == mode)
    key = ["provider_key", "normalized_query", "search_mode"]
    names = [c for c in cache.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*names), F.struct("created_at", "cache_id")).alias("r")).select(
        *key, *[F.col(f"r.{n}").alias(n) for n in names]
    )


def is_fresh(now: Column) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") > now)


def expires_at(fetched_at: Column, ttl_hours: int = TTL_HOURS) -> Column:
    """EXT-5: end of life of a cache row, none when the setting is not positive."""
    if ttl_hours <= 0:
        return F.lit(None).cast("timestamp")
    return fetched_at + F.make_interval(hours=F.lit(ttl_hours))


def cache_status() -> Column:
    """EXT-3 for one row that carries ``result_count``."""
    return (
        F.when(F.col("status") == "failed", "unavailable")
        .when(F.coalesce("result_count", F.lit(0)) > 0, "completed").otherwise("no_results")
    )


def result_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("cache_id").agg(F.count("*").alias("result_count"))


def lookup_status(queries: DataFrame, providers: DataFrame, cache: DataFrame, results: DataFrame, mode: str, now: Column) -> DataFrame:
    """EXT-2/3: status per query over all providers; stale or missing rows are unavailable."""
    fresh = latest_cache(cache, mode).where(is_fresh(now)).join(
        providers.where("is_active").select("provider_key"), "provider_key", "left_semi"
    ).join(result_counts(results), "cache_id", "left")
    rank = F.when(cache_status() == "completed", 2).when(cache_status() == "no_results", 1).otherwise(0)
    best = fresh.groupBy(F.col("normalized_query").alias("normalized_form")).agg(F.max(rank).alias("r"))
    r = F.coalesce("r", F.lit(0))
    return queries.select("normalized_form").distinct().join(best, "normalized_form", "left").select(
        "normalized_form", F.when(r == 2, "completed").when(r == 1, "no_results").otherwise("unavailable").alias("lookup_status")
    )


def cached_items(providers: DataFrame, cache: DataFrame, results: DataFrame, mode: str, now: Column) -> DataFrame:
    """EXT-2: results of fresh latest rows, the last of equal items wins."""
    fresh = latest_cache(cache, mode).where(is_fresh(now)).select(
        "provider_key", F.col("normalized_query").alias("normalized_form"), "cache_id", "fetched_at"
    )
    rows = (
        fresh.join(providers.where("is_active").select("provider_key", F.col("display_name").alias("provider_display_name")), "provider_key")
        .join(results.withColumnRenamed("normalized_form", "result_form"), "cache_id")
    )
    key = ["normalized_form", "provider_key", "provider_display_name", "matched_form", "link_key", "title_key"]
    keyed = rows.withColumns({
        "link_key": F.coalesce("reference_link", F.lit("")), "title_key": F.coalesce("source_title", F.lit("")),
    })
    names = ["result_form", "source_title", "snippet", "reference_link", "match_type", "match_score", "metadata", "fetched_at"]
    return keyed.groupBy(*key).agg(F.max_by(F.struct(*names), F.col("result_seq")).alias("r")).select(
        "normalized_form", "provider_key", "provider_display_name", "matched_form", *[F.col(f"r.{n}").alias(n) for n in names]
    )


def sanitize(items: DataFrame) -> DataFrame:
    """EXT-4: trimmed, traceable, first of equal results per query.

    ``items`` carries query_key and seq, the order in which results came.
    """
    blank = lambda c: F.nullif(tx.strip(F.col(c)), F.lit(""))
    rows = items.withColumns({
        "matched_form": tx.strip(F.col("matched_form")), "source_title": blank("source_title"),
        "snippet": blank("snippet"), "reference_link": blank("reference_link"),
    })
    rows = rows.withColumn(
        "normalized_form",
        F.nullif(tx.normalize_token(F.coalesce(F.nullif(F.col("normalized_form"), F.lit("")), "matched_form")), F.lit("")),
    ).where(
        (F.col("matched_form") != "")
        & pf.is_traceable(F.col("source_title"), F.col("snippet"), F.col("reference_link"))
    )
    key = [
        "query_key", "provider_key", F.coalesce("normalized_form", "matched_form"),
        F.coalesce("source_title", F.lit("")), F.coalesce("reference_link", F.lit("")),
    ]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("seq"))
    return rows.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def snapshots(forms: DataFrame, cache: DataFrame, results: DataFrame, now: Column, provider_key: str = pf.WEB_PROVIDER) -> DataFrame:
    """EXT-6: what is known about a form at one provider.

    ``forms``: normalized_form, distinct.
    """
    latest = latest_cache(cache.where(F.col("provider_key") == provider_key), "normalized").select(
        F.col("normalized_query").alias("normalized_form"), "cache_id", "query_text", "status", "expires_at"
    )
    first = results.groupBy("cache_id").agg(
        F.count("*").alias("match_count"),
        F.min_by(F.struct("matched_form", "source_title", "reference_link", "snippet", "metadata"), F.col("result_seq")).alias("first"),
    )
    rows = forms.join(latest, "normalized_form", "left").join(first, "cache_id", "left")
    usable = F.col("cache_id").isNotNull() & is_fresh(now)
    status = (
        F.when(~usable, "unchecked").when(F.col("status") == "failed", "unavailable")
        .when(F.col("match_count") > 0, "found").otherwise("not_found")
    )
    query, hit = tx.strip(F.coalesce("query_text", F.lit(""))), tx.strip(F.coalesce("first.matched_form", F.lit("")))
    canonical = (
        F.when(F.coalesce(F.col("first.metadata")["morphology_fallback"], F.lit("")) == "true", "morphology_assisted")
        .when((query != "") & (query == hit), "direct_match")
        .when((tx.normalize_token(query) != "") & (tx.normalize_token(query) == tx.normalize_token(hit)), "canonicalized_by_nayiri")
        .otherwise("unresolved")
    )
    return rows.withColumn("external_status", status).select(
        "normalized_form", "external_status",
        F.when(F.col("external_status") == "found", F.col("match_count")).otherwise(F.lit(0).cast("bigint")).alias("match_count"),
        *[F.when(F.col("external_status") == "found", F.col(f"first.{c}")).alias(c) for c in ("matched_form", "source_title", "reference_link", "snippet")],
        F.when(F.col("external_status") == "found", canonical).otherwise("unresolved").alias("canonicalization_status"),
    )


def found_forms(snaps: DataFrame, status: str = "found") -> DataFrame:
    """EXT-7: forms with (``found``) or without (``not_found``) results in a completed fresh row."""
    return snaps.where(F.col("external_status") == status).select("normalized_form")


def document_summary(document_forms: DataFrame, snaps: DataFrame) -> DataFrame:
    """EXT-8: found, not found and unchecked forms per document."""
    rows = document_forms.join(snaps.select("normalized_form", "external_status"), "normalized_form", "left")
    s = F.col("external_status")
    return rows.groupBy("owner_id", "document_id").agg(
        F.count_if(s == "found").alias("found_count"),
        F.count_if(s == "not_found").alias("not_found_count"),
        F.count_if(~F.coalesce(s, F.lit("")).isin("found", "not_found")).alias("unchecked_count"),
        F.count("*").alias("total_forms"),
    )


def pending_forms(document_forms: DataFrame, cache: DataFrame, now: Column, provider_key: str = pf.WEB_PROVIDER) -> DataFrame:
    """EXT-9: forms of documents whose latest row is missing or stale."""
    fresh = latest_cache(cache.where(F.col("provider_key") == provider_key), "normalized").where(is_fresh(now))
    return document_forms.join(fresh.select(F.col("normalized_query").alias("normalized_form")), "normalized_form", "left_anti")


def pending_counts(document_forms: DataFrame, pending: DataFrame) -> DataFrame:
    """EXT-9: checked and skipped forms per document."""
    key = ["owner_id", "document_id"]
    todo = pending.groupBy(*key).agg(F.count("*").alias("checked_count"))
    return document_forms.groupBy(*key).agg(F.count("*").alias("total")).join(todo, key, "left").select(
        *key, F.coalesce("checked_count", F.lit(0).cast("bigint")).alias("checked_count"),
        (F.col("total") - F.coalesce("checked_count", F.lit(0))).alias("skipped_count"),
    )


def fill_from_corpus(pending: DataFrame, best_corpus: DataFrame) -> DataFrame:
    """EXT-10: new results for pending forms that the corpus knows; such rows never expire.

    ``best_corpus``: normalized_form, lemma, source_count, one row per form.
    """
    return pending.select("normalized_form").distinct().join(best_corpus, "normalized_form").select(
        "normalized_form", F.col("lemma").alias("matched_form"), F.lit(LOCAL_TITLE).alias("source_title"),
        F.concat(F.lit("Matched across "), F.col("source_count"), F.lit(" corpus document(s).")).alias("snippet"),
        F.lit("normalized").alias("match_type"), F.lit(100.0).alias("match_score"), "source_count",
    )


def reuse_lemma_results(pending: DataFrame, best_lemmas: DataFrame, items: DataFrame) -> DataFrame:
    """EXT-10: results of the owner's best lemma, kept for the surface form."""
    key = ["owner_id", "normalized_form"]
    lemma = best_lemmas.select(*key, F.lower("best_lemma").alias("lemma_form")).where(F.col("lemma_form") != F.col("normalized_form"))
    hits = items.select(
        F.col("normalized_form").alias("lemma_form"), "provider_key", "matched_form", "source_title", "reference_link", "match_type", "match_score"
    )
    return pending.select(*key).distinct().join(lemma, key).join(hits, "lemma_form").withColumn("canonical_lookup_query", F.col("lemma_form"))


def cache_rows(filled: DataFrame, provider_key: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """EXT-10: cache and result rows of forms filled from lemmas or from the corpus, as they are stored.

    The cache has no owner: a form that several owners fill alike is one row, and equal results
    are one.  Such rows never expire.  Ids follow from provider, form and origin, so storing a
    batch twice gives the same rows.
    """
    by_lemma = "canonical_lookup_query" in filled.columns
    origin = F.lit("morphology_fallback" if by_lemma else "local_corpus_match")
    detail = "canonical_lookup_query" if by_lemma else "source_count"
    cache_id = F.sha2(F.concat_ws("|", F.lit(provider_key), origin, "normalized_form"), 256)
    link = F.col("reference_link") if "reference_link" in filled.columns else F.lit(None).cast("string")
    snippet = F.col("snippet") if "snippet" in filled.columns else F.lit(None).cast("string")
    rows = filled.select(
        cache_id.alias("cache_id"), "normalized_form", "matched_form", "source_title", snippet.alias("snippet"), link.alias("reference_link"),
        "match_type", "match_score", F.col(detail).cast("string").alias("detail"),
    ).distinct()
    cache = rows.select(
        "cache_id", F.lit(provider_key).alias("provider_key"), F.col("normalized_form").alias("query_text"), F.col("normalized_form").alias("normalized_query"),
        F.lit("normalized").alias("search_mode"), F.lit("completed").alias("status"), now.alias("fetched_at"), now.alias("created_at"),
        F.lit(None).cast("timestamp").alias("expires_at"),
    ).distinct()
    results = rows.select(
        "cache_id", F.lit(provider_key).alias("provider_key"), "matched_form", F.lower("matched_form").alias("normalized_form"), "source_title", "snippet",
        "reference_link", "match_type", "match_score", F.create_map(origin, F.lit("true"), F.lit(detail), F.col("detail")).alias("metadata"),
    )
    return cache, results
