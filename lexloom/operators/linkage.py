"""Matching of forms and lexemes against imported wordlists (REF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.functions import profiles as pf, text as tx
from lexloom.functions.similarity import indel_similarity, similar_pairs
from lexloom.operators.keyed import KeyedTable
from lexloom.operators.lexicon import reading_place, view

FUZZY_THRESHOLD = 90.0
FORM_KEY = ["owner_id", "normalized_form"]
TARGET_KEY = ["owner_id", "target_type", "target_key"]


def type_order() -> Column:
    """Exact before normalized before fuzzy."""
    return F.when(F.col("match_type") == "exact", 0).when(F.col("match_type") == "normalized", 1).otherwise(2)


def import_entries(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """REF-1: keep pairs that are new to the source; counts read, imported, skipped."""
    pair = ["owner_id", "source_id", "surface_form", "normalized_form"]
    fresh = incoming.join(existing.select(*pair), pair, "left_anti").dropDuplicates(pair)
    source = ["owner_id", "source_id"]
    counts = (
        incoming.groupBy(*source).agg(F.count("*").alias("rows_read"))
        .join(fresh.groupBy(*source).agg(F.count("*").alias("rows_imported")), source, "left")
        .withColumn("rows_imported", F.coalesce("rows_imported", F.lit(0).cast("bigint")))
        .withColumn("rows_skipped", F.col("rows_read") - F.col("rows_imported"))
    )
    return fresh, counts


def catalog(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """REF-2: entries of active sources with what a match shows about its source."""
    active = sources.where("is_active").select(
        "owner_id", "source_id", "display_name", "last_import_method", "last_import_warning"
    )
    return entries.join(active, ["owner_id", "source_id"])


def group_targets(groups: DataFrame, name: str = "candidates") -> DataFrame:
    """REF-7: forms of a view as match targets."""
    return view(groups, name).select(
        "owner_id", F.lit("lexicon_group").alias("target_type"), F.col("normalized_form").alias("target_key"),
        F.col("normalized_form").alias("target_label"), F.col("normalized_form").alias("value"),
    )


def lexeme_targets(lexemes: DataFrame, lexeme_forms: DataFrame) -> DataFrame:
    """REF-7: lexemes as targets, one row per distinct value (canonical and forms)."""
    own = lexemes.select("owner_id", "lexeme_id", "canonical_form", F.col("canonical_normalized_form").alias("value"))
    forms = lexeme_forms.join(lexemes.select("owner_id", "lexeme_id", "canonical_form"), ["owner_id", "lexeme_id"])
    return (
        own.unionByName(forms.select("owner_id", "lexeme_id", "canonical_form", F.col("normalized_form").alias("value")))
        .where(F.col("value") != "").distinct()
        .select(
            "owner_id", F.lit("lexeme").alias("target_type"), F.col("lexeme_id").alias("target_key"),
            F.col("canonical_form").alias("target_label"), "value",
        )
    )


ENTRY_FIELDS = ["source_id", "display_name", "entry_id", "surface_form", "normalized_form", "last_import_method", "last_import_warning"]


def exact_matches(targets: DataFrame, cat: DataFrame) -> DataFrame:
    """REF-3: target value equals the entry as written."""
    keyed = cat.select("owner_id", *ENTRY_FIELDS, F.col("surface_form").alias("value"))
    return _matched(targets.join(keyed, ["owner_id", "value"]), "exact")


def normalized_matches(targets: DataFrame, cat: DataFrame) -> DataFrame:
    """REF-4: target value equals the entry's normalized form."""
    keyed = cat.select("owner_id", *ENTRY_FIELDS, F.col("normalized_form").alias("value"))
    return _matched(targets.join(keyed, ["owner_id", "value"]), "normalized")


def _matched(hits: DataFrame, kind: str, score: Column | None = None) -> DataFrame:
    return hits.select(
        *TARGET_KEY, "target_label", *ENTRY_FIELDS, F.lit(kind).alias("match_type"),
        (F.lit(None).cast("double") if score is None else score).alias("match_score"),
    ).distinct()


def fuzzy_pairs(values: DataFrame, cat: DataFrame) -> DataFrame:
    """REF-5, candidates: distinct value pairs that may reach the threshold.

    ``values``: owner_id, value.  Entries recognized from page images are left out.
    """
    trusted = cat.where(~F.coalesce(F.col("last_import_method") == "pdf_ocr", F.lit(False)))
    left = values.select("owner_id", "value").where(F.length("value") > 2).distinct()
    right = trusted.select("owner_id", F.col("normalized_form").alias("value")).distinct()
    return similar_pairs(left, right, ["owner_id"], FUZZY_THRESHOLD, prefix=2, length_band=2)


def fuzzy_matches(targets: DataFrame, cat: DataFrame) -> DataFrame:
    """REF-5: best score per target and entry for the given unmatched targets."""
    scored = (
        fuzzy_pairs(targets, cat)
        .withColumn("score", indel_similarity("value_left", "value_right"))
        .where(F.col("score") >= FUZZY_THRESHOLD)
    )
    trusted = cat.where(~F.coalesce(F.col("last_import_method") == "pdf_ocr", F.lit(False)))
    hits = (
        targets.join(scored.withColumnRenamed("value_left", "value"), ["owner_id", "value"])
        .join(
            trusted.select("owner_id", *ENTRY_FIELDS).withColumn("value_right", F.col("normalized_form")),
            ["owner_id", "value_right"],
        )
    )
    return (
        hits.groupBy(*TARGET_KEY, "target_label", *ENTRY_FIELDS)
        .agg(F.round(F.max("score"), 2).alias("match_score"))
        .withColumn("match_type", F.lit("fuzzy"))
        .select(*TARGET_KEY, "target_label", *ENTRY_FIELDS, "match_type", "match_score")
    )


def find_matches(targets: DataFrame, cat: DataFrame, allow_fuzzy: bool = True) -> DataFrame:
    """REF-3..6: all matches; fuzzy ones only for targets nothing else matched."""
    direct = exact_matches(targets, cat).unionByName(normalized_matches(targets, cat))
    if not allow_fuzzy:
        return direct
    rest = targets.join(direct.select(*TARGET_KEY).distinct(), TARGET_KEY, "left_anti")
    return direct.unionByName(fuzzy_matches(rest, cat))


def stored_catalog(cat: DataFrame, path: str) -> KeyedTable:
    """REF-12: the catalogue by the values a target may equal, stored for point lookups."""
    way = F.explode(F.array(
        F.struct(F.col("surface_form").alias("value"), F.lit("exact").alias("way")), F.struct(F.col("normalized_form").alias("value"), F.lit("normalized").alias("way"))
    ))
    rows = cat.select("owner_id", *ENTRY_FIELDS, way.alias("v")).select("owner_id", "v.value", "v.way", *ENTRY_FIELDS)
    return KeyedTable.create(rows, path, ["owner_id", "value"])


def match_targets(targets: DataFrame, stored: KeyedTable, cat: DataFrame, allow_fuzzy: bool = True) -> DataFrame:
    """REF-12: results of a few targets; direct matches read the folders of their values only."""
    hits = targets.join(stored.lookup_many(targets.select("owner_id", "value")), ["owner_id", "value"])
    fields = [*TARGET_KEY, "target_label", *ENTRY_FIELDS]
    direct = hits.select(*fields, F.col("way").alias("match_type"), F.lit(None).cast("double").alias("match_score")).distinct()
    rest = targets.join(direct.select(*TARGET_KEY).distinct(), TARGET_KEY, "left_anti")
    return results_of(targets, direct.unionByName(fuzzy_matches(rest, cat)) if allow_fuzzy else direct)


def match_order() -> list[Column]:
    """REF-6."""
    return [type_order(), F.coalesce("match_score", F.lit(0.0)).desc(), F.col("display_name"), F.col("surface_form"), F.col("entry_id")]


def ranked(matches: DataFrame) -> DataFrame:
    """REF-6: position of every match of a target."""
    rank = F.row_number().over(Window.partitionBy(*TARGET_KEY).orderBy(*match_order()))
    return matches.withColumn("match_rank", rank)


def best_matches(matches: DataFrame) -> DataFrame:
    """REF-6: the first match and the count per target, reduced before any ranking."""
    order = F.struct(
        type_order().alias("t"), (-F.coalesce("match_score", F.lit(0.0))).alias("s"), "display_name", "surface_form", "entry_id"
    )
    best = F.min_by(F.struct("source_id", "display_name", "entry_id", "surface_form", "match_type", "match_score"), order)
    return matches.groupBy(*TARGET_KEY).agg(best.alias("best"), F.count("*").alias("match_count"))


def internal_to_reference(targets: DataFrame, cat: DataFrame, allow_fuzzy: bool = True) -> DataFrame:
    """REF-8: one result per target."""
    return results_of(targets, find_matches(targets, cat, allow_fuzzy))


def results_of(targets: DataFrame, matches: DataFrame) -> DataFrame:
    """REF-8: status, count and best match of every target."""
    found = best_matches(matches)
    ends = targets.groupBy(*TARGET_KEY, "target_label").agg(F.min("value").alias("any_value"))
    return ends.join(found, TARGET_KEY, "left").select(
        *TARGET_KEY, "target_label",
        F.when(F.col("match_count") > 0, "matched").otherwise("unmatched").alias("match_status"),
        F.coalesce("match_count", F.lit(0).cast("bigint")).alias("match_count"),
        F.col("best.match_type").alias("best_match_type"), F.col("best.match_score").alias("best_match_score"),
        F.col("best.display_name").alias("best_source_display_name"), F.col("best.surface_form").alias("best_matched_form"),
    )


def run_stats(results: DataFrame) -> DataFrame:
    """REF-8: totals by best match type."""
    kind = F.col("best_match_type")
    return results.groupBy("owner_id", "target_type").agg(
        F.count("*").alias("total_items"),
        F.count_if(F.col("match_status") == "matched").alias("matched_items"),
        F.count_if(F.col("match_status") == "unmatched").alias("unmatched_items"),
        F.count_if(kind == "exact").alias("exact_match_count"),
        F.count_if(kind == "normalized").alias("normalized_match_count"),
        F.count_if(kind == "fuzzy").alias("fuzzy_match_count"),
    )


def matching_lexemes(lexemes: DataFrame, lexeme_forms: DataFrame) -> DataFrame:
    """REF-10: lexemes of a form, canonical hits first, then by form, oldest first."""
    fields = ["lexeme_id", "canonical_form", "created_seq"]
    canonical = lexemes.select("owner_id", F.col("canonical_normalized_form").alias("normalized_form"), *fields, F.lit(0).alias("via"))
    forms = lexeme_forms.join(lexemes.select("owner_id", *fields), ["owner_id", "lexeme_id"]).select(*FORM_KEY, *fields, F.lit(1).alias("via"))
    return canonical.unionByName(forms).groupBy(*FORM_KEY, *fields).agg(F.min("via").alias("via"))


def lexeme_evidence(lexemes: DataFrame, lexeme_forms: DataFrame) -> DataFrame:
    """REF-10: count and best lexeme per form."""
    order = F.struct("via", "created_seq", "lexeme_id")
    return matching_lexemes(lexemes, lexeme_forms).groupBy(*FORM_KEY).agg(
        F.count("*").alias("matching_lexeme_count"),
        F.min_by("lexeme_id", order).alias("best_lexeme_id"),
        F.min_by("canonical_form", order).alias("best_lexeme_canonical_form"),
    )


def book_evidence(occ: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """REF-11: occurrences per form and the first place by title, page and position.

    Words are counted per document first, where they lie, as numbers only; a form then costs one row
    per task in the shuffle. Snippets are made for the winners alone, from the pages that hold one:
    no word of the corpus is sorted with its snippet.
    """
    per_document = occ.groupBy("owner_id", F.col("normalized_token").alias("normalized_form"), "document_id").agg(
        F.count("*").alias("n"), F.min(reading_place()).alias("place")
    ).join(documents.select("document_id", "title"), "document_id")
    firsts = per_document.groupBy(*FORM_KEY).agg(
        F.sum("n").alias("occurrence_count"), F.min(F.struct("title", "place", "document_id")).alias("first")
    ).select(*FORM_KEY, "occurrence_count", "first.*")
    # Pages lie by document, so only the winners move.
    won = firsts.groupBy("document_id").agg(F.collect_list(F.struct(*FORM_KEY, "occurrence_count", "title", "place")).alias("won"))
    page = F.coalesce(F.col("page_number"), F.lit(-1)).cast("bigint")
    here = F.filter("won", lambda x: F.shiftright(x["place"] - 1, 32) == page)
    held = pages.select("document_id", "page_number", "page_text").join(won, "document_id").select(
        "document_id", "page_number", "page_text", F.length("page_text").alias("page_length"), F.inline(here)
    )
    start = F.col("place") - 1 - F.shiftleft(page, 32)
    token = F.regexp_extract(F.substring(F.col("page_text"), start.cast("int") + 1, F.col("page_length")), f"^{tx.TOKEN_PATTERN}", 0)
    placed = held.withColumn("start", start.cast("int")).withColumn("end", F.col("start") + F.length(token))
    return placed.select(
        *FORM_KEY, "occurrence_count", F.col("document_id").alias("best_document_id"),
        F.col("title").alias("best_document_title"), F.col("page_number").alias("best_page_number"),
        tx.context_snippet(F.col("page_text"), F.col("start"), F.col("end"), F.col("page_length")).alias("best_context_snippet"),
        pf.document_link(F.col("document_id"), F.col("page_number")).alias("reference_link"),
    )


def source_to_internal(entries: DataFrame, lexeme_ev: DataFrame, book_ev: DataFrame, scope: str = "all_internal") -> DataFrame:
    """REF-9: one result per entry with lexicon and book evidence.

    ``scope``: lexicon, imported_books or all_internal.
    """
    zero = F.lit(0).cast("bigint")
    out = entries
    out = out.join(lexeme_ev, FORM_KEY, "left") if scope != "imported_books" else out.withColumns({
        "matching_lexeme_count": zero, "best_lexeme_id": F.lit(None).cast("string"),
        "best_lexeme_canonical_form": F.lit(None).cast("string"),
    })
    books = book_ev.drop("reference_link").withColumnRenamed("occurrence_count", "matching_book_occurrence_count")
    out = out.join(books, FORM_KEY, "left") if scope != "lexicon" else out.withColumns({
        "matching_book_occurrence_count": zero, "best_document_id": F.lit(None).cast("string"),
        "best_document_title": F.lit(None).cast("string"), "best_page_number": F.lit(None).cast("int"),
        "best_context_snippet": F.lit(None).cast("string"),
    })
    lex, books_n = F.coalesce("matching_lexeme_count", zero), F.coalesce("matching_book_occurrence_count", zero)
    return out.withColumns({
        "matching_lexeme_count": lex, "matching_book_occurrence_count": books_n,
        "match_count": lex + books_n,
        "match_status": F.when(lex + books_n > 0, "matched").otherwise("unmatched"),
        "exists_in_lexicon": lex > 0, "found_in_books": books_n > 0,
    })


def list_target_results(results: DataFrame, status: str = "all", target_type: str | None = None, search: str | None = None) -> DataFrame:
    """REF-13: filters of the target result list."""
    out = results if status == "all" else results.where(F.col("match_status") == status)
    if target_type:
        out = out.where(F.col("target_type") == target_type)
    if search and search.strip():
        out = out.where(F.contains(F.lower("target_label"), F.lower(F.lit(search.strip()))))
    return out


def list_entry_results(results: DataFrame, status: str = "all", scope: str = "all", search: str | None = None) -> DataFrame:
    """REF-14: filters of the entry result list."""
    from lexloom.functions.text import normalize_token

    out = results if status == "all" else results.where(F.col("match_status") == status)
    if scope in ("lexicon_only", "books_only"):
        out = out.where(F.col("exists_in_lexicon" if scope == "lexicon_only" else "found_in_books"))
    if search and search.strip():
        raw, norm = F.lower(F.lit(search.strip())), normalize_token(F.lit(search))
        out = out.where(F.contains(F.lower("target_label"), raw) | F.contains(F.lower("normalized_form"), norm))
    return out


def entry_result_details(results: DataFrame, occ: DataFrame, documents: DataFrame) -> DataFrame:
    """REF-15: every book occurrence behind an entry result.

    Adaptive execution splits the partitions of forms that many results share.
    """
    rows = occ.withColumnRenamed("normalized_token", "normalized_form")
    keys = results.where("found_in_books").select("run_id", "entry_id", *FORM_KEY)
    return (
        keys.join(rows, FORM_KEY)
        .join(documents.select("document_id", "title"), "document_id")
        .select("run_id", "entry_id", "document_id", "title", "page_number", "char_start", "context_snippet",
                pf.document_link(F.col("document_id"), F.col("page_number")).alias("reference_link"))
    )


def latest_imports(imports: DataFrame) -> DataFrame:
    """REF-17/18: newest import of every source."""
    order = F.struct("created_seq", "import_id")
    names = [c for c in imports.columns if c not in ("owner_id", "source_id")]
    return imports.groupBy("owner_id", "source_id").agg(F.max_by(F.struct(*names), order).alias("latest")).select(
        "owner_id", "source_id", *[F.col(f"latest.{n}").alias(n) for n in names]
    )


def list_sources(sources: DataFrame, entries: DataFrame, imports: DataFrame) -> DataFrame:
    """REF-17: sources with entry counts and their latest import."""
    key = ["owner_id", "source_id"]
    counts = entries.groupBy(*key).agg(F.count("*").alias("entry_count"))
    latest = latest_imports(imports).select(*key, F.col("import_id").alias("latest_import_id"), F.col("status").alias("latest_import_status"))
    return sources.join(counts, key, "left").join(latest, key, "left").withColumn(
        "entry_count", F.coalesce("entry_count", F.lit(0).cast("bigint"))
    )


def source_details(sources: DataFrame, entries: DataFrame, imports: DataFrame, runs: DataFrame, entry_status: DataFrame) -> DataFrame:
    """REF-18: source list plus latest run and matched entry counts."""
    key = ["owner_id", "source_id"]
    order = F.struct("created_seq", "run_id")
    last_run = runs.groupBy(*key).agg(
        F.max_by("run_id", order).alias("latest_run_id"), F.max_by("status", order).alias("latest_run_status")
    )
    matched = entries.select(*key, "entry_id").join(entry_status.select("entry_id", "has_reference_match"), "entry_id", "left").groupBy(*key).agg(
        F.count_if(F.coalesce("has_reference_match", F.lit(False))).alias("matched_entry_count")
    )
    return (
        list_sources(sources, entries, imports).join(last_run, key, "left").join(matched, key, "left")
        .withColumn("matched_entry_count", F.coalesce("matched_entry_count", F.lit(0).cast("bigint")))
        .withColumn("unmatched_entry_count", F.col("entry_count") - F.col("matched_entry_count"))
    )


def next_source_keys(existing_keys: DataFrame, names: DataFrame) -> DataFrame:
    """SCL-19: slug of each new source name with the next free suffix.

    ``names``: owner_id, seq, display_name.  Within an owner and slug the first
    free key has no suffix, later ones count from two, skipping taken keys.
    """
    from lexloom.functions.text import slug

    wanted = names.withColumn("slug", slug(F.col("display_name")))
    order = Window.partitionBy("owner_id", "slug").orderBy("seq")
    wanted = wanted.withColumn("k", F.row_number().over(order))
    sizes = wanted.groupBy("owner_id", "slug").agg(F.max("k").alias("n"))
    # As many suffixes as could be needed: one per new name and one per taken key.
    taken_sizes = (
        existing_keys.withColumn("slug", F.regexp_replace("source_key", r"_\d+$", ""))
        .select("owner_id", "source_key", F.explode(F.array_distinct(F.array("slug", "source_key"))).alias("slug"))
    )
    counts = taken_sizes.groupBy("owner_id", "slug").agg(F.count("*").alias("taken"))
    free = (
        sizes.join(counts, ["owner_id", "slug"], "left")
        .withColumn("j", F.explode(F.sequence(F.lit(1), (F.col("n") + F.coalesce("taken", F.lit(0))).cast("int"))))
        .withColumn("source_key", F.when(F.col("j") == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", F.col("j"))))
        .join(existing_keys.select("owner_id", "source_key"), ["owner_id", "source_key"], "left_anti")
    )
    place = Window.partitionBy("owner_id", "slug").orderBy("j")
    numbered = free.withColumn("k", F.row_number().over(place)).select("owner_id", "slug", "k", "source_key")
    return wanted.join(numbered, ["owner_id", "slug", "k"]).drop("k")
