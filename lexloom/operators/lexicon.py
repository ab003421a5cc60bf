"""Word index: document slices, owner-wide groups, views and listings (LEX)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.functions import text as tx

SAMPLE_LIMIT = 5
DETAIL_LIMIT = 100
SCRIPTS = ("armenian", "digit_mixed", "latin", "mixed", "other")
SLICE_KEY = ["owner_id", "normalized_form", "document_id"]
GROUP_KEY = ["owner_id", "normalized_form"]
FLAGS = ("has_armenian", "has_digits")
SCRIPT_COLUMNS = [f"n_{s}" for s in SCRIPTS]


def first_values(
    rows: DataFrame, key: Sequence[str], kinds: dict[str, Column], order: Column, limit: int = SAMPLE_LIMIT
) -> DataFrame:
    """First ``limit`` distinct values of several columns per key, in ``order``.

    Values are reduced to their first position before ranking, and ranking keeps
    ``limit`` rows per key on the map side already, so a hot key never gathers
    in one task.  Output: the key and one short array per kind.
    """
    values = rows.select(
        *key,
        order.alias("first_at"),
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])
        ).alias("v"),
    ).select(*key, "first_at", "v.kind", "v.value")
    distinct = values.groupBy(*key, "kind", "value").agg(F.min("first_at").alias("first_at"))
    rank = F.row_number().over(Window.partitionBy(*key, "kind").orderBy("first_at", "value"))
    top = distinct.withColumn("rank", rank).where(F.col("rank") <= limit)

    def listed(kind: str) -> Column:
        picked = F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "value")))
        return F.transform(F.array_sort(picked), lambda x: x["value"]).alias(kind)

    return top.groupBy(*key).agg(*[listed(k) for k in kinds])


def reading_place() -> Column:
    """Page and position as one number, nulls first; a number is aggregated in place, a struct only by sorting."""
    page, start = (F.coalesce(c, F.lit(-1)).cast("bigint") for c in ("page_number", "char_start"))
    return F.shiftleft(page, 32) + start + 1


def script_sums() -> list[Column]:
    return [F.count_if(F.col("script_type") == s).alias(f"n_{s}") for s in SCRIPTS]


def script_map() -> Column:
    """LEX-3: script counts as a map of the classes that occur."""
    pairs = F.array(
        *[F.struct(F.lit(s).alias("script"), F.col(f"n_{s}").alias("n")) for s in SCRIPTS]
    )
    return F.map_from_entries(F.filter(pairs, lambda p: p["n"] > 0))


def dominant_script() -> Column:
    """LEX-4: class with the most occurrences, ties by name, ``other`` when empty."""
    best = F.array_max(
        F.array(*[F.struct(F.col(f"n_{s}").alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s"))
                  for i, s in enumerate(SCRIPTS)])
    )
    return F.when(best["n"] > 0, best["s"]).otherwise("other")


def slice_counts(occ: DataFrame) -> DataFrame:
    """LEX-1, numbers only: per owner, form and document."""
    per_page = occ.groupBy(
        "owner_id", F.col("normalized_token").alias("normalized_form"), "document_id", "page_id"
    ).agg(F.count("*").alias("n"), *script_sums(), *[F.bool_or(c).alias(c) for c in FLAGS])
    return per_page.groupBy(*SLICE_KEY).agg(
        F.sum("n").alias("occurrence_count"),
        F.count("*").alias("page_count"),
        *[F.sum(c).alias(c) for c in SCRIPT_COLUMNS],
        *[F.bool_or(c).alias(c) for c in FLAGS],
    )


def slice_words(occ: DataFrame) -> DataFrame:
    """LEX-1, numbers and spellings: ``spellings`` holds the tokens of a form with their numbers.

    It is null where the form itself is the only one, as for most slices. All groups hold the document.
    """
    per_page = occ.groupBy(
        "document_id", "owner_id", F.col("normalized_token").alias("normalized_form"), "page_id", "token", "script_type", *FLAGS
    ).agg(F.count("*").alias("n"))
    other = F.col("token") != F.col("normalized_form")
    # Collected values are grouped by sorting in any case; sorted once before, they are grouped in one step and not in two.
    key = ["document_id", "owner_id", "normalized_form"]
    rows = per_page.sortWithinPartitions(*key).groupBy(*key).agg(
        F.sum("n").alias("occurrence_count"), F.size(F.collect_set("page_id")).cast("bigint").alias("page_count"),
        *[F.sum(F.when(F.col("script_type") == s, F.col("n")).otherwise(0)).alias(f"n_{s}") for s in SCRIPTS],
        *[F.bool_or(c).alias(c) for c in FLAGS],
        F.collect_list(F.when(other, F.struct("token", "n"))).alias("others"),
    )

    def number(found: Column, token: Column) -> Column:
        return F.aggregate(F.filter(found, lambda x: x["token"] == token), F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])

    def spelled(found: Column) -> Column:
        tokens = F.array_sort(F.array_distinct(F.transform(found, lambda x: x["token"])))
        plain = F.col("occurrence_count") - F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
        own = F.struct(F.col("normalized_form").alias("token"), plain.alias("n"))
        rest = F.transform(tokens, lambda t: F.struct(t.alias("token"), number(found, t).alias("n")))
        return F.when(plain > 0, F.concat(F.array(own), rest)).otherwise(rest)

    return rows.select(
        *SLICE_KEY, "occurrence_count", "page_count", *SCRIPT_COLUMNS, *FLAGS,
        F.when(F.size("others") > 0, spelled(F.col("others"))).alias("spellings"),
    )


def slice_samples(occ: DataFrame) -> DataFrame:
    """LEX-1, samples: first-seen tokens and contexts of each slice."""
    rows = occ.withColumnRenamed("normalized_token", "normalized_form")
    return first_values(
        rows,
        SLICE_KEY,
        {"sample_tokens": F.col("token"), "sample_contexts": F.col("context_snippet")},
        reading_place(),
    )


def slice_pages(occ: DataFrame) -> DataFrame:
    """LEX-1, pages of each slice, one row per page instead of an unbounded array."""
    return occ.select(
        "owner_id", F.col("normalized_token").alias("normalized_form"), "document_id", "page_id", "page_number"
    ).distinct()


def document_slices(occ: DataFrame) -> DataFrame:
    """LEX-1: counts and samples per owner, form and document.

    Pages are one more kind of value beside tokens and contexts, so one pass gives the counts as well.
    All its groups hold the document: occurrences that lie by document are not shuffled.
    """
    kinds = {"page": "page_id", "sample_tokens": "token", "sample_contexts": "context_snippet"}
    values = occ.select(
        "owner_id", F.col("normalized_token").alias("normalized_form"), "document_id", reading_place().alias("first_at"), "script_type", *FLAGS,
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in kinds.items()])).alias("v"),
    ).select("*", "v.kind", "v.value")
    distinct = values.groupBy(*SLICE_KEY, "kind", "value").agg(
        F.min("first_at").alias("first_at"), F.count("*").alias("n"), *script_sums(), *[F.bool_or(c).alias(c) for c in FLAGS]
    )
    rank = F.row_number().over(Window.partitionBy(*SLICE_KEY, "kind").orderBy("first_at", "value"))
    is_page = F.col("kind") == "page"
    kept = distinct.withColumn("rank", rank).where(is_page | (F.col("rank") <= SAMPLE_LIMIT))

    def listed(kind: str) -> Column:
        picked = F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "value")))
        return F.transform(F.array_sort(picked), lambda x: x["value"]).alias(kind)

    return kept.groupBy(*SLICE_KEY).agg(
        F.sum(F.when(is_page, F.col("n"))).alias("occurrence_count"),
        F.count_if(is_page).alias("page_count"),
        *[F.sum(F.when(is_page, F.col(c))).alias(c) for c in SCRIPT_COLUMNS],
        *[F.bool_or(c).alias(c) for c in FLAGS],
        listed("sample_tokens"), listed("sample_contexts"),
    )


def group_counts(slices: DataFrame) -> DataFrame:
    """LEX-2/3/4, numbers only.  A page belongs to one document, so page counts add up."""
    return (
        slices.groupBy(*GROUP_KEY)
        .agg(
            F.sum("occurrence_count").alias("occurrence_count"),
            F.count("*").alias("document_count"),
            F.sum("page_count").alias("page_count"),
            *[F.sum(c).alias(c) for c in SCRIPT_COLUMNS],
        )
        .withColumn("dominant_script_type", dominant_script())
    )


def group_samples(slices: DataFrame, documents: DataFrame) -> DataFrame:
    """LEX-2, samples: slices in document order, first-seen values.

    Tokens, contexts and the title come out of one pass, so the slices need not be stored for it.
    """
    def listed(kind: str) -> Column:
        return F.transform(kind, lambda value, pos: F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), value.alias("value")))

    title = F.array(F.struct(F.lit("sample_document_titles").alias("kind"), F.lit(0).alias("pos"), F.col("title").alias("value")))
    # A slice whose document is not known has its tokens and contexts, but no title.
    title = F.when(F.col("known"), title).otherwise(F.slice(title, 1, 0))
    titled = slices.select(*SLICE_KEY, "sample_tokens", "sample_contexts").join(
        documents.select("document_id", "title", F.lit(True).alias("known")), "document_id", "left"
    )
    values = titled.select(
        *GROUP_KEY, "document_id", F.inline(F.concat(listed("sample_tokens"), listed("sample_contexts"), title))
    )
    firsts = values.groupBy(*GROUP_KEY, "kind", "value").agg(
        F.min(F.struct("document_id", "pos")).alias("first_at")
    )
    rank = F.row_number().over(Window.partitionBy(*GROUP_KEY, "kind").orderBy("first_at", "value"))
    top = firsts.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_LIMIT)

    def picked(kind: str) -> Column:
        kept = F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "value")))
        return F.transform(F.array_sort(kept), lambda x: x["value"]).alias(kind)

    return top.groupBy(*GROUP_KEY).agg(
        picked("sample_tokens"), picked("sample_contexts"), picked("sample_document_titles")
    )


def with_state(groups: DataFrame, lexeme_forms: DataFrame, lexemes: DataFrame, reviews: DataFrame) -> DataFrame:
    """LEX-5: linked before ignored before unreviewed."""
    links = lexeme_forms.join(lexemes, ["owner_id", "lexeme_id"]).select(
        *GROUP_KEY,
        F.col("lexeme_id").alias("linked_lexeme_id"),
        F.col("canonical_form").alias("linked_lexeme_canonical_form"),
    )
    ignored = (
        reviews.where(F.col("review_status") == "ignored_noise")
        .select(*GROUP_KEY, F.lit(True).alias("is_ignored")).distinct()
    )
    return (
        groups.join(links, GROUP_KEY, "left").join(ignored, GROUP_KEY, "left")
        .withColumn(
            "group_state",
            F.when(F.col("linked_lexeme_id").isNotNull(), "linked")
            .when(F.col("is_ignored"), "ignored_noise").otherwise("unreviewed"),
        )
        .drop("is_ignored")
    )


def replace_document_pages(old: DataFrame, new: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """LEX-6: take a page delta into the occurrence set.

    Rows of a (document, page) that arrives again are replaced, so applying the
    same delta twice gives the same index.  ``pages`` names the arriving pages, also
    those without a word; without it they are taken from the rows.  The pages of a
    document come as one row: a join by document alone leaves rows that lie by document
    where they are.
    """
    touched = (new if pages is None else pages).groupBy("document_id").agg(F.collect_set("page_id").alias("_gone"))
    gone = F.coalesce(F.array_contains("_gone", F.col("page_id")), F.lit(False))
    return old.join(touched, "document_id", "left").where(~gone).select(old.columns).unionByName(new)


def refresh_slices(slices: DataFrame, occ: DataFrame, touched_documents: DataFrame) -> DataFrame:
    """LEX-6/8: recompute only the slices of the touched documents."""
    keys = touched_documents.select("document_id").distinct()
    own = occ.join(keys, "document_id", "left_semi")
    fresh = document_slices(own) if "sample_tokens" in slices.columns else slice_counts(own)
    return slices.join(keys, "document_id", "left_anti").unionByName(fresh.select(slices.columns))


def refresh_groups(groups: DataFrame, slices: DataFrame, affected_forms: DataFrame) -> DataFrame:
    """LEX-7/8: recompute the rollup of the affected forms and drop forms that vanished."""
    keys = affected_forms.select(*GROUP_KEY).distinct()
    fresh = group_counts(slices.join(keys, GROUP_KEY, "left_semi"))
    kept = groups.join(keys, GROUP_KEY, "left_anti")
    return drop_empty(kept.select(fresh.columns).unionByName(fresh))


def drop_empty(groups: DataFrame) -> DataFrame:
    """LEX-8: groups without occurrences leave the index."""
    return groups.where(F.col("occurrence_count") > 0)


def live_groups(
    occ: DataFrame,
    lexeme_forms: DataFrame,
    lexemes: DataFrame,
    reviews: DataFrame,
    document_id: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """LEX-9: groups straight from occurrences, without the stored index."""
    rows = occ if document_id is None else occ.where(F.col("document_id") == document_id)
    rows = rows.withColumnRenamed("normalized_token", "normalized_form")
    if search:
        rows = search_forms(rows, search)
    per_page = rows.groupBy(*SLICE_KEY, "page_id").agg(F.count("*").alias("n"), *script_sums())
    per_document = per_page.groupBy(*SLICE_KEY).agg(
        F.sum("n").alias("occurrence_count"), F.count("*").alias("page_count"),
        *[F.sum(c).alias(c) for c in SCRIPT_COLUMNS],
    )
    return with_state(group_counts(per_document), lexeme_forms, lexemes, reviews)


def view(groups: DataFrame, name: str) -> DataFrame:
    """LEX-10: candidates, linked, suspicious, ignored or all."""
    state, script = F.col("group_state"), F.col("dominant_script_type")
    conditions = {
        "candidates": (state == "unreviewed") & (script == "armenian"),
        "linked": state == "linked",
        "suspicious": (script != "armenian") & (state != "ignored_noise"),
        "ignored": state == "ignored_noise",
    }
    return groups.where(conditions[name]) if name in conditions else groups


def search_forms(groups: DataFrame, search: str, column: str = "normalized_form") -> DataFrame:
    """LEX-11: forms that contain the search text, compared in normalized form."""
    needle = tx.normalize_token(F.lit(search))
    return groups.where((needle == "") | F.contains(F.col(column), needle))


SORT_KEYS = ("normalized_form", "occurrence_count", "page_count", "group_state", "dominant_script_type")


def ordering(sort_by: str | None = None, descending: bool = True) -> list[Column]:
    """LEX-12: requested key, then the form."""
    key = sort_by if sort_by in SORT_KEYS else "occurrence_count"
    down = descending or sort_by not in SORT_KEYS
    return [F.col(key).desc() if down else F.col(key).asc(), F.col("normalized_form").asc()]


def page(groups: DataFrame, limit: int, offset: int = 0, sort_by: str | None = None, descending: bool = True) -> DataFrame:
    """LEX-13: one page of rows; the total is a separate count."""
    return groups.orderBy(*ordering(sort_by, descending), "owner_id").offset(offset).limit(limit)


def total(rows: DataFrame) -> DataFrame:
    """LEX-13: number of rows behind a page."""
    return rows.agg(F.count("*").alias("total"))


def document_groups(groups: DataFrame, slices: DataFrame) -> DataFrame:
    """LEX-14: groups per document; the document's own counts win."""
    own = slices.select(
        *SLICE_KEY, "occurrence_count", "page_count",
        *[F.col(c).alias(f"document_{c}") for c in ("sample_tokens", "sample_contexts") if c in slices.columns],
    )
    return groups.drop("occurrence_count", "page_count", "document_count").join(own, GROUP_KEY).withColumn(
        "document_count", F.lit(1).cast("bigint")
    )


def by_reference_status(groups: DataFrame, matched_keys: DataFrame, status: str) -> DataFrame:
    """LEX-15: keep groups with or without a reference match."""
    if status == "all":
        return groups
    keys = matched_keys.select(*GROUP_KEY).distinct()
    return groups.join(keys, GROUP_KEY, "left_semi" if status == "matched" else "left_anti")


def first_occurrences(occ: DataFrame, limit: int = DETAIL_LIMIT, key: Sequence[str] = ("owner_id", "normalized_token")) -> DataFrame:
    """LEX-16/17: first ``limit`` rows per key in page order."""
    order = Window.partitionBy(*key).orderBy(
        "page_number", F.asc_nulls_first("char_start"), "document_id"
    )
    return occ.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def group_detail(occ: DataFrame, documents: DataFrame, limit: int = DETAIL_LIMIT) -> DataFrame:
    """LEX-16: the first occurrences of every group with the highlighted range, which the index keeps with the word."""
    return first_occurrences(occ, limit).join(documents.select("document_id", "title"), "document_id").select(
        "owner_id", F.col("normalized_token").alias("normalized_form"), "rank", "document_id", "title",
        "page_id", "page_number", "token", "context_snippet", "char_start", "char_end", "highlight_start", "highlight_end",
    )


def detail_samples(occ: DataFrame, documents: DataFrame) -> DataFrame:
    """LEX-17: samples over the first hundred occurrences of a group."""
    rows = first_occurrences(occ).join(documents.select("document_id", "title"), "document_id")
    return first_values(
        rows.withColumnRenamed("normalized_token", "normalized_form"),
        GROUP_KEY,
        {
            "sample_tokens": F.col("token"),
            "sample_contexts": F.col("context_snippet"),
            "sample_document_titles": F.col("title"),
        },
        F.col("rank"),
    )


def form_script_counts(occ: DataFrame) -> DataFrame:
    """LEX-18: owner-wide counts by form and script."""
    return occ.groupBy("owner_id", F.col("normalized_token").alias("normalized_form"), "script_type").agg(
        F.count("*").alias("n")
    )
