"""Review workspace and workflow (REV)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.functions import text as tx
from lexloom.operators import lexicon as lx

FORM_KEY = ["owner_id", "normalized_form"]
QUEUE_STAGES = ("ready_for_review", "in_review", "curated_partial")


def document_word_candidates(
    slices: DataFrame, groups: DataFrame, group_status: DataFrame, snapshots: DataFrame, documents: DataFrame
) -> DataFrame:
    """REV-1: forms of every document with state, reference and external status.

    Script class and counts are the document's own.
    """
    own = slices.withColumn("dominant_script_type", lx.dominant_script()).select(
        *lx.SLICE_KEY, "occurrence_count", "page_count", "dominant_script_type"
    )
    state = groups.select(*FORM_KEY, "group_state", "linked_lexeme_id")
    status = group_status.select(*FORM_KEY, "has_reference_match", "reference_match_count")
    ext = snapshots.select("normalized_form", "external_status", F.col("match_count").alias("external_match_count"))
    form_side = state.join(status, FORM_KEY, "left").join(ext, "normalized_form", "left")
    imported = F.coalesce("has_reference_match", F.lit(False))
    return own.join(form_side, FORM_KEY, "left").join(documents.select("document_id", "title"), "document_id").withColumns({
        "imported_match": imported, "has_reference_match": imported | F.coalesce(F.col("external_status") == "found", F.lit(False)),
        "external_status": F.coalesce("external_status", F.lit("unchecked")),
    })


def status_view(rows: DataFrame, name: str = "all") -> DataFrame:
    """REV-2: views of the workspace; tokens of digits and letters never show."""
    state, script = F.col("group_state"), F.col("dominant_script_type")
    shown = rows.where(script != "digit_mixed")
    conditions = {
        "linked": state == "linked", "unlinked": (state == "unreviewed") & (script == "armenian"),
        "suspicious": (script != "armenian") & (state != "ignored_noise"), "ignored": state == "ignored_noise",
    }
    return shown.where(conditions[name]) if name in conditions else shown


def by_reference_status(rows: DataFrame, matched_keys: DataFrame, snapshots: DataFrame, status: str = "all") -> DataFrame:
    """REV-3: matched by wordlists or external results; unmatched needs a finished external lookup."""
    if status == "all":
        return rows
    keys = matched_keys.select(*FORM_KEY).distinct().withColumn("_listed", F.lit(True))
    ext = snapshots.select("normalized_form", F.col("external_status").alias("_ext"))
    marked = rows.join(keys, FORM_KEY, "left").join(ext, "normalized_form", "left")
    listed, found = F.col("_listed").isNotNull(), F.coalesce(F.col("_ext") == "found", F.lit(False))
    keep = (listed | found) if status == "matched" else (F.coalesce(F.col("_ext") == "not_found", F.lit(False)) & ~listed & ~found)
    return marked.where(keep).drop("_listed", "_ext")


def candidate_samples(occ: DataFrame) -> DataFrame:
    """REV-4: samples out of the first hundred occurrences of a form in a document, and its first five pages."""
    key = lx.SLICE_KEY
    rows = lx.first_occurrences(occ, key=("owner_id", "document_id", "normalized_token")).withColumnRenamed("normalized_token", "normalized_form")
    samples = lx.first_values(rows, key, {"sample_tokens": F.col("token"), "sample_contexts": F.col("context_snippet")}, F.col("rank"))
    order = Window.partitionBy(*key).orderBy("page_number")
    pages = lx.slice_pages(occ).withColumn("k", F.row_number().over(order)).where(F.col("k") <= lx.SAMPLE_LIMIT)
    listed = pages.groupBy(*key).agg(F.array_sort(F.collect_list("page_number")).alias("sample_pages"))
    return samples.join(listed, key)


def source_word_candidates(entries: DataFrame, entry_status: DataFrame, lexeme_evidence: DataFrame, matched: DataFrame, status: str = "all", search: str | None = None) -> DataFrame:
    """REV-5: wordlist entries with their status and first lexeme."""
    rows = entries
    if search:
        needle, raw = tx.normalize_token(F.lit(search)), F.lower(F.lit(search.strip()))
        rows = rows.where(F.contains("normalized_form", needle) | F.contains(F.lower("surface_form"), raw))
    if status != "all":
        rows = rows.join(matched.select("owner_id", "entry_id").distinct(), ["owner_id", "entry_id"], "left_semi" if status == "matched" else "left_anti")
    return rows.join(entry_status.drop("owner_id", "source_id", "matching_lexeme_count", "best_lexeme_id"), "entry_id", "left").join(
        lexeme_evidence.select(*FORM_KEY, F.col("best_lexeme_id").alias("linked_lexeme_id"), F.col("best_lexeme_canonical_form").alias("linked_lexeme_canonical_form")),
        FORM_KEY, "left",
    )


def document_workspace_counts(rows: DataFrame, matched_keys: DataFrame) -> DataFrame:
    """REV-6: word, linked, suspicious and unmatched counts per document."""
    keys = matched_keys.select(*FORM_KEY).distinct().withColumn("_listed", F.lit(True))
    state, script = F.col("group_state"), F.col("dominant_script_type")
    return rows.join(keys, FORM_KEY, "left").groupBy("owner_id", "document_id").agg(
        F.count("*").alias("word_candidate_count"), F.count_if(state == "linked").alias("linked_candidate_count"),
        F.count_if((script != "armenian") & (state != "ignored_noise")).alias("suspicious_candidate_count"),
        F.count_if(F.col("_listed").isNull()).alias("unmatched_candidate_count"),
    )


def source_workspace_counts(entries: DataFrame, matched: DataFrame) -> DataFrame:
    """REV-6: imported, matched and unmatched entries per source."""
    keys = matched.select("entry_id").distinct().withColumn("_m", F.lit(True))
    return entries.join(keys, "entry_id", "left").groupBy("owner_id", "source_id").agg(
        F.count("*").alias("imported_entry_count"), F.count_if(F.col("_m").isNotNull()).alias("matched_entry_count"),
        F.count_if(F.col("_m").isNull()).alias("unmatched_entry_count"),
    )


def workflow_stage(status: Column, candidates: Column, linked: Column) -> Column:
    """REV-7: stage of a document."""
    return (
        F.when(status == "failed", "failed").when(status.isin("queued", "processing"), "ingesting").when(status == "uploaded", "uploaded")
        .when(candidates == 0, "curated_complete").when(linked > 0, "in_review").otherwise("ready_for_review")
    )


def workflow(documents: DataFrame, slices: DataFrame, groups: DataFrame) -> DataFrame:
    """REV-7: review counts and stage of every document."""
    state, script = F.col("group_state"), F.col("dominant_script_type")
    counts = slices.select(*lx.SLICE_KEY).join(groups.select(*FORM_KEY, "group_state", "dominant_script_type"), FORM_KEY).groupBy("owner_id", "document_id").agg(
        F.count_if((state == "unreviewed") & (script == "armenian")).alias("candidate_count"), F.count_if(state == "linked").alias("linked_count"),
        F.count_if(state == "ignored_noise").alias("ignored_count"),
        F.count_if((state != "ignored_noise") & (script != "armenian")).alias("suspicious_count"),
    )
    zero = F.lit(0).cast("bigint")
    names = ("candidate_count", "linked_count", "ignored_count", "suspicious_count")
    rows = documents.select("owner_id", "document_id", "title", "status").join(counts, ["owner_id", "document_id"], "left").withColumns(
        {c: F.coalesce(c, zero) for c in names}
    )
    return rows.withColumn("stage", workflow_stage(F.col("status"), F.col("candidate_count"), F.col("linked_count"))).withColumn(
        "review_path",
        F.when(F.col("stage").isin(*QUEUE_STAGES) | (F.col("candidate_count") > 0), F.concat(F.lit("/lexicon?document_id="), "document_id", F.lit("&view=candidates"))),
    )


def review_queue(rows: DataFrame, activity: DataFrame | None = None) -> DataFrame:
    """REV-8: documents waiting for review with their place: most candidates, then latest activity.

    ``activity``: document_id, last_activity_at; documents without any come last.
    """
    waiting = rows.where(F.col("stage").isin(*QUEUE_STAGES))
    if activity is None:
        seen = waiting.withColumn("last_activity_at", F.lit(None).cast("timestamp"))
    else:
        seen = waiting.join(activity.groupBy("document_id").agg(F.max("last_activity_at").alias("last_activity_at")), "document_id", "left")
    order = Window.partitionBy("owner_id").orderBy(F.desc("candidate_count"), F.desc_nulls_last("last_activity_at"), "document_id")
    return seen.withColumn("place", F.row_number().over(order))


def touched_documents(slices: DataFrame, forms: DataFrame) -> DataFrame:
    """REV-9: documents that contain any of the forms."""
    return slices.join(forms.select(*FORM_KEY).distinct(), FORM_KEY, "left_semi").select("owner_id", "document_id").distinct()


def document_options(documents: DataFrame, search: str | None = None) -> DataFrame:
    """REV-10: documents whose title or file name contains the search text."""
    if not search or not search.strip():
        return documents
    needle = F.lower(F.lit(search.strip()))
    return documents.where(F.contains(F.lower("title"), needle) | F.contains(F.lower("original_filename"), needle))


def status_stats(documents: DataFrame) -> DataFrame:
    """REV-10: documents per owner by status."""
    s = F.col("status")
    return documents.groupBy("owner_id").agg(
        F.count("*").alias("total"), *[F.count_if(s == n).alias(n) for n in ("completed", "processing", "queued", "failed")]
    )


def corpus_profile(occ: DataFrame) -> DataFrame:
    """REV-11: words, distinct forms, noisy words and most frequent form per document."""
    noisy = F.col("script_type").isin("digit_mixed", "mixed", "other") | F.col("has_digits")
    per_form = occ.groupBy("owner_id", "document_id", "normalized_token").agg(F.count("*").alias("n"), F.count_if(noisy).alias("noisy"))
    return per_form.groupBy("owner_id", "document_id").agg(
        F.sum("n").alias("occurrence_count"), F.count("*").alias("distinct_form_count"), F.sum("noisy").alias("noisy_occurrence_count"),
        F.min_by("normalized_token", F.struct((-F.col("n")).alias("n"), "normalized_token")).alias("sample_form"),
    )


def profile_targets(profile: DataFrame) -> DataFrame:
    """REV-11: smallest, middle and noisiest document of every owner.

    The middle document is found by counting how many documents each size
    holds, so that no owner's documents are sorted in one task.
    """
    order = F.struct("occurrence_count", "document_id")
    ends = profile.groupBy("owner_id").agg(
        F.min_by("document_id", order).alias("small"),
        F.max_by("document_id", F.struct("noisy_occurrence_count", "occurrence_count", "document_id")).alias("large_noisy"),
        F.count("*").alias("n"),
    )
    sizes = profile.groupBy("owner_id", "occurrence_count").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("owner_id").orderBy("occurrence_count"))
    place = F.floor(F.col("n") / 2)
    hit = (
        sizes.withColumn("upto", upto).join(ends.select("owner_id", "n"), "owner_id")
        .where((F.col("upto") > place) & (F.col("upto") - F.col("k") <= place))
        .select("owner_id", "occurrence_count", (place - (F.col("upto") - F.col("k"))).alias("skip"))
    )
    same = profile.join(hit, ["owner_id", "occurrence_count"])
    nth = F.row_number().over(Window.partitionBy("owner_id").orderBy("document_id")) - 1
    middle = same.withColumn("i", nth).where(F.col("i") == F.col("skip")).select("owner_id", F.col("document_id").alias("medium"))
    chosen = ends.join(middle, "owner_id").select(
        "owner_id", F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("document_id")) for c in ("small", "medium", "large_noisy")])).alias("t")
    )
    return chosen.select("owner_id", "t.label", "t.document_id").join(profile, ["owner_id", "document_id"])
