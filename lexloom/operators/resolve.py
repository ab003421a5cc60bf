"""Dictionary lemma of a form (RES)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lexloom.functions import profiles as pf, text as tx

FORM_KEY = ["owner_id", "normalized_form"]
UNTRUSTED_KEYS = ("fuzzy", "fuzzy_ocr", "ocr_correction_candidate")


def _first(rows: DataFrame, key: list[str], *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def approved_mappings(forms: DataFrame, mappings: DataFrame) -> DataFrame:
    """RES-1: best approved mapping per form; own rows first, then profile, confidence, lemma.

    ``forms``: owner_id, normalized_form, language_profile.
    """
    usable = mappings.where(
        (F.col("review_status") == "approved")
        & (F.col("mapping_type") != "ocr_correction_candidate")
        & (F.col("source_key").isNull() | ~F.col("source_key").isin(*UNTRUSTED_KEYS))
    ).select(
        F.col("owner_id").alias("mapping_owner"), F.col("normalized_surface_form").alias("normalized_form"),
        "dictionary_lemma", "normalized_dictionary_lemma", "source_key", "source_type",
        F.col("language_profile").alias("mapping_profile"), "confidence",
    )
    own = usable.where(F.col("mapping_owner").isNotNull()).withColumn("owner_id", F.col("mapping_owner"))
    shared = usable.where(F.col("mapping_owner").isNull())
    hits = forms.join(own.drop("mapping_owner"), FORM_KEY).withColumn("is_own", F.lit(0)).unionByName(
        forms.join(shared.drop("mapping_owner"), "normalized_form").withColumn("is_own", F.lit(1))
    )
    wanted, got = F.col("language_profile"), F.col("mapping_profile")
    place = (
        F.when(wanted == "unknown", F.when(got == "unknown", 0).when(got == "mixed", 1).otherwise(2))
        .otherwise(F.when(got == wanted, 0).when(got == "mixed", 1).when(got == "unknown", 2).otherwise(3))
    )
    best = _first(
        hits, [*FORM_KEY, "language_profile"], "is_own", place, F.coalesce("confidence", F.lit(0.0)).desc(),
        "normalized_dictionary_lemma",
    )
    return best.select(
        *FORM_KEY, "language_profile", F.col("dictionary_lemma").alias("lemma"),
        F.col("normalized_dictionary_lemma").alias("normalized_lemma"),
        F.coalesce("source_key", "source_type").alias("source"),
        F.coalesce("confidence", F.lit(0.9)).alias("confidence"),
    )


def curated_lemmas(lexeme_forms: DataFrame, lexemes: DataFrame) -> DataFrame:
    """RES-2: oldest lexeme that holds the form."""
    rows = lexeme_forms.join(lexemes, ["owner_id", "lexeme_id"])
    return _first(rows, FORM_KEY, "created_seq", "lexeme_id").select(
        *FORM_KEY, F.col("canonical_form").alias("lemma"),
        F.col("canonical_normalized_form").alias("normalized_lemma"),
        F.lit("internal_curated_lexeme_forms").alias("source"), F.lit(1.0).alias("confidence"),
    )


def imported_lemmas(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """RES-3: first active entry of the form that names a lemma."""
    active = sources.where("is_active").select("owner_id", "source_id", "display_name")
    lemma = pf.dictionary_lemma(F.col("metadata"))
    rows = (
        entries.withColumn("lemma", lemma).where(F.col("lemma").isNotNull())
        .withColumn("normalized_lemma", tx.normalize_token(F.col("lemma")))
        .where(F.col("normalized_lemma") != "")
        .join(active, ["owner_id", "source_id"])
    )
    return _first(rows, FORM_KEY, "display_name", "surface_form", "source_id", "entry_id").select(
        *FORM_KEY, "lemma", "normalized_lemma", F.lit("imported_reference").alias("source"), F.lit(0.85).alias("confidence")
    )


def resolve_lemmas(
    forms: DataFrame,
    mappings: DataFrame,
    lexeme_forms: DataFrame,
    lexemes: DataFrame,
    entries: DataFrame,
    sources: DataFrame,
    morphology_lemmas: DataFrame,
) -> DataFrame:
    """RES-4: mapping, then curated lexeme, then imported entry, then tagger lemma.

    ``forms``: owner_id, normalized_form, language_profile.  ``morphology_lemmas``:
    the forms' key columns plus morphological_lemma; extra key columns such as
    document_id are kept.
    """
    key = [c for c in morphology_lemmas.columns if c != "morphological_lemma"]

    def tagged(rows: DataFrame, name: str, kind: str) -> DataFrame:
        fields = F.struct("lemma", "normalized_lemma", "source", "confidence", F.lit(kind).alias("resolution_type"))
        return rows.select(*[c for c in rows.columns if c in (*FORM_KEY, "language_profile")], fields.alias(name))

    scope = forms.select(*FORM_KEY, "language_profile").distinct()
    chosen = F.coalesce("m", "c", "i")
    return (
        forms.join(tagged(approved_mappings(scope, mappings), "m", "resolved_by_approved_lexeme_mapping"), [*FORM_KEY, "language_profile"], "left")
        .join(tagged(curated_lemmas(lexeme_forms, lexemes), "c", "resolved_by_curated_lexeme_form"), FORM_KEY, "left")
        .join(tagged(imported_lemmas(entries, sources), "i", "resolved_by_imported_reference_mapping"), FORM_KEY, "left")
        .join(morphology_lemmas, key, "left")
        .withColumn("chosen", chosen)
        .select(
            *forms.columns,
            F.col("chosen.lemma").alias("dictionary_lemma"),
            F.col("chosen.normalized_lemma").alias("normalized_dictionary_lemma"),
            F.col("chosen.source").alias("dictionary_lemma_source"),
            "morphological_lemma",
            F.when(F.col("chosen").isNotNull(), F.col("chosen.confidence"))
            .when(F.col("morphological_lemma").isNotNull(), 0.35).alias("confidence"),
            F.when(F.col("chosen").isNotNull(), F.col("chosen.resolution_type"))
            .when(F.col("morphological_lemma").isNotNull(), "morphology_fallback_only")
            .otherwise("unresolved").alias("resolution_type"),
        )
    )


def structured_lemmas(resolutions: DataFrame) -> DataFrame:
    """RES-5: dictionary lemmas to look up besides the forms themselves."""
    return (
        resolutions.where(F.coalesce("normalized_dictionary_lemma", F.lit("")) != "")
        .select("owner_id", F.col("normalized_dictionary_lemma").alias("normalized_form")).distinct()
    )
