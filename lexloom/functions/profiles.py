"""Language profiles, provider metadata and small value rules (SCL-14..17, 21, 25..30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexloom.functions.text import strip

# What is known about each evidence provider.
PROVIDER_COLUMNS = (
    "lookup_key string, provider_key string, provider_type string, evidence_role string, "
    "language_profile string, priority int, can_validate string, can_attest_usage boolean, "
    "can_suggest_lemma boolean, can_suggest_named_entity boolean, requires_exact_match boolean, "
    "requires_structured_headword boolean, default_runtime string, source_group string, source_kind string"
)
PROVIDERS = [
    ("internal_lexicon", "internal_lexicon", "curated_lexicon", "curated_truth", "mixed", 1, "yes", False, False, False, True, False, "local", "internal_lexicon", "curated"),
    ("imported_references", "imported_references", "imported_dictionary", "structured_dictionary_headword", "mixed", 2, "yes", False, False, False, True, False, "local", "imported_references", "dictionary"),
    ("imported_reference", "imported_references", "imported_dictionary", "structured_dictionary_headword", "mixed", 2, "yes", False, False, False, True, False, "local", "imported_references", "dictionary"),
    ("calfa_classical_lexical_db", "calfa_classical_lexical_db", "dictionary", "structured_dictionary_headword", "classical", 3, "yes", False, False, False, True, True, "disabled", "calfa", "dictionary"),
    ("pie_classical_morphology", "pie_classical_morphology", "morphology", "lemma_pos_features", "classical", 10, "no", False, True, False, False, False, "local", "pie_dalih", "morphology"),
    ("pie_eastern_morphology", "pie_eastern_morphology", "morphology", "lemma_pos_features", "eastern", 11, "no", False, True, False, False, False, "local", "pie_dalih", "morphology"),
    ("eanc_eastern_corpus", "eanc_eastern_corpus", "corpus", "corpus_attestation", "eastern", 20, "no", True, False, False, False, False, "disabled", "eanc", "corpus"),
    ("nayiri_western_corpus", "nayiri_western_corpus", "corpus", "corpus_attestation", "western", 21, "no", True, False, False, False, False, "local", "nayiri_corpus", "corpus"),
    ("nayiri_corpus", "nayiri_western_corpus", "corpus", "corpus_attestation", "western", 21, "no", True, False, False, False, False, "local", "nayiri_corpus", "corpus"),
    ("pioner_ner", "pioner_ner", "ner", "named_entity_signal", "eastern", 30, "no", False, False, True, False, False, "local", "pioner", "ner"),
    ("nayiri_web", "nayiri_web", "external_reference", "classified_external_result", "mixed", 50, "conditional", False, False, False, False, True, "cached_only", "nayiri_web", "external"),
    ("strict_validation", "strict_validation", "validation", "artifact_filter", "mixed", 0, "no", False, False, False, False, False, "local", "strict_validation", "external"),
]
CORPUS_PROVIDER = "nayiri_western_corpus"
ENTITY_PROVIDER = "pioner_ner"
WEB_PROVIDER = "nayiri_web"
KNOWN_PROFILES = ("classical", "eastern", "western", "mixed", "unknown")
CLASSICAL_NAMES = ("grabar", "old_armenian", "xcl", "classical_armenian")
DICTIONARY_TYPES = ("reference", "imported_dictionary", "dictionary", "external_dictionary", "web_dictionary")
DEFINITION_KEYS = ("definition", "gloss", "translation", "description")
LEMMA_KEYS = ("dictionary_lemma", "headword", "lemma", "canonical_form", "canonical_headword", "entry_headword")


def language_profile(value: Column) -> Column:
    """SCL-14: one of the known profiles."""
    v = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when(v.isin(*CLASSICAL_NAMES), "classical").when(v.isin(*KNOWN_PROFILES), v).otherwise("unknown")


def profile_weight(source: Column, document: Column) -> Column:
    """SCL-15: 1.0 for compatible profiles, 0.7 between the modern ones, else 0.55."""
    s, d = language_profile(source), language_profile(document)
    open_ = ("mixed", "unknown")
    return (
        F.when(d.isin(*open_) | s.isin(*open_) | (s == d), 1.0)
        .when(s.isin("western", "eastern") & d.isin("western", "eastern"), 0.7)
        .otherwise(0.55)
    )


def adjusted_confidence(confidence: Column, source: Column, document: Column) -> Column:
    """SCL-17."""
    return F.round(confidence * profile_weight(source, document), 3)


def provider_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVIDERS, PROVIDER_COLUMNS)


def with_provider_metadata(rows: DataFrame) -> DataFrame:
    """SCL-16: provider facts by key, else derived from the provider type.

    The table has a dozen fixed rows, so it is broadcast.
    """
    known = provider_table(rows.sparkSession).select(
        F.col("lookup_key").alias("_key"),
        F.struct(
            "provider_type", "evidence_role", "language_profile", "priority", "can_validate", "can_attest_usage",
            "can_suggest_lemma", "can_suggest_named_entity", "requires_exact_match", "requires_structured_headword",
            "default_runtime", "source_group", "source_kind",
        ).alias("known"),
    )
    kind = strip(F.coalesce(F.col("provider_type"), F.lit("external_reference")))
    dictionary = kind.isin(*DICTIONARY_TYPES)
    fallback = F.struct(
        F.when(kind == "reference", "imported_dictionary").otherwise(kind).alias("provider_type"),
        F.when(dictionary, "structured_dictionary_headword").otherwise("classified_external_result").alias("evidence_role"),
        F.lit("unknown").alias("language_profile"),
        F.lit(100).alias("priority"),
        F.when(dictionary, "yes").otherwise("no").alias("can_validate"),
        F.lit(False).alias("can_attest_usage"),
        F.lit(False).alias("can_suggest_lemma"),
        F.lit(False).alias("can_suggest_named_entity"),
        dictionary.alias("requires_exact_match"),
        dictionary.alias("requires_structured_headword"),
        F.when(dictionary, "local").otherwise("disabled").alias("default_runtime"),
        F.coalesce(F.nullif(strip(F.col("provider_key")), F.lit("")), F.lit("unknown")).alias("source_group"),
        F.when(dictionary, "dictionary").otherwise("external").alias("source_kind"),
    )
    return (
        rows.join(F.broadcast(known), strip(F.col("provider_key")) == F.col("_key"), "left")
        .withColumn("metadata", F.coalesce(F.col("known"), fallback))
        .drop("_key", "known")
    )


def definition_quality(metadata: Column) -> Column:
    """SCL-25: good when any definition-like value is not blank."""
    filled = [F.coalesce(strip(metadata[k]) != "", F.lit(False)) for k in DEFINITION_KEYS]
    any_filled = filled[0]
    for f in filled[1:]:
        any_filled = any_filled | f
    return F.when(any_filled, "good").otherwise("missing")


def dictionary_lemma(metadata: Column) -> Column:
    """SCL-26: first lemma-like value that is not blank."""
    return F.coalesce(*[F.nullif(strip(metadata[k]), F.lit("")) for k in LEMMA_KEYS])


def is_traceable(title: Column, snippet: Column, link: Column) -> Column:
    """SCL-27."""
    filled = [F.coalesce(c, F.lit("")) != "" for c in (title, snippet, link)]
    return filled[0] | filled[1] | filled[2]


def entity_confidence(confidence: Column, language_stage: Column) -> Column:
    """SCL-28: lower for classical documents, kept between 0.1 and 0.95."""
    stage = F.lower(strip(F.coalesce(language_stage, F.lit(""))))
    base = F.coalesce(confidence, F.lit(0.55)) - F.when(
        stage.isin("classical", "grabar", "old_armenian", "xcl"), 0.2
    ).otherwise(0.0)
    return F.least(F.greatest(base, F.lit(0.1)), F.lit(0.95))


def morphology_provider(model_key: Column, western: bool = False) -> Column:
    """SCL-29: provider key of a tagger model; word evidence also knows a western one."""
    key = F.lower(strip(F.coalesce(model_key, F.lit(""))))
    out = F.when(F.contains(key, F.lit("classical")) | key.isin("xcl", "grabar"), "pie_classical_morphology")
    if western:
        out = out.when(F.contains(key, F.lit("western")), "pie_western_morphology")
    return out.otherwise("pie_eastern_morphology")


def provider_profile(provider_key: Column) -> Column:
    """SCL-29: language profile of a provider."""
    return (
        F.when(provider_key == "pie_classical_morphology", "classical")
        .when(provider_key.isin("pie_eastern_morphology", ENTITY_PROVIDER), "eastern")
        .when(provider_key.isin("pie_western_morphology", CORPUS_PROVIDER, "nayiri_corpus"), "western")
        .otherwise("mixed")
    )


def document_link(document_id: Column, page_number: Column) -> Column:
    """SCL-30: link of a place in a document."""
    page = F.when(page_number > 0, F.concat(F.lit("?page="), page_number)).otherwise("")
    return F.concat(F.lit("/documents/"), document_id, page)
