import pytest
from pyspark.sql import functions as F

from lexloom.functions import profiles as pf
from lexloom.operators import discovery as dc, evidence as ev

CASES = [
    # query, role, matched, headword, lemma, snippet, source match, tokens, sources, digits, short ok -> match, validation, strength, confidence
    (("", "reference", "ա", None, None, None, None, 0, 0, False, False), ("rejected_artifact", "rejects", "none", 0.0)),
    (("a1", "reference", "a1", None, None, None, None, 0, 0, True, False), ("rejected_artifact", "rejects", "none", 0.0)),
    (("ա", "reference", "ա", None, None, None, None, 0, 0, False, False), ("rejected_artifact", "rejects", "none", 0.0)),
    (("ա", "curated_lexicon", "ա", None, None, None, None, 0, 0, False, True), ("exact_headword_match", "validates_word", "strong", 1.0)),
    (("հայ", "reference", "Հայ", None, None, None, None, 0, 0, False, False), ("exact_headword_match", "validates_word", "strong", 0.95)),
    (("հայ", "web_dictionary", "Հայ", None, None, None, None, 0, 0, False, False), ("exact_headword_match", "validates_word", "strong", 0.9)),
    (("հայոց", "reference", "այլ", "այլ", "հայոց", None, None, 0, 0, False, False), ("exact_lemma_match", "supports_word", "medium", 0.8)),
    (("հայ", "reference", "հայերեն", None, None, None, None, 0, 0, False, False), ("substring_match", "does_not_validate", "none", 0.05)),
    (("հայ", "reference", "գիր", None, None, "մեծ հայ գիր", None, 0, 0, False, False), ("page_fulltext_occurrence", "context_only", "none", 0.05)),
    (("հայ", "reference", "գիր", None, None, None, None, 0, 0, False, False), ("ambiguous_search_result", "does_not_validate", "none", 0.05)),
    (("հայ", "reference", "հայ", None, None, None, "fuzzy", 0, 0, False, False), ("fuzzy_ocr_candidate", "suggests_candidate", "weak", 0.25)),
    (("հայ", "corpus", "հայ", None, None, None, None, 3, 1, False, False), ("corpus_token_attestation", "supports_word", "strong", 0.65)),
    (("հայ", "corpus", "հայ", None, None, None, None, 1, 1, False, False), ("corpus_token_attestation", "supports_word", "weak", 0.45)),
    (("հայ", "corpus", "հայեր", None, "հայ", None, None, 1, 1, False, False), ("corpus_lemma_attestation", "supports_word", "medium", 0.6)),
    (("հայ", "morphology", None, None, "հայ", None, None, 0, 0, False, False), ("morphology_analysis_only", "suggests_candidate", "weak", 0.35)),
    (("հայ", "named_entity_signal", None, None, None, None, None, 0, 0, False, False), ("named_entity_signal", "suggests_candidate", "medium", 0.55)),
    (("հայ", "whatever", None, None, None, None, None, 0, 0, False, False), ("ambiguous_search_result", "does_not_validate", "none", 0.05)),
]


def test_classifier(spark):
    schema = "i int, q string, role string, m string, h string, l string, s string, sm string, tc int, sc int, d boolean, ok boolean"
    rows = spark.createDataFrame([(i, *case) for i, (case, _) in enumerate(CASES)], schema)
    c = F.col
    out = ev.with_classification(rows, c("q"), c("role"), matched=c("m"), headword=c("h"), lemma=c("l"), snippet=c("s"), source_match=c("sm"),
                                 token_count=c("tc"), source_count=c("sc"), has_digits=c("d"), allow_short=c("ok"))
    got = {r.i: (r._c.match_type, r._c.validation_strength, r._c.evidence_strength, r._c.confidence) for r in out.select("i", "_c").collect()}
    for i, (case, wanted) in enumerate(CASES):
        assert got[i] == wanted, case


KEY = "owner_id string, normalized_form string, profile string, has_digits boolean"
ROW = KEY + ", " + ", ".join(f"{n} {t}" for n, t in ev.ROW_TYPES.items())


def row(form, provider, kind, match, validation, strength, quality, conf=0.5, lemma=None, matched=None, exact=True, profile="mixed"):
    return ("o", form, "unknown", False, provider, kind, profile, matched or form, matched or form, lemma, match, validation, strength, quality, conf, exact, None, None, 1)


def status_of(spark, evidence, n=1, pages=1, script="armenian", armenian=True, digits=False, plausible=False, linked=None):
    rows = spark.createDataFrame(evidence, ROW)
    key = ["owner_id", "normalized_form", "profile", "has_digits"]
    by_form = dc.summarize_evidence(rows, key)
    bucket = spark.createDataFrame(
        [("o", "d", "բառ", "unknown", digits, n, pages, script, armenian, plausible, linked)],
        "owner_id string, document_id string, normalized_form string, profile string, has_digits boolean, occurrence_count bigint, page_count bigint, "
        "dominant_script_type string, has_armenian boolean, morphology_plausible boolean, linked_lexeme_id string",
    )
    empty = dc.summarize_evidence(spark.createDataFrame([], ROW + ", document_id string"), dc.BUCKET_KEY)
    r = dc.resolve(dc.merge_summaries(bucket, by_form, empty, key)).first()
    return r


@pytest.mark.parametrize("evidence, options, wanted", [
    ([row("բառ", "internal_lexicon", "curated_lexicon", "exact_headword_match", "validates_word", "strong", "good", 1.0)], {}, ("resolved_known", 0.0)),
    ([row("բառ", "imported_references", "imported_dictionary", "exact_headword_match", "validates_word", "strong", "good", 0.95)], {}, ("resolved_by_dictionary", 0.0)),
    ([row("բառ", "imported_references", "imported_dictionary", "exact_lemma_match", "supports_word", "medium", "good", 0.8, lemma="բառ")], {}, ("resolved_by_lemma", 10.0)),
    ([row("բառ", "imported_references", "imported_dictionary", "approved_variant_match", "supports_word", "medium", "good", 0.8)], {}, ("resolved_as_variant", 15.0)),
    ([row("բառ", "nayiri_western_corpus", "corpus", "corpus_token_attestation", "supports_word", "weak", "unknown", 0.45)], {}, ("attested_in_corpus", 0.0)),
    ([row("բառ", "imported_references", "imported_dictionary", "exact_headword_match", "validates_word", "strong", "missing", 0.95)], {}, ("poorly_defined", 0.0)),
    ([row("բառ", "pioner_ner", "ner", "named_entity_signal", "suggests_candidate", "medium", "unknown", 0.55)], {}, ("possible_named_entity", 72 + 1 + 2.0)),
    ([row("բառ", "strict_validation", "validation", "rejected_artifact", "rejects", "none", "unknown", 0.0)], {}, ("probable_ocr_noise", 0.0)),
    ([row("բառ", "a", "external_dictionary", "exact_lemma_match", "supports_word", "medium", "unknown", 0.8, lemma="ա"),
      row("բառ", "b", "external_dictionary", "exact_lemma_match", "supports_word", "medium", "unknown", 0.8, lemma="բ")], {}, ("conflicting_sources", 70 + 1 + 2.0)),
    ([row("բառ", "x", "other", "fuzzy_ocr_candidate", "suggests_candidate", "weak", "unknown", 0.25)], {}, ("weakly_attested", 0.0)),
    ([], {"n": 4, "pages": 2, "plausible": True}, ("unknown_plausible", 98.0)),
    ([], {}, ("needs_linguist_research", 0.0)),
    ([], {"script": "latin", "armenian": False}, ("probable_ocr_noise", 0.0)),
    ([], {"script": "mixed"}, ("possible_ocr_noise", 55 + 1 + 2 - 30.0)),
    ([], {"script": "digit_mixed", "digits": True}, ("probable_ocr_noise", 0.0)),
    ([], {"linked": "lexeme"}, ("resolved_known", 0.0)),
])
def test_cascade(spark, evidence, options, wanted):
    r = status_of(spark, evidence, **options)
    assert (r.resolution_status, r.interest_score) == wanted


def test_canonical_form(spark):
    known = row("բառ", "internal_lexicon", "curated_lexicon", "exact_headword_match", "validates_word", "strong", "good", 1.0, matched="Բառ")
    other = row("բառ", "internal_lexicon", "curated_lexicon", "exact_headword_match", "validates_word", "strong", "good", 0.9, matched="Բառեր")
    assert status_of(spark, [known]).canonical_form == "Բառ"
    r = status_of(spark, [known, other])
    assert r.canonical_form is None and r.canonical_reason == "conflicting_sources"


def test_profiles(spark):
    rows = spark.createDataFrame([("grabar", "classical"), ("western", "eastern"), ("western", "classical"), ("western", None)], "s string, d string")
    got = [r.w for r in rows.select(pf.profile_weight(F.col("s"), F.col("d")).alias("w")).collect()]
    assert got == [1.0, 0.7, 0.55, 1.0]
    named = pf.with_provider_metadata(spark.createDataFrame([("imported_reference", "x"), ("mine", "reference"), ("mine", None)], "provider_key string, provider_type string"))
    got = {(r.metadata.provider_type, r.metadata.priority, r.metadata.can_validate) for r in named.collect()}
    assert got == {("imported_dictionary", 2, "yes"), ("imported_dictionary", 100, "yes"), ("external_reference", 100, "no")}
