"""Queries on entities, corpus, morphology, external cache and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom import session
from lexloom.functions import profiles as pf
from lexloom.operators import discovery as dc, entities as en, evidence as ev, external as ex, lexicon as lx, morphology as mo
from lexloom.plans.index_queries import _long
from lexloom.plans.registry import query


@query("NER-1", "SELECT source_id, conv_id, turn, entity_surface, entity_type, lower(entity_surface) normalized_surface FROM mention")
def entity_mentions(w):
    return en.mentions(w.sentences).select(
        "source_id", F.col("seq.conv_id").alias("conv_id"), F.col("seq.turn").alias("turn"), "entity_surface", "entity_type", "normalized_surface"
    )


@query("NER-2", "SELECT source_id, normalized_surface, entity_type, occurrence_count, entity_surface, confidence FROM ner")
def entity_dictionary(w):
    return w.entity_entries.drop("sample_contexts")


@query("NER-2 NER-3", """SELECT m.source_id, count(DISTINCT (conv_id, turn)) sentences_with_entities, count(*) FILTER (entity_type IN ('PER','ORG','LOC')) entity_count,
   count(*) FILTER (entity_type NOT IN ('PER','ORG','LOC')) skipped_entity_count, (SELECT count(*) FROM ner n WHERE n.source_id=m.source_id) entry_count FROM mention m GROUP BY 1""")
def entity_import_summary(w):
    found = en.mentions(w.sentences)
    out = en.import_summary(w.sentences, found).drop("sentence_count")
    turns = found.select("source_id", "seq").distinct().groupBy("source_id").agg(F.count("*").alias("sentences_with_entities"))
    return out.join(turns, "source_id")


@query("NER-3", "SELECT source_id, entity_type, count(*) entries FROM ner GROUP BY 1,2")
def entity_type_counts(w):
    return en.type_counts(w.entity_entries)


@query("SNK-8", """SELECT source_id, normalized_surface, entity_type, 2*occurrence_count occurrence_count FROM ner""")
def merged_entity_entries(w):
    from lexloom.sources import sinks

    return sinks.merge_entity_entries(w.entity_entries, w.entity_entries).select("source_id", "normalized_surface", "entity_type", "occurrence_count")


@query("SRC-10", "SELECT CAST(conv_id AS VARCHAR) source_id, surface, lemma, count(*) n FROM ctoken GROUP BY 1,2,3")
def annotated_tokens(w):
    return w.corpus_tokens.groupBy("source_id", "surface", "lemma").agg(F.count("*").alias("n"))


@query("NER-4", "SELECT surface, lemma, token_count, source_count FROM csurface")
def corpus_index(w):
    return w.corpus_index[0]


@query("NER-4", "SELECT lemma, token_count, source_count FROM clemma")
def corpus_lemma_totals(w):
    return w.corpus_index[1]


@query("NER-5 WRD-16", "SELECT normalized_form, lemma, token_count, source_count, lemma_rank::BIGINT lemma_rank FROM clookup WHERE lemma_rank<=8")
def corpus_lookup(w):
    return w.corpus_matches.where("lemma_rank <= 8").select("normalized_form", "lemma", "token_count", "source_count", *_long("lemma_rank"))


# Morphology -------------------------------------------------------------------------


@query("MOR-1 MOR-2 MOR-3 MOR-5", """SELECT page_id, char_start::BIGINT char_start, analysis_status, failure_reason, lemma, pos, model_key FROM analysis""")
def document_analyses(w):
    return w.analyses.select(
        "page_id", F.col("position").cast("bigint").alias("char_start"), "analysis_status", "failure_reason", "lemma", "pos", "model_key"
    )


@query("MOR-1", "SELECT entry_id, token token_surface, normalized_form token_normalized FROM eanalysis")
def entry_tokens(w):
    return mo.entry_tokens(w.reference_entries).select("entry_id", "token_surface", "token_normalized")


@query("MOR-2", """SELECT document_id, language_stage IN ('classical','eastern') eligible, CASE language_stage WHEN 'classical' THEN 'classical' ELSE 'eastern' END profile FROM doc""")
def analysis_scope(w):
    none, stage = F.lit(None).cast("string"), F.col("language_stage")
    return w.documents.select("document_id", mo.scope_eligible(none, stage).alias("eligible"), mo.analysis_profile(none, stage, "eastern").alias("profile"))


@query("MOR-3", """SELECT owner_id, CASE WHEN NOT has_armenian THEN 'token_not_armenian' WHEN has_latin OR has_digits THEN 'token_not_supported_for_pie' END reason, count(*) n FROM occ GROUP BY 1,2""")
def token_skip_reasons(w):
    return mo.document_tokens(w.any_occ).withColumn("reason", mo.skip_reason()).groupBy("owner_id", "reason").agg(F.count("*").alias("n"))


@query("MOR-4 MOR-5", """SELECT a.page_id, a.char_start::BIGINT char_start, a.lemma, a.pos FROM analysis a WHERE analysis_status='completed'""")
def tagged_sequences(w):
    """The stand-in tagger as a plain Python function inside the tasks."""
    from lexloom.plans.inputs import ARMENIAN

    s, ends = ARMENIAN[18], (ARMENIAN[4] + ARMENIAN[17], ARMENIAN[4] + ARMENIAN[13])

    def tagger(sequences):
        def tag(t):
            if len(t) == 1:
                return {"lemma": "_", "pos": "-", "features": "_"}
            return {"lemma": t[:-1] if t.endswith(s) else t, "pos": "VERB" if t.endswith(ends) else "NOUN", "features": "Case=Nom"}

        return [[tag(t) for t in words] for words in sequences]

    scope = w.documents.where(mo.scope_eligible(F.lit(None).cast("string"), F.col("language_stage"))).select("document_id")
    tokens = mo.document_tokens(w.any_occ).join(scope, "document_id")
    words = tokens.where(mo.skip_reason().isNull())
    tagged = mo.analyses(tokens, mo.tag_sequences(words, tagger), "xcl")
    return tagged.where("analysis_status = 'completed'").select("page_id", F.col("position").cast("bigint").alias("char_start"), "lemma", "pos")


@query("SCL-18", """SELECT page_id, char_start::BIGINT char_start, CASE WHEN plural THEN 'Acc,Nom' ELSE 'Nom' END "case", CASE WHEN plural THEN 'Plur' ELSE 'Sing' END "number" FROM analysis WHERE analysis_status='completed'""")
def parsed_features(w):
    f = F.col("morph_features")
    return w.analyses.where("analysis_status = 'completed'").select(
        "page_id", F.col("position").cast("bigint").alias("char_start"), F.array_join(f["Case"], ",").alias("case"), F.array_join(f["Number"], ",").alias("number")
    )


@query("MOR-6", """SELECT owner_id, document_id, count(*) analyzed_occurrence_count, count(*) FILTER (analysis_status='completed') completed_count, count(*) FILTER (analysis_status='skipped') skipped_count,
   count(*) FILTER (analysis_status='failed') failed_count, count(DISTINCT lower(lemma)) FILTER (analysis_status='completed' AND lemma<>'') distinct_lemma_count FROM analysis GROUP BY 1,2""")
def morphology_document_summary(w):
    return mo.document_summary(w.analyses)


@query("MOR-7", """SELECT owner_id, normalized_form, kind, value, n, row_number() OVER (PARTITION BY owner_id, normalized_form, kind ORDER BY n DESC, value) value_rank
   FROM worddist WHERE value<>''""")
def morphology_word_summary(w):
    return mo.ranked_distribution(mo.word_distribution(w.tagged_words)).withColumn("value_rank", F.col("value_rank").cast("bigint"))


@query("MOR-7", """SELECT owner_id, normalized_form, count(*) analyzed_occurrence_count, count(*) FILTER (analysis_status='completed') completed_count,
   count(*) FILTER (analysis_status='skipped') skipped_count, count(*) FILTER (analysis_status='failed') failed_count FROM analysis GROUP BY 1,2""")
def morphology_word_counts(w):
    return mo.word_counts(w.analyses)


@query("MOR-8", """SELECT owner_id, normalized_form, arg_min(value, (-n, value)) best_lemma, count(*) lemma_candidates FROM worddist WHERE kind='lemma' AND value<>'' GROUP BY 1,2""")
def best_lemmas(w):
    return mo.best_lemmas(mo.word_distribution(w.tagged_words))


@query("DSC-31", """WITH c AS (SELECT document_id, normalized_form, 'lemma' kind, lower(lemma) AS value, count(*) n FROM analysis WHERE analysis_status='completed' AND lemma<>'' GROUP BY ALL
     UNION ALL SELECT document_id, normalized_form, 'pos', pos, count(*) FROM analysis WHERE analysis_status='completed' GROUP BY ALL
     UNION ALL SELECT document_id, normalized_form, 'feature', 'Number='||CASE WHEN plural THEN 'Plur' ELSE 'Sing' END, count(*) FROM analysis WHERE analysis_status='completed' GROUP BY ALL
     UNION ALL SELECT document_id, normalized_form, 'feature', 'Case='||CASE WHEN plural THEN 'Acc,Nom' ELSE 'Nom' END, count(*) FROM analysis WHERE analysis_status='completed' GROUP BY ALL)
   SELECT document_id, normalized_form, kind, value, n, row_number() OVER (PARTITION BY document_id, normalized_form, kind ORDER BY n DESC, value)::BIGINT value_rank FROM c""")
def morphology_payload(w):
    key = ["document_id", "normalized_form"]
    done = w.tagged_document_words.where("analysis_status = 'completed'").withColumn("normalized_form", F.col("token_normalized"))
    count = lambda rows, col: rows.where(F.coalesce(col, F.lit("")) != "").groupBy(*key, F.col(col).alias("value")).agg(F.sum("n").alias("n"))
    features = done.select(*key, "n", F.explode("morph_features").alias("k", "v")).withColumn("f", F.concat("k", F.lit("="), F.array_join("v", ",")))
    out = mo.summary_payload(count(done, "lemma_normalized"), count(done, "pos"), count(features, "f"), key)
    return out.select(*key, "kind", "value", "n", *_long("value_rank"))


# External cache ---------------------------------------------------------------------


@query("EXT-1 EXT-5", """SELECT normalized_form normalized_query, cache_id, status, CASE WHEN expires_at IS NULL THEN -1 ELSE epoch(expires_at)::BIGINT END expires_epoch FROM ecache WHERE k=2""")
def latest_cache_rows(w):
    return ex.latest_cache(w.external_cache).select(
        "normalized_query", "cache_id", "status", F.coalesce(F.unix_timestamp("expires_at"), F.lit(-1)).cast("bigint").alias("expires_epoch")
    )


@query("EXT-2 EXT-3", """SELECT f.normalized_form, CASE WHEN NOT coalesce(c.fresh,false) OR c.status='failed' THEN 'unavailable' WHEN c.results>0 THEN 'completed' ELSE 'no_results' END lookup_status
   FROM allform f LEFT JOIN ecur c USING (normalized_form)""")
def lookup_status(w):
    return ex.lookup_status(w.lookup_forms, w.providers, w.external_cache, w.external_results, "normalized", w.now)


@query("EXT-2", """SELECT c.normalized_form, r.matched_form, r.source_title, r.reference_link, r.match_score FROM ecur c JOIN eresult r USING (cache_id) WHERE c.fresh""")
def cached_lookup_items(w):
    return ex.cached_items(w.providers, w.external_cache, w.external_results, "normalized", w.now).select(
        "normalized_form", "matched_form", "source_title", "reference_link", "match_score"
    )


@query("EXT-4 SCL-27", """SELECT cache_id, matched_form, source_title FROM (SELECT *, row_number() OVER (PARTITION BY cache_id, matched_form ORDER BY result_seq) k FROM eresult) WHERE k=1""")
def sanitized_items(w):
    """Each result arrives twice with stray blanks, and once without anything to trace it by."""
    base = w.external_results.select(
        F.col("cache_id").alias("query_key"), F.lit("nayiri_web").alias("provider_key"), "matched_form", "normalized_form", "source_title", "snippet", "reference_link",
        F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("copy"), "result_seq",
    )
    gone = F.col("copy") == 3
    noisy = base.withColumns({
        "matched_form": F.concat(F.lit(" "), "matched_form", F.lit(" ")),
        "source_title": F.when(gone, "  ").otherwise(F.concat("source_title", F.lit(" "))),
        "snippet": F.when(~gone, F.col("snippet")), "reference_link": F.when(~gone, F.col("reference_link")),
        "seq": F.col("result_seq") * 10 + F.col("copy"),
    })
    return ex.sanitize(noisy).select(F.col("query_key").alias("cache_id"), "matched_form", "source_title")


@query("EXT-6", """SELECT s.normalized_form, s.external_status, CASE WHEN external_status='found' THEN s.results ELSE 0 END::BIGINT match_count,
   CASE WHEN external_status='found' THEN s.normalized_form END matched_form,
   CASE WHEN external_status<>'found' THEN 'unresolved' WHEN query_text=s.normalized_form THEN 'direct_match' ELSE 'canonicalized_by_nayiri' END canonicalization_status FROM snap s""")
def external_snapshots(w):
    return w.snapshots.select("normalized_form", "external_status", "match_count", "matched_form", "canonicalization_status")


@query("EXT-7", "SELECT normalized_form, external_status FROM snap WHERE external_status IN ('found','not_found')")
def external_found_forms(w):
    parts = [ex.found_forms(w.snapshots, s).withColumn("external_status", F.lit(s)) for s in ("found", "not_found")]
    return parts[0].unionByName(parts[1])


DOCFORMS = "(SELECT DISTINCT owner_id, document_id, normalized_token normalized_form FROM occ)"


@query("EXT-8", f"""SELECT owner_id, document_id, count(*) FILTER (external_status='found') found_count, count(*) FILTER (external_status='not_found') not_found_count,
   count(*) FILTER (external_status NOT IN ('found','not_found')) unchecked_count, count(*) total_forms FROM {DOCFORMS} JOIN snap USING (normalized_form) GROUP BY 1,2""")
def external_document_summary(w):
    return ex.document_summary(w.slice_numbers.select("owner_id", "document_id", "normalized_form"), w.snapshots)


@query("EXT-9", f"""SELECT owner_id, document_id, count(*) FILTER (NOT coalesce(c.fresh,false)) checked_count, count(*) FILTER (coalesce(c.fresh,false)) skipped_count
   FROM {DOCFORMS} LEFT JOIN ecur c USING (normalized_form) GROUP BY 1,2""")
def pending_lookup_counts(w):
    forms = w.slice_numbers.select("owner_id", "document_id", "normalized_form")
    return ex.pending_counts(forms, ex.pending_forms(forms, w.external_cache, w.now))


def _best_corpus(w, pending):
    """First corpus lemma of the pending forms alone; what is looked up elsewhere needs no lemmas resolved here."""
    found = w.__dict__.get("corpus_matches")
    if found is None:
        found = en.corpus_lookup(pending.select("normalized_form").distinct(), *w.corpus_index, limit=1)
    return found.where("lemma_rank = 1")


@query("EXT-10", f"""SELECT DISTINCT d.normalized_form, c.lemma matched_form, 'Matched across '||c.source_count||' corpus document(s).' snippet FROM {DOCFORMS} d JOIN clookup c ON c.normalized_form=d.normalized_form AND c.lemma_rank=1
   LEFT JOIN ecur e ON e.normalized_form=d.normalized_form WHERE NOT coalesce(e.fresh,false)""")
def corpus_filled_cache(w):
    pending = ex.pending_forms(w.slice_numbers.select("owner_id", "document_id", "normalized_form"), w.external_cache, w.now)
    return ex.fill_from_corpus(pending, _best_corpus(w, pending)).select("normalized_form", "matched_form", "snippet")


LOOKED_UP = """(SELECT DISTINCT normalized_form FROM vocab UNION SELECT lower(lemma) FROM analysis WHERE analysis_status='completed' AND lower(lemma)<>normalized_form AND length(lemma)%2=0)"""
REUSED = f"""(SELECT d.owner_id, d.normalized_form, lower(b.best) lemma_form, i, CASE i WHEN 1 THEN lower(b.best) ELSE lower(b.best)||'x' END matched_form FROM (SELECT DISTINCT owner_id, normalized_form FROM {DOCFORMS}) d
   JOIN (SELECT owner_id, normalized_form, arg_min(value, (-n, value)) best FROM worddist WHERE kind='lemma' AND value<>'' GROUP BY 1,2) b ON b.normalized_form=d.normalized_form AND b.owner_id=d.owner_id, (VALUES (1),(2)) t(i)
   WHERE lower(b.best)<>d.normalized_form AND d.normalized_form NOT IN (SELECT normalized_form FROM {LOOKED_UP}) AND lower(b.best) IN (SELECT normalized_form FROM {LOOKED_UP})
   AND length(b.best)%5<>0 AND length(b.best)%9<>0)"""


def _lemma_results(w):
    """The cache also holds the lemmas of even length; their results serve the forms that were never looked up."""
    done = w.tagged_words.where("analysis_status = 'completed' and lemma_normalized <> token_normalized and length(lemma_normalized) % 2 = 0")
    cache = w.cache_of(w.vocabulary.select("normalized_form").union(done.select("lemma_normalized")).distinct())
    pending = ex.pending_forms(w.slice_numbers.select("owner_id", "document_id", "normalized_form"), cache, w.now)
    items = ex.cached_items(w.providers, cache, w.results_of(cache), "normalized", w.now)
    return ex.reuse_lemma_results(pending, mo.best_lemmas(mo.word_distribution(w.tagged_words)), items)


@query("EXT-10", f"SELECT owner_id, normalized_form, lemma_form canonical_lookup_query, matched_form FROM {REUSED}")
def lemma_filled_cache(w):
    return _lemma_results(w).select("owner_id", "normalized_form", "canonical_lookup_query", "matched_form")


@query("EXT-10", f"""WITH f AS (SELECT normalized_form, 'lemma' origin, matched_form, lemma_form detail, false expires FROM {REUSED} UNION
   SELECT d.normalized_form, 'corpus', c.lemma, c.source_count::VARCHAR, false FROM {DOCFORMS} d JOIN clookup c ON c.normalized_form=d.normalized_form AND c.lemma_rank=1
   LEFT JOIN ecur e ON e.normalized_form=d.normalized_form WHERE NOT coalesce(e.fresh,false))
   SELECT normalized_form, origin, matched_form, detail, expires, count(*) OVER (PARTITION BY normalized_form, origin) cached_results FROM f""")
def stored_lookup_rows(w):
    """Cache rows with their results, as filled from lemmas and from the corpus; such rows never expire."""
    pending = ex.pending_forms(w.slice_numbers.select("owner_id", "document_id", "normalized_form"), w.external_cache, w.now)
    parts = {"lemma": (_lemma_results(w), "canonical_lookup_query"), "corpus": (ex.fill_from_corpus(pending, _best_corpus(w, pending)), "source_count")}
    out = []
    for origin, (filled, detail) in parts.items():
        cache, results = ex.cache_rows(filled, "nayiri_web", w.now)
        counts = ex.result_counts(results).withColumnRenamed("result_count", "cached_results")
        out.append(cache.join(results.drop("provider_key"), "cache_id").join(counts, "cache_id").select(
            F.col("normalized_query").alias("normalized_form"), F.lit(origin).alias("origin"), "matched_form", F.col("metadata")[detail].alias("detail"),
            F.col("expires_at").isNotNull().alias("expires"), *_long("cached_results"),
        ))
    return out[0].unionByName(out[1])


# Candidates --------------------------------------------------------------------------


@query("DSC-1", """SELECT owner_id, document_id, nf normalized_form, n occurrence_count, pages page_count, has_armenian, has_digits, dominant_script_type FROM bucket""")
def form_buckets(w):
    return dc.form_buckets(w.page_words).select(
        "owner_id", "document_id", "normalized_form", "occurrence_count", "page_count", "has_armenian", "has_digits", "dominant_script_type"
    )


@query("DSC-1", """SELECT document_id, nf normalized_form, string_agg(page_number::VARCHAR, ',' ORDER BY page_number) sample_pages FROM (
   SELECT *, row_number() OVER (PARTITION BY document_id, nf ORDER BY page_number) k FROM (SELECT DISTINCT document_id, normalized_token nf, page_number FROM occ)) WHERE k<=5 GROUP BY 1,2""")
def bucket_sample_pages(w):
    return dc.bucket_samples(w.any_occ).select("document_id", "normalized_form", F.array_join("sample_pages", ",").alias("sample_pages"))


def _scope(w):
    stage = w.documents.select("document_id", F.col("language_stage").alias("profile"))
    scope = w.buckets.join(stage, "document_id").select(*ev.SCOPE_KEY).distinct()
    r = w.resolutions
    ok = F.col("resolution_type").startswith("resolved_")
    return scope.join(r.select(
        "owner_id", "normalized_form", F.col("language_profile").alias("profile"), F.when(ok, F.col("dictionary_lemma")).alias("dictionary_lemma"),
        F.when(ok, F.col("normalized_dictionary_lemma")).alias("normalized_dictionary_lemma"), F.when(ok, F.col("confidence")).alias("resolution_confidence"),
    ), ["owner_id", "normalized_form", "profile"], "left")


@query("DSC-2 DSC-3 DSC-4 DSC-5 DSC-7 DSC-8 DSC-9 DSC-10 DSC-11 DSC-12", """SELECT owner_id, nf normalized_form, profile, has_digits, pk provider_key, pt provider_type, mf matched_form, hw result_headword,
   nullif(lem,'') lemma, mt match_type, vs validation_strength, es evidence_strength, dq definition_quality, round(conf,3) confidence, ex is_exact, ord::BIGINT ordinal FROM evid WHERE document_id IS NULL""")
def evidence_union(w):
    rows = ev.form_evidence(
        _scope(w), w.lexeme_map, ev.top_references(w.reference_entries, w.reference_sources), w.corpus_matches,
        (w.entity_entries, w.ner_sources), w.latest_external,
    )
    return rows.select(
        *ev.SCOPE_KEY, "provider_key", "provider_type", "matched_form", "result_headword", "lemma", "match_type", "validation_strength",
        "evidence_strength", "definition_quality", F.round("confidence", 3).alias("confidence"), F.coalesce("is_exact", F.lit(False)).alias("is_exact"), *_long("ordinal"),
    )


@query("DSC-6", """SELECT owner_id, document_id, nf normalized_form, pk provider_key, lem lemma, mt match_type, round(conf,3) confidence FROM evid WHERE document_id IS NOT NULL""")
def morphology_evidence(w):
    lemmas, main = dc.morphology_buckets(w.tagged_document_words)
    stage = w.documents.select("document_id", F.col("language_stage").alias("profile"))
    rows = lemmas.join(w.buckets.select(*dc.BUCKET_KEY, "has_digits"), dc.BUCKET_KEY).join(stage, "document_id").join(main.drop("morphology_plausible"), dc.BUCKET_KEY)
    return ev.morphology_evidence(rows).select("owner_id", "document_id", "normalized_form", "provider_key", "lemma", "match_type", F.round("confidence", 3).alias("confidence"))


@query("DSC-13 DSC-15", """SELECT owner_id, nf normalized_form, profile, has_digits, arg_min(pk, (p1,p2,c,pk,ord,lem)) first_provider, count(*) FILTER (usable) usable_rows FROM rankevid WHERE document_id IS NULL GROUP BY 1,2,3,4""")
def ordered_evidence(w):
    rows = ev.form_evidence(
        _scope(w), w.lexeme_map, ev.top_references(w.reference_entries, w.reference_sources), w.corpus_matches,
        (w.entity_entries, w.ner_sources), w.latest_external,
    )
    return ev.with_rank_fields(rows).groupBy(*ev.SCOPE_KEY).agg(
        F.min_by("provider_key", "evidence_order").alias("first_provider"), F.count_if("usable").alias("usable_rows")
    )


CAND = """owner_id, document_id, nf normalized_form, n occurrence_count, pages page_count, resolution_status, candidate_type, round(interest_score,2) interest_score,
   round(ocr_risk_score,2) ocr_risk_score, suppressed, review_status"""
CAND_COLS = ["owner_id", "document_id", "normalized_form", "occurrence_count", "page_count", "resolution_status", "candidate_type"]


def _cand(df):
    return df.select(*CAND_COLS, F.round("interest_score", 2).alias("interest_score"), F.round("ocr_risk_score", 2).alias("ocr_risk_score"), "suppressed", "review_status")


@query("DSC-14 DSC-17 DSC-19 DSC-21 SNK-6", f"SELECT {CAND} FROM reviewed")
def discovery_candidates(w):
    return _cand(w.any_candidates)


@query("DSC-16 DSC-18 DSC-20", """SELECT document_id, nf normalized_form, round(CASE WHEN best IS NULL THEN NULL ELSE best.conf END,3) confidence_score, round(dscore,2) definition_quality_score,
   coalesce(evidence_count,0) evidence_count, best.pk best_provider_key, best.mt best_match_type, canonical_form, coalesce(dl, canonical_form) canonical_form_candidate FROM cand""")
def candidate_evidence_summary(w):
    return w.any_candidates.select(
        "document_id", "normalized_form", F.round("confidence_score", 3).alias("confidence_score"), F.round("definition_quality_score", 2).alias("definition_quality_score"),
        "evidence_count", "best_provider_key", "best_match_type", "canonical_form", "canonical_form_candidate",
    )


@query("DSC-24", f"SELECT {CAND} FROM reviewed WHERE visible")
def discovery_visible(w):
    return _cand(dc.visible(w.any_candidates, w.buckets))


@query("DSC-23", """SELECT document_id, nf normalized_form, interest_score FROM reviewed WHERE resolution_status='unknown_plausible' AND review_status='unreviewed' AND interest_score>=60 AND contains(nf,'եղ')""")
def candidate_filters(w):
    return dc.list_candidates(w.any_candidates, "ԵՂ", resolution_status="unknown_plausible", review_status="unreviewed", min_interest_score=60).select(
        "document_id", "normalized_form", "interest_score"
    )


#: Sortable columns and their names in the SQL tables.
ORDERS = {c: {"normalized_form": "nf", "occurrence_count": "n", "page_count": "pages"}.get(c, c) for c in dc.SORTABLE}


@query("DSC-23", "SELECT sort_name, k, document_id, normalized_form FROM (" + " UNION ALL ".join(
    f"SELECT '{c}_{way}' sort_name, row_number() OVER (PARTITION BY document_id ORDER BY {own} {way}, nf) k, document_id, nf normalized_form FROM reviewed WHERE visible"
    for c, own in ORDERS.items() for way in ("asc", "desc")) + ") WHERE k<=10")
def candidate_sort_orders(w):
    """First ten visible candidates of every document in all sixteen orders."""
    from functools import reduce

    from pyspark.sql import Window

    shown = dc.visible(w.candidates, w.buckets)
    parts = []
    for name in (f"{c}_{way}" for c in ORDERS for way in ("asc", "desc")):
        order = Window.partitionBy("document_id").orderBy(*dc.candidate_order(name))
        parts.append(shown.withColumn("k", F.row_number().over(order)).where("k <= 10").select(F.lit(name).alias("sort_name"), *_long("k"), "document_id", "normalized_form"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("DSC-25", """SELECT owner_id, document_id, count(*) total_candidates, count(*) FILTER (visible) visible_candidates, count(*) FILTER (NOT visible) suppressed_candidates,
   count(*) FILTER (review_status='reviewed') reviewed_candidates, count(*) FILTER (review_status<>'reviewed') unreviewed_candidates FROM reviewed GROUP BY 1,2""")
def discovery_summary(w):
    return dc.candidate_summary(w.any_candidates)


@query("DSC-25", """SELECT owner_id, document_id, 'candidate_type' kind, candidate_type AS value, count(*) n FROM reviewed GROUP BY ALL UNION ALL
   SELECT owner_id, document_id, 'resolution_status', resolution_status, count(*) FROM reviewed GROUP BY ALL UNION ALL SELECT owner_id, document_id, 'review_status', review_status, count(*) FROM reviewed GROUP BY ALL""")
def candidate_counts(w):
    return dc.counts_by(w.any_candidates)


@query("DSC-26", """SELECT owner_id, document_id, count(*) total_grouped_forms, """ + ", ".join(f"count(*) FILTER (resolution_status='{s}') {s}" for s in dc.STATUSES)
       + """, count(*) FILTER (suppressed) suppressed, count(*) FILTER (NOT suppressed) shown_in_queue FROM cand GROUP BY 1,2""")
def build_summary(w):
    return dc.build_summary(w.any_candidates)


@query("EVT-11", """SELECT owner_id, document_id, count(*) candidate_count, count(*) FILTER (NOT suppressed) shown_count, count(*) FILTER (suppressed) suppressed_count FROM cand GROUP BY 1,2""")
def build_run_totals(w):
    return dc.run_totals(w.any_candidates)


@query("DSC-27", """SELECT o.document_id, normalized_token normalized_form, k::BIGINT AS rank, o.page_id, char_start::BIGINT char_start, token, context_snippet,
   (CASE WHEN char_start>25 THEN 3 ELSE 0 END + length(regexp_replace(regexp_replace(substr(p.page_text, greatest(char_start-25,0)+1, least(char_start,25)), '\\s+', ' ', 'g'), '^ ', '')))::BIGINT highlight_start
   FROM (SELECT *, row_number() OVER (PARTITION BY document_id, normalized_token ORDER BY page_number, char_start) k FROM occs) o JOIN page p ON p.page_id=o.page_id WHERE k<=20""")
def candidate_occurrences(w):
    return dc.candidate_occurrences(w.any_candidates, w.any_occ).select(
        "document_id", "normalized_form", *_long("rank"), "page_id", *_long("char_start"), "token", "context_snippet", *_long("highlight_start")
    )


@query("DSC-22", """WITH one AS (SELECT DISTINCT owner_id, normalized_form FROM cat WHERE display_name='wordlist-0')
   SELECT s.owner_id, b.document_id, b.nf normalized_form, b.n occurrence_count FROM bucket b JOIN doc d USING (document_id, owner_id)
   JOIN scoped s ON s.owner_id=b.owner_id AND s.nf=b.nf AND s.profile=d.language_stage AND s.has_digits=b.has_digits
   WHERE EXISTS (SELECT 1 FROM one o WHERE o.owner_id=b.owner_id AND o.normalized_form=b.nf) OR EXISTS (SELECT 1 FROM one o WHERE o.owner_id=b.owner_id AND o.normalized_form=s.ndl)""")
def reference_refresh_forms(w):
    """Candidates that a refresh from the first wordlist of every owner rebuilds."""
    first = w.reference_sources.where("display_name = 'wordlist-0'")
    refs = ev.top_references(w.reference_entries.join(first.select("source_id"), "source_id", "left_semi"), first)
    built = dc.build_candidates(w.case_buckets, w.cases, w.case_resolutions, w.lexeme_map, refs, w.tag_cases, reference_only=True, keep=session.save)
    return built.select("owner_id", "document_id", "normalized_form", "occurrence_count")


def _builds(w):
    """Full builds for completed documents, checks against single wordlists for the others."""
    n = F.length("document_id")
    at = lambda hours: F.to_timestamp(F.lit("2024-01-10 00:00:00")) + F.make_interval(hours=hours)
    full = w.documents.where("status = 'completed'").select(
        "document_id", F.concat(F.lit("full-"), "document_id").alias("build_id"), F.lit("full").alias("build_mode"), F.lit("completed").alias("status"),
        F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("import_id"), at(n * 24).alias("created_at"), at(n * 24).alias("finished_at"),
        F.lit(0).cast("bigint").alias("matched_count"), F.lit(0).cast("bigint").alias("unmatched_count"),
    )
    pairs = w.documents.where("status <> 'completed'").join(w.imports, "owner_id")
    only = pairs.where(F.col("created_seq") <= n % 3 + 1).select(
        "document_id", F.concat_ws("/", "document_id", "import_id").alias("build_id"), F.lit("reference_only").alias("build_mode"),
        F.when(F.col("created_seq") == 3, "failed").otherwise("completed").alias("status"), "source_id", "import_id",
        at(F.col("created_seq").cast("int") * 24).alias("created_at"), at(F.col("created_seq").cast("int") * 24).alias("finished_at"), F.col("created_seq").alias("matched_count"), F.lit(1).cast("bigint").alias("unmatched_count"),
    )
    return full.unionByName(only)


def _imports(w):
    return w.imports.withColumn("finished_at", F.to_timestamp(F.lit("2024-01-10 00:00:00")) + F.make_interval(days=F.col("created_seq").cast("int")))


FRESH = """WITH imp AS (SELECT owner_id, source_id, run_id import_id, created_seq seq, TIMESTAMP '2024-01-10' + to_days(CAST(created_seq AS INTEGER)) fin, display_name FROM runs r JOIN rsource s USING (owner_id, source_id) WHERE r.status='completed' AND s.is_active AND created_seq=3),
   full_ AS (SELECT document_id, TIMESTAMP '2024-01-10' + to_hours(length(document_id)*24) fin FROM doc WHERE status='completed'),
   only_ AS (SELECT d.document_id, r.source_id, r.run_id import_id, r.created_seq seq, CASE r.created_seq WHEN 3 THEN 'failed' ELSE 'completed' END st FROM doc d JOIN runs r USING (owner_id) WHERE d.status<>'completed' AND r.created_seq<=length(d.document_id)%3+1),
   fresh AS (SELECT d.owner_id, d.document_id, i.source_id, i.display_name, CASE WHEN o.st IS NULL AND f.fin>=i.fin THEN 'up_to_date' WHEN o.st IS NULL AND EXISTS (SELECT 1 FROM only_ p WHERE p.document_id=d.document_id AND p.source_id=i.source_id) THEN 'stale'
     WHEN o.st IS NULL THEN 'never_checked' WHEN o.st='failed' THEN 'failed' ELSE 'up_to_date' END status,
     CASE WHEN o.st IS NOT NULL THEN o.seq ELSE coalesce((SELECT max(seq) FROM only_ p WHERE p.document_id=d.document_id AND p.source_id=i.source_id),0) END matched_count
     FROM doc d JOIN imp i USING (owner_id) LEFT JOIN full_ f ON f.document_id=d.document_id LEFT JOIN only_ o ON o.document_id=d.document_id AND o.source_id=i.source_id AND o.import_id=i.import_id)"""


@query("DSC-28", FRESH + " SELECT owner_id, document_id, source_id, status, matched_count::BIGINT matched_count FROM fresh")
def source_freshness(w):
    return dc.evidence_freshness(w.documents, w.reference_sources, _imports(w), _builds(w)).select("owner_id", "document_id", "source_id", "status", "matched_count")


@query("DSC-29", FRESH + """ SELECT owner_id, document_id, arg_min(source_id, (p, display_name, source_id)) source_id, arg_min(status, (p, display_name, source_id)) status FROM
   (SELECT *, CASE status WHEN 'failed' THEN 0 WHEN 'never_checked' THEN 1 WHEN 'stale' THEN 2 ELSE 3 END p FROM fresh) GROUP BY 1,2""")
def source_to_refresh(w):
    return dc.source_to_refresh(dc.evidence_freshness(w.documents, w.reference_sources, _imports(w), _builds(w)))


@query("DSC-30", "SELECT owner_id, normalized_form FROM lexform UNION SELECT owner_id, normalized_form FROM cat")
def known_forms(w):
    return dc.known_forms(w.lexeme_forms, w.reference_entries, w.reference_sources)


DECIDED = """(SELECT c.*, ['mark_interesting','mark_known','mark_ocr_noise','mark_uncertain','mark_poorly_defined','create_lexeme','link_lexeme','ignore'][length(nf)%8+1] d, m.lexeme_id some_id, f.lexeme_id holder
   FROM reviewed c LEFT JOIN (SELECT owner_id, min(lexeme_id) lexeme_id FROM lexeme GROUP BY 1) m ON m.owner_id=c.owner_id LEFT JOIN lexform f ON f.owner_id=c.owner_id AND f.normalized_form=c.nf)"""


def _decisions(w):
    """A reviewer takes every visible candidate, by the length of the form; links go to the owner's first lexeme."""
    from lexloom.operators import curation as cu

    some = w.lexemes.groupBy("owner_id").agg(F.min("lexeme_id").alias("some_id"))
    decision = F.element_at(F.array(*map(F.lit, cu.DECISIONS)), (F.length("normalized_form") % 8 + 1).cast("int"))
    return dc.visible(w.candidates, w.buckets).join(some, "owner_id", "left").select(
        "document_id", "normalized_form", decision.alias("decision"), F.lit("seen").alias("note"), F.when(decision == "link_lexeme", F.col("some_id")).alias("lexeme_id")
    )


@query("CUR-9", f"""SELECT document_id, nf normalized_form, CASE WHEN visible AND (d<>'link_lexeme' OR some_id IS NOT NULL) THEN 'reviewed' ELSE review_status END review_status,
   CASE WHEN visible AND (d<>'link_lexeme' OR some_id IS NOT NULL) THEN d WHEN review_status='reviewed' THEN 'mark_known' END reviewer_decision,
   CASE WHEN visible AND d='create_lexeme' THEN coalesce(holder, 'new') WHEN visible AND d='link_lexeme' THEN coalesce(some_id, linked) ELSE linked END linked_to FROM {DECIDED}""")
def recorded_decisions(w):
    """All eight decisions; a created lexeme is the holder of the form or a new one."""
    from lexloom.operators import curation as cu

    out = cu.record_decisions(w.candidates, _decisions(w), w.lexemes, w.lexeme_forms)
    made = cu.decided_lexemes(w.candidates, _decisions(w), w.lexeme_forms)[1].select(F.col("lexeme_id").alias("linked_lexeme_id"), F.lit("new").alias("new"))
    return out.join(made, "linked_lexeme_id", "left").select(
        "document_id", "normalized_form", "review_status", "reviewer_decision", F.coalesce("new", "linked_lexeme_id").alias("linked_to")
    )


@query("CUR-9", f"SELECT DISTINCT owner_id, nf normalized_form, nf canonical_form, 'draft' status FROM {DECIDED} WHERE visible AND d='create_lexeme' AND holder IS NULL")
def decided_lexemes(w):
    from lexloom.operators import curation as cu

    rows, forms = cu.decided_lexemes(w.candidates, _decisions(w), w.lexeme_forms)
    return rows.join(forms, ["owner_id", "lexeme_id"]).select("owner_id", "normalized_form", "canonical_form", "status")


@query("SCL-14 SCL-15 SCL-17", """SELECT document_id, language_stage profile, CASE language_stage WHEN 'western' THEN 1.0 WHEN 'unknown' THEN 1.0 WHEN 'eastern' THEN 0.7 ELSE 0.55 END::DOUBLE corpus_weight,
   round(0.65::DOUBLE * (CASE language_stage WHEN 'western' THEN 1.0 WHEN 'unknown' THEN 1.0 WHEN 'eastern' THEN 0.7 ELSE 0.55 END)::DOUBLE, 3) adjusted FROM doc""")
def profile_weights(w):
    stage = F.col("language_stage")
    return w.documents.select(
        "document_id", pf.language_profile(stage).alias("profile"), pf.profile_weight(F.lit("western"), stage).alias("corpus_weight"),
        pf.adjusted_confidence(F.lit(0.65), F.lit("western"), stage).alias("adjusted"),
    )


@query("SCL-16 SCL-29", """SELECT document_id, CASE language_stage WHEN 'classical' THEN 'pie_classical_morphology' ELSE 'pie_eastern_morphology' END provider_key,
   CASE language_stage WHEN 'classical' THEN 10 ELSE 11 END::BIGINT priority, 'morphology' source_kind FROM doc""")
def provider_facts(w):
    key = pf.morphology_provider(F.col("language_stage"))
    rows = w.documents.select("document_id", key.alias("provider_key"), F.lit("morphology").alias("provider_type"))
    return pf.with_provider_metadata(rows).select("document_id", "provider_key", F.col("metadata.priority").cast("bigint").alias("priority"), F.col("metadata.source_kind").alias("source_kind"))


@query("SCL-28", """SELECT source_id, normalized_surface, entity_type, round(greatest(least(confidence-0.2, 0.95), 0.1),2) classical_confidence, round(confidence,2) other_confidence FROM ner""")
def entity_confidence(w):
    c = F.col("confidence")
    return w.entity_entries.select(
        "source_id", "normalized_surface", "entity_type", F.round(pf.entity_confidence(c, F.lit("grabar")), 2).alias("classical_confidence"),
        F.round(pf.entity_confidence(c, F.lit("western")), 2).alias("other_confidence"),
    )
