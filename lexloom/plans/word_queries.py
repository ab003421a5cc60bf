"""Queries on word evidence, review workspace and workflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import entities as en, linkage as lk, review as rv, status as st, words as wd, external as ex, morphology as mo
from lexloom.plans.index_queries import _listed, _long
from lexloom.plans.registry import query

REQ = "(SELECT DISTINCT owner_id, normalized_form query_form FROM vocab)"
TOKENS = f"""SELECT r.owner_id, r.query_form, o.document_id source_id, d.title source_title, o.token word_form, o.normalized_token item_form, NULL matched_form, o.page_number, o.page_id||'@'||o.char_start item_key, 'token' via
   FROM {REQ} r JOIN occ o ON o.owner_id=r.owner_id AND o.normalized_token=r.query_form JOIN doc d ON d.document_id=o.document_id"""
LEMMAS = f"""SELECT r.owner_id, r.query_form, a.document_id, d.title, a.token, a.normalized_form, a.lemma, split_part(a.page_id,':',2)::INTEGER, a.page_id||'@'||a.char_start, 'lemma'
   FROM {REQ} r JOIN analysis a ON a.owner_id=r.owner_id AND lower(a.lemma)=r.query_form JOIN doc d ON d.document_id=a.document_id WHERE a.analysis_status='completed'"""
BOOK = f"""(SELECT *, 'imported_book' source_type FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, query_form, item_key ORDER BY via DESC, coalesce(matched_form,'')) k FROM ({TOKENS} UNION ALL {LEMMAS})) WHERE k=1)"""
ETOKENS = f"""SELECT r.owner_id, r.query_form, e.source_id, s.display_name source_title, e.surface_form word_form, e.normalized_form item_form, NULL matched_form, NULL::INTEGER page_number, e.entry_id item_key, 'token' via
   FROM {REQ} r JOIN entry e ON e.owner_id=r.owner_id AND e.normalized_form=r.query_form JOIN rsource s ON s.source_id=e.source_id"""
ELEMMAS = f"""SELECT r.owner_id, r.query_form, e.source_id, s.display_name, e.surface_form, e.normalized_form, a.lemma, NULL::INTEGER, e.entry_id, 'lemma'
   FROM {REQ} r JOIN eanalysis a ON a.owner_id=r.owner_id AND lower(a.lemma)=r.query_form JOIN entry e ON e.entry_id=a.entry_id JOIN rsource s ON s.source_id=e.source_id"""
ENTRIES = f"""(SELECT *, 'reference_source' source_type FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, query_form, item_key ORDER BY via DESC, coalesce(matched_form,'')) k FROM ({ETOKENS} UNION ALL {ELEMMAS})) WHERE k=1)"""
LEXHIT = f"""(SELECT r.owner_id, r.query_form, l.lexeme_id source_id, l.canonical_form source_title, l.canonical_form word_form, r.query_form item_form, NULL matched_form, p.page_number, l.lexeme_id item_key, 'token' via, 'lexicon' source_type
   FROM {REQ} r JOIN (SELECT owner_id, canonical_normalized_form nf, lexeme_id FROM lexeme UNION SELECT owner_id, normalized_form, lexeme_id FROM lexform) h ON h.owner_id=r.owner_id AND h.nf=r.query_form
   JOIN lexeme l ON l.owner_id=h.owner_id AND l.lexeme_id=h.lexeme_id LEFT JOIN (SELECT f.owner_id, f.lexeme_id, arg_min(o.page_number, (o.page_number, o.document_id, o.char_start)) page_number
     FROM occ o JOIN lexform f ON f.owner_id=o.owner_id AND f.normalized_form=o.normalized_token GROUP BY 1,2) p ON p.owner_id=l.owner_id AND p.lexeme_id=l.lexeme_id)"""
COLS = "owner_id, query_form, source_type, source_id, source_title, word_form, item_form, matched_form, page_number::BIGINT page_number, item_key, via"
ALL = f"(SELECT {COLS} FROM {BOOK} UNION ALL SELECT {COLS} FROM {ENTRIES} UNION ALL SELECT {COLS} FROM {LEXHIT})"


def _items(df):
    return df.select("owner_id", "query_form", "source_type", "source_id", "source_title", "word_form", "item_form", "matched_form", *_long("page_number"), "item_key", "via")


@query("WRD-1", f"SELECT owner_id, query_form, source_id, source_title, word_form, item_key FROM ({TOKENS})")
def word_book_occurrences(w):
    return wd.book_items(w.requests, w.any_occ, w.documents).select("owner_id", "query_form", "source_id", "source_title", "word_form", "item_key")


@query("WRD-2", f"SELECT owner_id, query_form, source_id, matched_form, item_key FROM (SELECT NULL::VARCHAR owner_id, NULL::VARCHAR query_form, NULL::VARCHAR source_id, NULL::VARCHAR source_title, NULL::VARCHAR word_form, NULL::VARCHAR item_form, NULL::VARCHAR matched_form, NULL::INTEGER page_number, NULL::VARCHAR item_key, NULL::VARCHAR via WHERE false UNION ALL {LEMMAS})")
def word_book_lemmas(w):
    return wd.book_lemma_items(w.requests, w.analyses, w.documents).select("owner_id", "query_form", "source_id", "matched_form", "item_key")


@query("WRD-3", f"SELECT {COLS} FROM {BOOK}")
def word_book_evidence(w):
    return _items(w.book_items)


@query("WRD-4", f"SELECT {COLS} FROM {ENTRIES}")
def word_reference_evidence(w):
    return _items(w.entry_items)


@query("WRD-5", f"SELECT {COLS} FROM {LEXHIT}")
def word_lexicon_evidence(w):
    return _items(w.lexicon_items)


@query("WRD-6", f"""SELECT r.owner_id, r.query_form, n.source_id, n.entity_type, n.occurrence_count FROM {REQ} r JOIN (SELECT *, row_number() OVER (PARTITION BY normalized_surface
   ORDER BY source_kind, occurrence_count DESC, entity_surface, source_id, entity_type) k FROM ner WHERE source_id<>'system') n ON n.normalized_surface=r.query_form WHERE n.k<=10""")
def word_entity_evidence(w):
    return wd.entity_items(w.requests, w.entity_entries, w.ner_sources).select("owner_id", "query_form", "source_id", "entity_type", "occurrence_count")


@query("WRD-7", f"""SELECT r.owner_id, r.query_form, c.lemma matched_form, CASE WHEN c.lemma=r.query_form THEN 'normalized' ELSE 'fuzzy' END match_type,
   c.token_count||' attested tokens across '||c.source_count||' sources' source_subtitle FROM {REQ} r JOIN clookup c ON c.normalized_form=r.query_form WHERE c.lemma_rank<=20""")
def word_corpus_evidence(w):
    return wd.corpus_items(w.requests, w.corpus_matches).select("owner_id", "query_form", "matched_form", "match_type", "source_subtitle")


@query("WRD-7 NER-4 NER-5", """WITH t AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) w FROM documents),
   c AS (SELECT left(w, 3) s, w lemma, count(*) n, count(DISTINCT source) sc FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, lemma) k FROM c)
   SELECT s query_form, lemma matched_form, n||' attested tokens across '||sc||' sources' source_subtitle FROM r WHERE k<=20""")
def word_corpus_many_lemmas(w):
    """Forms of hundreds of lemmas: words of the documents as lemmas of their first letters."""
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    tokens = w.table("documents").select(F.col("source").alias("source_id"), found.alias("lemma")).withColumn("surface", F.left("lemma", F.lit(3)))
    by_surface, by_lemma = en.corpus_index(tokens)
    asked = by_surface.select(F.col("surface").alias("normalized_form")).distinct()
    requests = asked.select(F.lit("all").alias("owner_id"), F.col("normalized_form").alias("query_form"))
    return wd.corpus_items(requests, en.corpus_lookup(asked, by_surface, by_lemma)).select("query_form", "matched_form", "source_subtitle")


EXTERNAL = f"""(SELECT r.owner_id, r.query_form, 'nayiri_web' provider_key, 'Web dictionary' provider_display_name, e.source_title, e.matched_form, e.reference_link, e.match_type, e.match_score FROM {REQ} r JOIN ecur c ON c.normalized_form=r.query_form AND c.fresh
     JOIN eresult e ON e.cache_id=c.cache_id UNION ALL SELECT r.owner_id, r.query_form, 'nayiri_western_corpus', 'Nayiri Corpus', 'Nayiri Western Armenian Corpus', c.lemma, NULL,
     CASE WHEN c.lemma=r.query_form THEN 'normalized' ELSE 'fuzzy' END, CASE WHEN c.lemma=r.query_form THEN 100.0 END::DOUBLE FROM {REQ} r JOIN clookup c ON c.normalized_form=r.query_form WHERE c.lemma_rank<=20)"""


@query("WRD-8 WRD-14", f"SELECT owner_id, query_form, provider_key, source_title, matched_form, match_score FROM {EXTERNAL}")
def word_external_evidence(w):
    return w.external_items.select("owner_id", "query_form", "provider_key", "source_title", "matched_form", "match_score")


@query("WRD-14", f"""SELECT r.owner_id, r.query_form, CASE WHEN count(x.provider_key)>0 THEN 'completed'
     WHEN NOT coalesce(any_value(c.fresh),false) OR any_value(c.status)='failed' THEN 'unavailable' WHEN any_value(c.results)>0 THEN 'completed' ELSE 'no_results' END external_status, count(x.provider_key) external_hits
   FROM {REQ} r LEFT JOIN {EXTERNAL} x ON x.owner_id=r.owner_id AND x.query_form=r.query_form LEFT JOIN ecur c ON c.normalized_form=r.query_form GROUP BY 1,2""")
def word_external_status(w):
    asked = w.requests.select(F.col("query_form").alias("normalized_form"))
    statuses = ex.lookup_status(asked, w.providers, w.external_cache, w.external_results, "normalized", w.now)
    return wd.external_status(w.requests, w.external_items, statuses)


@query("WRD-9", f"SELECT owner_id, query_form, count(*) total_hits, count(DISTINCT (source_type, source_id)) source_count FROM {ALL} GROUP BY 1,2")
def word_evidence_summary(w):
    return wd.evidence_summary(w.word_items)


@query("WRD-9", f"""SELECT owner_id, query_form, place::BIGINT place, source_type, source_id, item_key FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, query_form
   ORDER BY source_type, source_title, coalesce(page_number,0), word_form, item_key) place FROM {ALL}) WHERE place<=25""")
def word_evidence_page(w):
    return wd.evidence_page(w.word_items, 25).select("owner_id", "query_form", *_long("place"), "source_type", "source_id", "item_key")


@query("WRD-10", f"""SELECT r.owner_id, r.query_form, g.best_source, g.best_form FROM {REQ} r JOIN gstatus g ON g.owner_id=r.owner_id AND g.normalized_form=r.query_form WHERE g.has_reference_match
   UNION SELECT r.owner_id, r.query_form, l.best_source, l.best_form FROM {REQ} r JOIN lexvalue h ON h.owner_id=r.owner_id AND h.normalized_form=r.query_form
   JOIN lstatus l ON l.owner_id=h.owner_id AND l.lexeme_id=h.lexeme_id WHERE l.has_reference_match""")
def word_related_matches(w):
    return wd.related_matches(w.requests, w.group_status, w.lexeme_status, w.lexemes, w.lexeme_forms).select("owner_id", "query_form", "best_source", "best_form").distinct()


@query("WRD-10", f"""SELECT r.owner_id, r.query_form, coalesce(x.f, d.l, m.b) best_lemma FROM {REQ} r
   LEFT JOIN (SELECT owner_id, query_form, arg_min(matched_form, (match_type<>'exact', match_score IS NULL, -coalesce(match_score,0), provider_display_name, source_title, matched_form)) f FROM {EXTERNAL} GROUP BY 1,2) x USING (owner_id, query_form)
   LEFT JOIN (SELECT owner_id, normalized_form, dictionary_lemma l FROM resolved WHERE language_profile='unknown') d ON d.owner_id=r.owner_id AND d.normalized_form=r.query_form
   LEFT JOIN (SELECT owner_id, normalized_form, arg_min(value, (-n, value)) b FROM worddist WHERE kind='lemma' AND value<>'' GROUP BY 1,2) m ON m.owner_id=r.owner_id AND m.normalized_form=r.query_form""")
def word_best_lemma(w):
    resolutions = w.resolutions.where("language_profile = 'unknown'").select("owner_id", F.col("normalized_form").alias("query_form"), "dictionary_lemma")
    morphology = mo.best_lemmas(mo.word_distribution(w.tagged_words)).select("owner_id", F.col("normalized_form").alias("query_form"), "best_lemma")
    return wd.best_lemma(w.requests, w.external_items, resolutions, morphology)


@query("WRD-11", f"""SELECT owner_id, query_form, source_type, place::BIGINT place, item_key FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, query_form, source_type
   ORDER BY source_title, coalesce(page_number,0), word_form, item_key) place FROM {ALL} WHERE item_form=query_form OR lower(matched_form)=query_form) WHERE place<=10""")
def word_search_normalized(w):
    rows = wd.top_per_category(wd.filter_by_mode(w.word_items, "normalized"), 10)
    return rows.select("owner_id", "query_form", "source_type", *_long("place"), "item_key")


@query("WRD-11", f"""SELECT owner_id, query_form, source_type, place::BIGINT place, item_key FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, query_form, source_type
   ORDER BY source_title, coalesce(page_number,0), word_form, item_key) place FROM {ALL} WHERE word_form=query_form OR matched_form=query_form OR (lower(matched_form)=query_form AND item_form<>query_form)) WHERE place<=10""")
def word_search_exact(w):
    """Words asked for in lower case, as written."""
    asked = w.word_items.withColumn("raw_query", F.col("query_form"))
    return wd.top_per_category(wd.filter_by_mode(asked, "exact"), 10).select("owner_id", "query_form", "source_type", *_long("place"), "item_key")


@query("WRD-12 SCL-13")
def word_fuzzy_forms(w):
    """Five most similar known forms of every vocabulary word in lexicon, books and wordlists."""
    return w.fuzzy_near.select("owner_id", "query_form", "source_type", "form", F.round("score", 4).alias("score"), *_long("form_rank"))


@query("WRD-11 WRD-12")
def word_search_fuzzy(w):
    """All categories in fuzzy mode: the first ten items over the similar forms."""
    near = w.fuzzy_near
    ask = near.select("owner_id", F.col("form").alias("query_form")).distinct()
    books = wd.merge_items(wd.book_items(ask, w.any_occ, w.documents), wd.book_lemma_items(ask, w.analyses, w.documents))
    lists = wd.merge_items(
        wd.entry_items(ask, w.reference_entries, w.reference_sources), wd.entry_lemma_items(ask, w.entry_analyses, w.reference_entries, w.reference_sources)
    )
    lexicon = wd.lexicon_items(ask, w.lexemes, w.lexeme_forms, wd.lexeme_samples(w.any_occ, w.lexeme_forms))
    rows = wd.fuzzy_items(near, books.unionByName(lists).unionByName(lexicon), 10)
    return rows.select("owner_id", "query_form", "source_type", *_long("place"), "form", "item_key", "word_form")


@query("WRD-14", f"""SELECT owner_id, query_form, mode, provider_key, source_title, matched_form, (row_number() OVER (PARTITION BY owner_id, query_form, mode
   ORDER BY provider_display_name, source_title, matched_form, coalesce(reference_link,'')))::BIGINT place FROM {EXTERNAL}, (VALUES ('exact'),('normalized'),('fuzzy')) m(mode)
   WHERE mode='fuzzy' OR (mode='exact' AND matched_form=query_form) OR (mode='normalized' AND lower(matched_form)=query_form)""")
def word_external_by_mode(w):
    """Words asked for in lower case, in the three modes."""
    asked = w.external_items.withColumn("raw_query", F.col("query_form"))
    parts = [
        wd.external_by_mode(asked, m).select("owner_id", "query_form", F.lit(m).alias("mode"), "provider_key", "source_title", "matched_form", *_long("place"))
        for m in ("exact", "normalized", "fuzzy")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("WRD-15", f"""SELECT r.owner_id, r.query_form, 'Web dictionary' provider_display_name, e.matched_form, e.reference_link FROM {REQ} r JOIN ecur c ON c.normalized_form=r.query_form AND c.fresh JOIN eresult e ON e.cache_id=c.cache_id
   UNION ALL SELECT r.owner_id, r.query_form, 'Nayiri Corpus', c.lemma, NULL FROM {REQ} r JOIN clookup c ON c.normalized_form=r.query_form WHERE c.lemma_rank<=5""")
def word_check_sources(w):
    cached = ex.cached_items(w.providers, w.external_cache, w.external_results, "normalized", w.now)
    return wd.check_sources(w.requests, cached, w.corpus_matches)


# Words of the vocabulary and words that stand nowhere: each with a letter put behind it.
ASKED = f"(SELECT owner_id, query_form FROM {REQ} UNION SELECT owner_id, query_form||'qz' FROM {REQ})"


@query("WRD-13 WRD-15", f"""SELECT r.owner_id, r.query_form, coalesce(x.matching_lexeme_count,0)>0 exists_in_lexicon, coalesce(x.matching_lexeme_count,0) matching_lexeme_count,
   g.owner_id IS NOT NULL OR EXISTS (SELECT 1 FROM worddist d WHERE d.owner_id=r.owner_id AND d.kind='lemma' AND lower(d.value)=r.query_form) found_in_imported_books,
   EXISTS (SELECT 1 FROM entry d WHERE d.owner_id=r.owner_id AND d.normalized_form=r.query_form) OR EXISTS (SELECT 1 FROM eanalysis d WHERE d.owner_id=r.owner_id AND lower(d.lemma)=r.query_form) found_in_reference_sources,
   coalesce(e.n,0)>0 found_in_trusted_external, coalesce(e.n,0) external_match_count FROM {ASKED} r LEFT JOIN lexev x ON x.owner_id=r.owner_id AND x.normalized_form=r.query_form
   LEFT JOIN groups g ON g.owner_id=r.owner_id AND g.normalized_form=r.query_form LEFT JOIN (SELECT owner_id, query_form, count(*) n FROM {EXTERNAL} GROUP BY 1,2) e ON e.owner_id=r.owner_id AND e.query_form=r.query_form""")
def word_check(w):
    lemmas = lambda rows: rows.where("analysis_status = 'completed'").select("owner_id", F.col("lemma_normalized").alias("normalized_form")).distinct()
    asked = w.requests.union(w.requests.select("owner_id", F.concat("query_form", F.lit("qz")))).distinct()
    return wd.quick_check(
        asked, lk.lexeme_evidence(w.lexemes, w.lexeme_forms), w.group_numbers, lemmas(w.tagged_words), w.reference_entries, lemmas(w.entry_analyses), w.external_items
    )


# Review -------------------------------------------------------------------------------

DOCWORD = """(SELECT s.owner_id, s.document_id, s.normalized_form, s.occurrence_count, s.page_count, b.dominant_script_type, g.group_state, st.has_reference_match imported_match,
   st.has_reference_match OR p.external_status='found' has_reference_match, p.external_status FROM slice s JOIN bucket b ON b.document_id=s.document_id AND b.nf=s.normalized_form
   JOIN gstate g ON g.owner_id=s.owner_id AND g.normalized_form=s.normalized_form JOIN gstatus st ON st.owner_id=s.owner_id AND st.normalized_form=s.normalized_form JOIN snap p ON p.normalized_form=s.normalized_form)"""
DOCWORD_COLS = ["owner_id", "document_id", "normalized_form", "occurrence_count", "page_count", "dominant_script_type", "group_state", "has_reference_match", "external_status"]


@query("REV-1", f"SELECT {', '.join(DOCWORD_COLS)} FROM {DOCWORD}")
def document_word_candidates(w):
    return w.word_candidates.select(*DOCWORD_COLS)


@query("REV-2", f"""SELECT 'linked' view, document_id, normalized_form FROM {DOCWORD} WHERE dominant_script_type<>'digit_mixed' AND group_state='linked'
   UNION ALL SELECT 'unlinked', document_id, normalized_form FROM {DOCWORD} WHERE group_state='unreviewed' AND dominant_script_type='armenian'
   UNION ALL SELECT 'suspicious', document_id, normalized_form FROM {DOCWORD} WHERE dominant_script_type NOT IN ('digit_mixed','armenian') AND group_state<>'ignored_noise'
   UNION ALL SELECT 'ignored', document_id, normalized_form FROM {DOCWORD} WHERE dominant_script_type<>'digit_mixed' AND group_state='ignored_noise'""")
def workspace_views(w):
    parts = [rv.status_view(w.word_candidates, v).select(F.lit(v).alias("view"), "document_id", "normalized_form") for v in ("linked", "unlinked", "suspicious", "ignored")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("REV-3", f"""SELECT 'matched' status, document_id, normalized_form FROM {DOCWORD} x WHERE external_status='found' OR EXISTS (SELECT 1 FROM mgroup m WHERE m.owner_id=x.owner_id AND m.normalized_form=x.normalized_form)
   UNION ALL SELECT 'unmatched', document_id, normalized_form FROM {DOCWORD} x WHERE external_status='not_found' AND NOT EXISTS (SELECT 1 FROM mgroup m WHERE m.owner_id=x.owner_id AND m.normalized_form=x.normalized_form)""")
def workspace_reference_filter(w):
    keys = st.matched_group_keys(w.latest, w.direct_matches, w.reference_entries, w.reference_sources)
    parts = [rv.by_reference_status(w.word_candidates, keys, w.snapshots, s).select(F.lit(s).alias("status"), "document_id", "normalized_form") for s in ("matched", "unmatched")]
    return parts[0].unionByName(parts[1])


@query("REV-4", """WITH f AS (SELECT *, row_number() OVER (PARTITION BY document_id, normalized_token ORDER BY page_number, char_start) k FROM occs),
   v AS (SELECT document_id, normalized_token nf, 't' kind, token v, min(k) k FROM f WHERE k<=100 GROUP BY ALL UNION ALL SELECT document_id, normalized_token, 'c', context_snippet, min(k) FROM f WHERE k<=100 GROUP BY ALL)
   SELECT document_id, nf normalized_form, string_agg(v,' | ' ORDER BY rn) FILTER (kind='t') sample_tokens, string_agg(v,' | ' ORDER BY rn) FILTER (kind='c') sample_contexts
   FROM (SELECT *, row_number() OVER (PARTITION BY document_id, nf, kind ORDER BY k, v) rn FROM v) WHERE rn<=5 GROUP BY 1,2""")
def workspace_samples(w):
    return rv.candidate_samples(w.any_occ).select("document_id", "normalized_form", *_listed("sample_tokens", "sample_contexts"))


@query("REV-5", """SELECT e.entry_id, e.surface_form, x.best_lexeme_id linked_lexeme_id, x.best_lexeme_canonical_form linked_lexeme_canonical_form FROM entry e JOIN mentry m ON m.entry_id=e.entry_id
   LEFT JOIN lexev x ON x.owner_id=e.owner_id AND x.normalized_form=e.normalized_form""")
def source_word_candidates(w):
    rows = rv.source_word_candidates(
        w.reference_entries, w.entry_status, lk.lexeme_evidence(w.lexemes, w.lexeme_forms), st.matched_entries(w.latest, w.direct_matches), "matched"
    )
    return rows.select("entry_id", "surface_form", "linked_lexeme_id", "linked_lexeme_canonical_form")


@query("REV-6", f"""SELECT owner_id, document_id, count(*) word_candidate_count, count(*) FILTER (group_state='linked') linked_candidate_count,
   count(*) FILTER (dominant_script_type<>'armenian' AND group_state<>'ignored_noise') suspicious_candidate_count,
   count(*) FILTER (NOT EXISTS (SELECT 1 FROM mgroup m WHERE m.owner_id=x.owner_id AND m.normalized_form=x.normalized_form)) unmatched_candidate_count FROM {DOCWORD} x GROUP BY 1,2""")
def document_workspace_counts(w):
    keys = st.matched_group_keys(w.latest, w.direct_matches, w.reference_entries, w.reference_sources)
    return rv.document_workspace_counts(w.word_candidates, keys)


@query("REV-6", """SELECT e.owner_id, e.source_id, count(*) imported_entry_count, count(m.entry_id) matched_entry_count, count(*)-count(m.entry_id) unmatched_entry_count
   FROM entry e LEFT JOIN (SELECT DISTINCT entry_id FROM mentry) m USING (entry_id) GROUP BY 1,2""")
def source_workspace_counts(w):
    return rv.source_workspace_counts(w.reference_entries, st.matched_entries(w.latest, w.direct_matches))


FLOW = """(SELECT *, CASE status WHEN 'failed' THEN 'failed' WHEN 'processing' THEN 'ingesting' ELSE CASE WHEN candidate_count=0 THEN 'curated_complete' WHEN linked_count>0 THEN 'in_review' ELSE 'ready_for_review' END END stage
   FROM (SELECT d.owner_id, d.document_id, d.status, count(*) FILTER (g.group_state='unreviewed' AND g.dominant_script_type='armenian') candidate_count, count(*) FILTER (g.group_state='linked') linked_count,
     count(*) FILTER (g.group_state='ignored_noise') ignored_count, count(*) FILTER (g.group_state<>'ignored_noise' AND g.dominant_script_type<>'armenian') suspicious_count
     FROM doc d LEFT JOIN slice s ON s.document_id=d.document_id LEFT JOIN gstate g ON g.owner_id=s.owner_id AND g.normalized_form=s.normalized_form GROUP BY 1,2,3))"""


@query("REV-7 SCL-30", f"""SELECT owner_id, document_id, stage, candidate_count, linked_count, ignored_count, suspicious_count,
   CASE WHEN stage IN ('ready_for_review','in_review') OR candidate_count>0 THEN '/lexicon?document_id='||document_id||'&view=candidates' END review_path FROM {FLOW}""")
def workflow_stages(w):
    return w.workflow.select("owner_id", "document_id", "stage", "candidate_count", "linked_count", "ignored_count", "suspicious_count", "review_path")


@query("REV-8", f"""SELECT * FROM (SELECT f.owner_id, f.document_id, f.candidate_count, row_number() OVER (PARTITION BY f.owner_id ORDER BY f.candidate_count DESC, a.seen DESC NULLS LAST, f.document_id) place FROM {FLOW} f
   LEFT JOIN (SELECT document_id, max(coalesce(updated_at, created_at)) seen FROM jb GROUP BY 1) a ON a.document_id=f.document_id WHERE stage IN ('ready_for_review','in_review')) WHERE place<=50""")
def review_queue(w):
    """The first fifty of every owner, ties by the latest job of the document."""
    activity = w.jobs.select("document_id", F.coalesce("updated_at", "created_at").alias("last_activity_at"))
    return rv.review_queue(w.workflow, activity).where("place <= 50").select("owner_id", "document_id", "candidate_count", *_long("place"))


@query("REV-9", "SELECT DISTINCT o.owner_id, o.document_id FROM occ o JOIN review r ON r.owner_id=o.owner_id AND r.normalized_form=o.normalized_token")
def touched_documents(w):
    return rv.touched_documents(w.slice_numbers, w.reviews)


@query("REV-10", "SELECT document_id, title FROM doc WHERE lower(title) LIKE '%doc-1%' OR lower(original_filename) LIKE '%doc-1%'")
def document_options(w):
    return rv.document_options(w.documents, "DOC-1").select("document_id", "title")


@query("REV-10", """SELECT owner_id, count(*) total, count(*) FILTER (status='completed') completed, count(*) FILTER (status='processing') processing,
   count(*) FILTER (status='queued') queued, count(*) FILTER (status='failed') failed FROM doc GROUP BY 1""")
def document_status_stats(w):
    return rv.status_stats(w.documents)


PROFILE = """(SELECT p.*, f.normalized_token sample_form FROM (SELECT owner_id, document_id, count(*) occurrence_count, count(DISTINCT normalized_token) distinct_form_count,
     count(*) FILTER (script_type IN ('digit_mixed','mixed','other') OR has_digits) noisy_occurrence_count FROM occ GROUP BY 1,2) p
   JOIN (SELECT document_id, normalized_token, row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, normalized_token) k FROM occ GROUP BY 1,2) f ON f.document_id=p.document_id AND f.k=1)"""


@query("REV-11", f"SELECT * FROM {PROFILE}")
def corpus_profile(w):
    return rv.corpus_profile(w.any_occ)


@query("REV-11", f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY occurrence_count, document_id)-1 i, count(*) OVER (PARTITION BY owner_id) c FROM {PROFILE})
   SELECT owner_id, 'small' label, document_id FROM p WHERE i=0 UNION ALL SELECT owner_id, 'medium', document_id FROM p WHERE i=c//2
   UNION ALL SELECT owner_id, 'large_noisy', arg_max(document_id, (noisy_occurrence_count, occurrence_count, document_id)) FROM p GROUP BY 1""")
def profile_targets(w):
    return rv.profile_targets(rv.corpus_profile(w.any_occ)).select("owner_id", "label", "document_id")


@query("SCL-22", "SELECT document_id, CASE WHEN n_chars%2=0 THEN title ELSE document_id END shown_title FROM doc")
def document_titles(w):
    from lexloom.functions import text as tx

    given = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit(" "), "title")).otherwise("  ")
    return w.documents.select("document_id", tx.document_title(given, F.col("original_filename")).alias("shown_title"))


@query("SCL-24", "SELECT document_id, sha256(text) content_hash FROM rawdoc")
def content_hashes(w):
    from lexloom.functions import text as tx

    return w.raw_documents.select("document_id", tx.content_hash(F.encode("text", "UTF-8")).alias("content_hash"))
