"""Reference answers in plain SQL, for the tables of ``inputs``.

``sql(body)`` puts in front of a query the common table expressions it names,
directly or through others.
"""

from __future__ import annotations

import re

from lexloom.plans.inputs import ARMENIAN, ARMENIAN_UPPER, LATIN, LATIN_UPPER

WORD = r"[\p{L}\p{M}\p{Nd}]+(?:[''’֊-][\p{L}\p{M}\p{Nd}]+)*"  # quote doubled for SQL
CLEAN_STEPS = (
    (r"\r\n?", r"chr(10)"),
    (r"[\x00-\x09\x0B-\x1F\x7F-\x9F\x{00A0}\x{2007}\x{202F}\p{Cf}\p{Co}]", "' '"),
    (r"\p{Z}+", "' '"),
    (r" ?\n ?", "chr(10)"),
    (r"\n{3,}", "chr(10)||chr(10)"),
    (r"^[ \n]+|[ \n]+$", "''"),
)


def cleaned(expr: str) -> str:
    out = f"nfc_normalize({expr})"
    for pattern, new in CLEAN_STEPS:
        out = f"regexp_replace({out}, '{pattern}', {new}, 'g')"
    return out


def rejoined(expr: str, passes: int = 8) -> str:
    for _ in range(passes):
        expr = (
            f"regexp_replace({expr}, '(^|[^\\p{{L}}\\p{{Nd}}])(\\p{{Armenian}}+)-[ ]*\\n[ ]*(\\p{{Armenian}})',"
            " '\\1\\2\\3', 'g')"
        )
    return expr


def armenian(expr: str) -> str:
    return f"translate({expr}, '{LATIN}{LATIN_UPPER}', '{ARMENIAN}{ARMENIAN_UPPER}')"


SCRIPT_CASE = r"""CASE WHEN regexp_matches(token,'\p{Nd}') THEN 'digit_mixed'
  WHEN regexp_full_match(token, '(\p{Armenian}|[^\p{L}])+') THEN 'armenian'
  WHEN regexp_full_match(token, '(\p{Latin}|[^\p{L}])+') THEN 'latin'
  WHEN regexp_matches(token,'\p{Armenian}') AND regexp_matches(token,'\p{Latin}') THEN 'mixed'
  ELSE 'other' END"""

def initcap(expr: str) -> str:
    return f"upper(substr({expr},1,1))||substr({expr},2)"


def curated_tables() -> dict[str, str]:
    return {
        "vocab": f"""SELECT o.owner_id, w.item_id, w.latin, CASE WHEN o.owner_id IN ('en','fr') THEN {armenian('w.latin')} ELSE w.latin END surface_form,
            lower(CASE WHEN o.owner_id IN ('en','fr') THEN {armenian('w.latin')} ELSE w.latin END) normalized_form
            FROM (SELECT DISTINCT item_id, latin FROM (SELECT item_id, unnest(regexp_extract_all(text, '{WORD}')) latin FROM benchmark)
              WHERE regexp_matches(latin, '\\p{{L}}')) w, (VALUES ('en'),('fr'),('de'),('es')) o(owner_id)""",
        "rsource": """SELECT DISTINCT owner_id, owner_id||'-wl-'||(item_id%4) source_id, 'wordlist-'||(item_id%4) display_name,
            NOT (owner_id='es' AND item_id%4=2) is_active, CASE item_id%4 WHEN 3 THEN 'pdf_ocr' ELSE 'csv' END last_import_method,
            CASE item_id%4 WHEN 0 THEN 'classical' WHEN 1 THEN 'eastern' WHEN 2 THEN 'western' ELSE 'unknown' END language_stage FROM vocab""",
        "entry": """SELECT DISTINCT owner_id, owner_id||'-wl-'||(item_id%4) source_id, owner_id||'-wl-'||(item_id%4)||':'||surface_form entry_id,
            surface_form, normalized_form, CASE WHEN length(latin)%2=0 THEN 'meaning of '||latin END definition,
            CASE WHEN latin LIKE '%s' THEN left(surface_form, length(surface_form)-1) END lemma FROM vocab""",
        "lexform": """SELECT DISTINCT owner_id, normalized_form, owner_id||'-lx-'||left(normalized_form,4) lexeme_id FROM vocab
            WHERE regexp_matches(lower(latin), '^[a-h]')""",
        "lexeme": f"""SELECT owner_id, lexeme_id, {initcap('c')} canonical_form, c canonical_normalized_form,
            CASE WHEN length(c)>=6 THEN 'approved' ELSE 'draft' END status, length(c) created_seq
            FROM (SELECT owner_id, lexeme_id, min(normalized_form) c FROM lexform GROUP BY 1,2)""",
        "review": "SELECT DISTINCT owner_id, normalized_form FROM vocab WHERE lower(latin) LIKE '%n'",
        "mapping": f"""SELECT DISTINCT owner_id, nf, {initcap('l')} dictionary_lemma, l normalized_lemma, mtype, skey, profile, confidence, status FROM (
            SELECT owner_id, normalized_form nf, left(normalized_form, length(normalized_form)-1) l,
              CASE length(latin) WHEN 9 THEN 'ocr_correction_candidate' ELSE 'inflection' END mtype, CASE length(latin) WHEN 7 THEN 'fuzzy' ELSE 'seed_list' END skey,
              CASE WHEN length(latin)%2=0 THEN 'classical' ELSE 'unknown' END profile, 0.5::DOUBLE+(length(latin)%5)/10.0::DOUBLE confidence,
              CASE WHEN length(latin)%3<>0 THEN 'approved' ELSE 'pending' END status FROM vocab WHERE latin LIKE '%s' AND length(latin)>=3
            UNION ALL SELECT NULL, normalized_form, left(normalized_form, length(normalized_form)-2),
              CASE length(latin) WHEN 9 THEN 'ocr_correction_candidate' ELSE 'inflection' END, CASE length(latin) WHEN 7 THEN 'fuzzy' ELSE 'seed_list' END,
              'mixed', 0.8::DOUBLE, CASE WHEN length(latin)%3<>0 THEN 'approved' ELSE 'pending' END FROM vocab WHERE latin LIKE '%s' AND length(latin)>=3)""",
        "gstate": """SELECT g.*, f.lexeme_id linked_lexeme_id, l.canonical_form linked_lexeme_canonical_form,
            CASE WHEN f.lexeme_id IS NOT NULL THEN 'linked' WHEN r.owner_id IS NOT NULL THEN 'ignored_noise' ELSE 'unreviewed' END group_state
            FROM groups g LEFT JOIN lexform f USING (owner_id, normalized_form) LEFT JOIN lexeme l ON l.lexeme_id=f.lexeme_id AND l.owner_id=g.owner_id
            LEFT JOIN review r ON r.owner_id=g.owner_id AND r.normalized_form=g.normalized_form""",
        "runs": """SELECT owner_id, source_id, source_id||'-run-'||k run_id, k created_seq, CASE k WHEN 2 THEN 'failed' ELSE 'completed' END status
            FROM rsource, (VALUES (1),(2),(3)) t(k)""",
        "lexev": """SELECT owner_id, normalized_form, count(*) matching_lexeme_count, arg_min(lexeme_id, (via, created_seq, lexeme_id)) best_lexeme_id,
            arg_min(canonical_form, (via, created_seq, lexeme_id)) best_lexeme_canonical_form FROM (
              SELECT owner_id, normalized_form, lexeme_id, canonical_form, created_seq, min(via) via FROM (
                SELECT owner_id, canonical_normalized_form normalized_form, lexeme_id, canonical_form, created_seq, 0 via FROM lexeme
                UNION ALL SELECT f.owner_id, f.normalized_form, l.lexeme_id, l.canonical_form, l.created_seq, 1 FROM lexform f JOIN lexeme l USING (owner_id, lexeme_id)
              ) GROUP BY ALL) GROUP BY 1,2""",
        "bookev": """SELECT owner_id, normalized_token normalized_form, count(*) occurrence_count,
            arg_min(o.document_id, (d.title, page_number, char_start)) best_document_id, min(d.title) best_document_title,
            arg_min(page_number, (d.title, page_number, char_start)) best_page_number,
            arg_min(context_snippet, (d.title, page_number, char_start)) best_context_snippet
            FROM occs o JOIN doc d USING (document_id, owner_id) GROUP BY 1,2""",
        "result": """SELECT e.owner_id, e.source_id, r.run_id, e.entry_id, r.created_seq, r.status run_status, e.surface_form target_label, e.normalized_form,
            coalesce(x.matching_lexeme_count,0) matching_lexeme_count, coalesce(b.occurrence_count,0) book_count,
            coalesce(x.matching_lexeme_count,0)+coalesce(b.occurrence_count,0) match_count,
            CASE WHEN coalesce(x.matching_lexeme_count,0)+coalesce(b.occurrence_count,0)>0 THEN 'matched' ELSE 'unmatched' END match_status,
            coalesce(x.matching_lexeme_count,0)>0 exists_in_lexicon, coalesce(b.occurrence_count,0)>0 found_in_books,
            x.best_lexeme_id, x.best_lexeme_canonical_form, b.best_document_id, b.best_document_title, b.best_page_number, b.best_context_snippet
            FROM entry e JOIN runs r USING (owner_id, source_id) LEFT JOIN lexev x ON x.owner_id=e.owner_id AND x.normalized_form=e.normalized_form
            LEFT JOIN bookev b ON b.owner_id=e.owner_id AND b.normalized_form=e.normalized_form WHERE length(e.surface_form)>=r.created_seq*2""",
        "latest": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY created_seq DESC, run_id DESC) k FROM result WHERE run_status='completed') WHERE k=1""",
        "cat": "SELECT e.*, s.display_name, s.last_import_method FROM entry e JOIN rsource s USING (owner_id, source_id) WHERE s.is_active",
        "target": """SELECT owner_id, 'lexicon_group' target_type, normalized_form target_key, normalized_form target_label, normalized_form AS value
              FROM gstate WHERE group_state='unreviewed' AND dominant_script_type='armenian'
            UNION SELECT owner_id, 'lexeme', lexeme_id, canonical_form, canonical_normalized_form FROM lexeme
            UNION SELECT owner_id, 'lexeme', lexeme_id, canonical_form, normalized_form FROM lexform JOIN lexeme USING (owner_id, lexeme_id)""",
        "direct": """SELECT t.owner_id, t.target_type, t.target_key, t.target_label, c.source_id, c.display_name, c.entry_id, c.surface_form, c.normalized_form, 'exact' match_type, 0 torder
              FROM target t JOIN cat c ON c.owner_id=t.owner_id AND c.surface_form=t.value
            UNION SELECT t.owner_id, t.target_type, t.target_key, t.target_label, c.source_id, c.display_name, c.entry_id, c.surface_form, c.normalized_form, 'normalized', 1
              FROM target t JOIN cat c ON c.owner_id=t.owner_id AND c.normalized_form=t.value""",
        "sfirst": """SELECT owner_id, normalized_form, count(*) n, arg_min(display_name, (display_name, target_label, entry_id)) best_source,
            arg_min(target_label, (display_name, target_label, entry_id)) best_form FROM latest JOIN rsource USING (owner_id, source_id)
            WHERE match_status='matched' GROUP BY 1,2""",
        "dsum": """SELECT owner_id, target_type, target_key, count(*) n, arg_min(display_name, (torder, display_name, surface_form, entry_id)) best_source,
            arg_min(surface_form, (torder, display_name, surface_form, entry_id)) best_form, arg_min(match_type, (torder, display_name, surface_form, entry_id)) best_type
            FROM direct GROUP BY 1,2,3""",
        "esum": """SELECT owner_id, normalized_form, count(*) n, min(display_name) best_source, arg_min(surface_form, (display_name, surface_form)) best_form FROM cat GROUP BY 1,2""",
        "lexvalue": "SELECT owner_id, lexeme_id, canonical_normalized_form normalized_form FROM lexeme UNION SELECT owner_id, lexeme_id, normalized_form FROM lexform",
        "gstatus": """SELECT g.owner_id, g.normalized_form, coalesce(a.n, b.n, c.n) IS NOT NULL has_reference_match, coalesce(a.n, b.n, c.n, 0) reference_match_count,
            CASE WHEN a.n IS NOT NULL THEN a.best_source WHEN b.n IS NOT NULL THEN b.best_source ELSE c.best_source END best_source,
            CASE WHEN a.n IS NOT NULL THEN a.best_form WHEN b.n IS NOT NULL THEN b.best_form ELSE c.best_form END best_form,
            CASE WHEN a.n IS NOT NULL THEN 'normalized' WHEN b.n IS NOT NULL THEN b.best_type WHEN c.n IS NOT NULL THEN 'normalized' END best_type,
            CASE WHEN a.n IS NULL AND b.n IS NULL AND c.n IS NOT NULL THEN 100.0::DOUBLE END best_score
            FROM groups g LEFT JOIN sfirst a USING (owner_id, normalized_form)
            LEFT JOIN dsum b ON b.owner_id=g.owner_id AND b.target_type='lexicon_group' AND b.target_key=g.normalized_form
            LEFT JOIN esum c ON c.owner_id=g.owner_id AND c.normalized_form=g.normalized_form""",
        "lstatus": """WITH hit AS (SELECT DISTINCT v.owner_id, v.lexeme_id, l.entry_id, l.target_label, l.match_status, s.display_name
     FROM lexvalue v JOIN latest l USING (owner_id, normalized_form) JOIN rsource s USING (owner_id, source_id)),
   a AS (SELECT owner_id, lexeme_id, count(DISTINCT entry_id) n, arg_min(display_name, (display_name, target_label, entry_id)) bs, arg_min(target_label, (display_name, target_label, entry_id)) bf
     FROM hit WHERE match_status='matched' GROUP BY 1,2),
   cov AS (SELECT DISTINCT owner_id, lexeme_id FROM hit),
   c AS (SELECT v.owner_id, v.lexeme_id, arg_min(e.n, (e.best_source, e.best_form, v.normalized_form)) n, arg_min(e.best_source, (e.best_source, e.best_form, v.normalized_form)) bs,
     arg_min(e.best_form, (e.best_source, e.best_form, v.normalized_form)) bf FROM lexvalue v JOIN esum e USING (owner_id, normalized_form) GROUP BY 1,2)
   SELECT l.owner_id, l.lexeme_id, coalesce(a.n, CASE WHEN cov.lexeme_id IS NULL THEN d.n END, c.n) IS NOT NULL has_reference_match,
     coalesce(a.n, CASE WHEN cov.lexeme_id IS NULL THEN d.n END, c.n, 0) reference_match_count,
     CASE WHEN a.n IS NOT NULL THEN a.bs WHEN cov.lexeme_id IS NULL AND d.n IS NOT NULL THEN d.best_source ELSE c.bs END best_source,
     CASE WHEN a.n IS NOT NULL THEN a.bf WHEN cov.lexeme_id IS NULL AND d.n IS NOT NULL THEN d.best_form ELSE c.bf END best_form
   FROM lexeme l LEFT JOIN a USING (owner_id, lexeme_id) LEFT JOIN cov ON cov.owner_id=l.owner_id AND cov.lexeme_id=l.lexeme_id
   LEFT JOIN dsum d ON d.owner_id=l.owner_id AND d.target_type='lexeme' AND d.target_key=l.lexeme_id LEFT JOIN c ON c.owner_id=l.owner_id AND c.lexeme_id=l.lexeme_id""",
        "mgroup": """SELECT owner_id, normalized_form FROM latest WHERE match_status='matched'
            UNION SELECT owner_id, target_key FROM direct d WHERE target_type='lexicon_group' AND NOT EXISTS (SELECT 1 FROM latest l WHERE l.owner_id=d.owner_id AND l.normalized_form=d.target_key)
            UNION SELECT owner_id, normalized_form FROM cat""",
        "mentry": """SELECT owner_id, entry_id FROM latest WHERE match_status='matched'
            UNION SELECT owner_id, entry_id FROM direct d WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.entry_id=d.entry_id)""",
        "mlexeme": """SELECT v.owner_id, v.lexeme_id FROM lexvalue v JOIN latest l USING (owner_id, normalized_form) WHERE match_status='matched'
            UNION SELECT owner_id, target_key FROM direct d WHERE target_type='lexeme' AND NOT EXISTS
              (SELECT 1 FROM lexvalue v JOIN latest l USING (owner_id, normalized_form) WHERE v.owner_id=d.owner_id AND v.lexeme_id=d.target_key)""",
        "ownerforms": "SELECT DISTINCT owner_id, normalized_token normalized_form, language_stage language_profile FROM occ JOIN doc USING (document_id, owner_id)",
        "amap": """SELECT owner_id, normalized_form, language_profile, dictionary_lemma lemma, normalized_lemma, skey source, confidence FROM (
            SELECT f.*, m.dictionary_lemma, m.normalized_lemma, m.skey, m.confidence, row_number() OVER (PARTITION BY f.owner_id, f.normalized_form, f.language_profile
              ORDER BY m.owner_id IS NULL, CASE WHEN f.language_profile='unknown' THEN CASE m.profile WHEN 'unknown' THEN 0 WHEN 'mixed' THEN 1 ELSE 2 END
                ELSE CASE m.profile WHEN f.language_profile THEN 0 WHEN 'mixed' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END END, m.confidence DESC, m.normalized_lemma) k
            FROM ownerforms f JOIN mapping m ON m.nf=f.normalized_form AND (m.owner_id IS NULL OR m.owner_id=f.owner_id)
            WHERE m.status='approved' AND m.mtype<>'ocr_correction_candidate' AND m.skey NOT IN ('fuzzy','fuzzy_ocr','ocr_correction_candidate')) WHERE k=1""",
        "imap": """SELECT owner_id, normalized_form, lemma, lower(lemma) normalized_lemma FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, normalized_form
            ORDER BY display_name, surface_form) k FROM cat WHERE lemma IS NOT NULL AND lemma<>'') WHERE k=1""",
        "resolved": """SELECT f.owner_id, f.normalized_form, f.language_profile, coalesce(m.lemma, l.canonical_form, i.lemma) dictionary_lemma,
            coalesce(m.normalized_lemma, l.canonical_normalized_form, i.normalized_lemma) normalized_dictionary_lemma,
            CASE WHEN m.lemma IS NOT NULL THEN m.source WHEN l.lexeme_id IS NOT NULL THEN 'internal_curated_lexeme_forms' WHEN i.lemma IS NOT NULL THEN 'imported_reference' END dictionary_lemma_source,
            p.lemma morphological_lemma,
            round(CASE WHEN m.lemma IS NOT NULL THEN m.confidence WHEN l.lexeme_id IS NOT NULL THEN 1.0 WHEN i.lemma IS NOT NULL THEN 0.85 WHEN p.lemma IS NOT NULL THEN 0.35 END::DOUBLE, 3) confidence,
            CASE WHEN m.lemma IS NOT NULL THEN 'resolved_by_approved_lexeme_mapping' WHEN l.lexeme_id IS NOT NULL THEN 'resolved_by_curated_lexeme_form'
              WHEN i.lemma IS NOT NULL THEN 'resolved_by_imported_reference_mapping' WHEN p.lemma IS NOT NULL THEN 'morphology_fallback_only' ELSE 'unresolved' END resolution_type
            FROM ownerforms f LEFT JOIN amap m USING (owner_id, normalized_form, language_profile) LEFT JOIN lexform x ON x.owner_id=f.owner_id AND x.normalized_form=f.normalized_form
            LEFT JOIN lexeme l ON l.owner_id=x.owner_id AND l.lexeme_id=x.lexeme_id LEFT JOIN imap i ON i.owner_id=f.owner_id AND i.normalized_form=f.normalized_form
            LEFT JOIN (SELECT owner_id, normalized_form, language_profile, min(lemma) lemma FROM analysis WHERE lemma IS NOT NULL GROUP BY 1,2,3) p
              ON p.owner_id=f.owner_id AND p.normalized_form=f.normalized_form AND p.language_profile=f.language_profile""",
    }


def evidence_tables() -> dict[str, str]:
    s, er, en = ARMENIAN[18], ARMENIAN[4] + ARMENIAN[17], ARMENIAN[4] + ARMENIAN[13]
    return {
        "turnword": f"""SELECT *, regexp_matches(token, '^\\p{{Lu}}') cap, ['PER','ORG','LOC','MISC'][length(token)%4+1] kind FROM (
            SELECT role, conv_id, turn, unnest(regexp_extract_all({armenian('text')}, '{WORD}')) token,
            unnest(range(1, len(regexp_extract_all({armenian('text')}, '{WORD}'))+1)) i FROM conversations)""",
        "marked": """SELECT *, cap AND (NOT coalesce(lag(cap) OVER w, false) OR lag(kind) OVER w<>kind) starts FROM turnword WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)""",
        "mention": """SELECT role source_id, conv_id, turn, min(i) i, string_agg(token, ' ' ORDER BY i) entity_surface, min(kind) entity_type FROM (
            SELECT *, count(*) FILTER (starts) OVER (PARTITION BY conv_id, turn ORDER BY i) span FROM marked) WHERE cap GROUP BY role, conv_id, turn, span""",
        "ner": """SELECT source_id, lower(entity_surface) normalized_surface, entity_type, count(*) occurrence_count,
            arg_min(entity_surface, (conv_id, turn, i)) entity_surface, CASE source_id WHEN 'user' THEN 0.85::DOUBLE ELSE 0.55::DOUBLE END confidence,
            CASE source_id WHEN 'user' THEN 'gold' ELSE 'silver' END source_kind FROM mention WHERE entity_type IN ('PER','ORG','LOC') GROUP BY 1,2,3""",
        "ctoken": f"""SELECT conv_id, lower(token) surface, CASE WHEN regexp_replace(lower(token), '{s}$', '')='' THEN lower(token) ELSE regexp_replace(lower(token), '{s}$', '') END lemma
            FROM turnword""",
        "csurface": "SELECT surface, lemma, count(*) token_count, count(DISTINCT conv_id) source_count FROM ctoken GROUP BY 1,2",
        "clemma": "SELECT lemma, count(*) token_count, count(DISTINCT conv_id) source_count FROM ctoken GROUP BY 1",
        "allform": """SELECT DISTINCT normalized_token normalized_form FROM occ UNION SELECT DISTINCT normalized_form FROM vocab
            UNION SELECT DISTINCT normalized_dictionary_lemma FROM resolved WHERE coalesce(normalized_dictionary_lemma,'')<>''""",
        "clookup": """SELECT normalized_form, lemma, token_count, source_count, k lemma_rank FROM (SELECT q.normalized_form, c.lemma, c.token_count, c.source_count,
              row_number() OVER (PARTITION BY q.normalized_form ORDER BY c.token_count DESC, c.lemma) k FROM allform q JOIN csurface c ON c.surface=q.normalized_form)
            UNION ALL SELECT q.normalized_form, c.lemma, c.token_count, c.source_count, 1 FROM allform q JOIN clemma c ON c.lemma=q.normalized_form
              WHERE NOT EXISTS (SELECT 1 FROM csurface x WHERE x.surface=q.normalized_form)""",
        "analysis": f"""SELECT o.owner_id, o.document_id, o.page_id, o.char_start, o.token, o.normalized_token normalized_form, d.language_stage language_profile,
            CASE d.language_stage WHEN 'classical' THEN 'xcl' ELSE 'eastern' END model_key,
            CASE WHEN NOT has_armenian THEN 'token_not_armenian' WHEN has_latin OR has_digits THEN 'token_not_supported_for_pie' WHEN length(token)=1 THEN 'empty_prediction' END failure_reason,
            CASE WHEN NOT has_armenian OR has_latin OR has_digits THEN 'skipped' WHEN length(token)=1 THEN 'failed' ELSE 'completed' END analysis_status,
            CASE WHEN has_armenian AND NOT has_latin AND NOT has_digits AND length(token)>1 THEN regexp_replace(token, '{s}$', '') END lemma,
            CASE WHEN has_armenian AND NOT has_latin AND NOT has_digits AND length(token)>1 THEN CASE WHEN regexp_matches(token, '({er}|{en})$') THEN 'VERB' ELSE 'NOUN' END END pos,
            token LIKE '%{s}' plural FROM occ o JOIN doc d USING (document_id, owner_id) WHERE d.language_stage IN ('classical','eastern')""",
        "eword": f"""SELECT owner_id, source_id, entry_id, unnest(regexp_extract_all(surface_form, '{WORD}')) token FROM entry""",
        "eanalysis": f"""SELECT owner_id, source_id, entry_id, token, lower(token) normalized_form,
            CASE WHEN regexp_matches(token,'\\p{{Armenian}}') AND NOT regexp_matches(token,'[\\p{{Latin}}\\p{{Nd}}]') AND length(token)>1 THEN regexp_replace(token, '{s}$', '') END lemma
            FROM eword WHERE regexp_matches(token,'\\p{{L}}')""",
        "worddist": """SELECT owner_id, normalized_form, kind, value, count(*) n FROM (
            SELECT owner_id, normalized_form, 'lemma' kind, lemma AS value FROM analysis WHERE analysis_status='completed'
            UNION ALL SELECT owner_id, normalized_form, 'pos', pos FROM analysis WHERE analysis_status='completed'
            UNION ALL SELECT owner_id, normalized_form, 'feature:Number', CASE WHEN plural THEN 'Plur' ELSE 'Sing' END FROM analysis WHERE analysis_status='completed'
            UNION ALL SELECT owner_id, normalized_form, 'feature:Case', 'Nom' FROM analysis WHERE analysis_status='completed'
            UNION ALL SELECT owner_id, normalized_form, 'feature:Case', 'Acc' FROM analysis WHERE analysis_status='completed' AND plural) GROUP BY 1,2,3,4""",
        "ecache": """SELECT normalized_form||'/'||k cache_id, CASE WHEN n%2=0 THEN translate(normalized_form, 'aeաե', 'AEԱԵ') ELSE normalized_form END query_text, normalized_form,
            CASE WHEN n%9=0 THEN 'failed' ELSE 'completed' END status, TIMESTAMP '2024-01-31' + to_days(CAST(k-1 AS INTEGER)) + to_hours(n) fetched_at, k,
            CASE WHEN n%4<>0 THEN TIMESTAMP '2024-01-31' + to_days(CAST(k-1 AS INTEGER)) + to_hours(n) + INTERVAL 24 HOUR END expires_at, n
            FROM (SELECT DISTINCT normalized_form, length(normalized_form) n FROM vocab), (VALUES (1),(2)) t(k)""",
        "eresult": """SELECT cache_id, normalized_form query_form, i result_seq, CASE i WHEN 1 THEN normalized_form ELSE normalized_form||'x' END matched_form,
            'Dictionary '||i source_title, CASE WHEN n%2=1 THEN 'see '||normalized_form END snippet, 'https://dictionary.example/'||i reference_link,
            CASE i WHEN 1 THEN 'normalized' ELSE 'fuzzy' END match_type, CASE i WHEN 1 THEN 100.0::DOUBLE ELSE 92.0::DOUBLE END match_score, n%3=0 trusted
            FROM ecache, (VALUES (1),(2)) t(i) WHERE n%5<>0 AND status='completed'""",
        "ecur": """SELECT c.*, (expires_at IS NULL OR expires_at > TIMESTAMP '2024-02-01 12:00:00') fresh, (SELECT count(*) FROM eresult r WHERE r.cache_id=c.cache_id) results
            FROM ecache c WHERE k=2""",
        "snap": """SELECT f.normalized_form, CASE WHEN c.cache_id IS NULL OR NOT c.fresh THEN 'unchecked' WHEN c.status='failed' THEN 'unavailable'
            WHEN c.results>0 THEN 'found' ELSE 'not_found' END external_status, c.cache_id, c.query_text, c.results FROM allform f LEFT JOIN ecur c USING (normalized_form)""",
    }


def discovery_tables() -> dict[str, str]:
    noise = r"(has_digits OR (length(nf)>1 AND regexp_matches(nf,'[\p{P}\p{S}]') AND length(regexp_replace(nf,'\P{L}','','g'))<=1))"
    single = r"regexp_full_match(nf,'\p{Armenian}')"
    west = "CASE WHEN profile IN ('unknown','mixed','western') THEN 1.0 WHEN profile='eastern' THEN 0.7 ELSE 0.55 END"
    east = "CASE WHEN profile IN ('unknown','mixed','eastern') THEN 1.0 WHEN profile='western' THEN 0.7 ELSE 0.55 END"
    rank = "(p1, p2, c, pk, ord, lem)"

    def best(name: str, flag: str) -> str:
        return f"min({{'p1':p1,'p2':p2,'c':c,'pk':pk,'ord':ord,'lem':lem,'mt':mt,'mf':mf,'conf':conf,'es':es}}) FILTER (usable AND {flag}) {name}"

    head = "mt='exact_headword_match' AND vs='validates_word' AND es='strong' AND dq='good'"
    dictionary = "pt IN ('imported_dictionary','web_dictionary')"
    lemma = f"vs='supports_word' AND es IN ('strong','medium') AND dq='good' AND (pt='curated_lexicon' OR {dictionary})"
    rules = {
        "r_known": f"{head} AND pt='curated_lexicon'", "r_dictionary": f"{head} AND {dictionary}", "r_lemma": f"mt='exact_lemma_match' AND {lemma}",
        "r_corpus": "mt IN ('corpus_token_attestation','corpus_lemma_attestation') AND vs='supports_word' AND es IN ('strong','medium','weak') AND pt='corpus'",
        "r_poor": "es IN ('strong','medium') AND dq IN ('poor','missing')",
        "r_morph": "mt='morphology_analysis_only' AND vs='suggests_candidate' AND pt='morphology'",
        "r_reject": "mt='rejected_artifact' AND vs='rejects'", "r_entity": "mt='named_entity_signal' AND pt='ner'",
        "r_weak": "es='weak' AND vs IN ('supports_word','suggests_candidate')",
    }
    tier = """CASE WHEN coalesce(nullif(hw,''), nullif(mf,''), nullif(lem,'')) IS NULL THEN NULL WHEN pt='curated_lexicon' AND vs='validates_word' THEN 1
        WHEN pt='web_dictionary' AND vs='validates_word' THEN 3 WHEN mt='exact_lemma_match' THEN 4
        WHEN mt IN ('corpus_token_attestation','corpus_lemma_attestation') THEN 5 END"""
    hidden = """'resolved_known','resolved_by_dictionary','attested_in_corpus','resolved_by_lemma','resolved_as_variant','poorly_defined',
        'weakly_attested','needs_linguist_research','probable_ocr_noise'"""
    return {
        "bucket": """SELECT b.*, d.script_type dominant_script_type FROM (SELECT owner_id, document_id, normalized_token nf, count(*) n, count(DISTINCT page_id) pages,
            bool_or(has_armenian) has_armenian, bool_or(has_digits) has_digits, count(*) FILTER (script_type IN ('latin','mixed','other')) n_foreign FROM occ GROUP BY 1,2,3) b
            JOIN (SELECT *, row_number() OVER (PARTITION BY document_id, nf ORDER BY k DESC, script_type) r FROM
              (SELECT document_id, normalized_token nf, script_type, count(*) k FROM occ GROUP BY 1,2,3)) d ON d.document_id=b.document_id AND d.nf=b.nf AND d.r=1""",
        "scoped": """SELECT DISTINCT b.owner_id, b.nf, d.language_stage profile, b.has_digits,
            CASE WHEN r.resolution_type LIKE 'resolved_%' THEN r.dictionary_lemma END dl, CASE WHEN r.resolution_type LIKE 'resolved_%' THEN r.normalized_dictionary_lemma END ndl,
            CASE WHEN r.resolution_type LIKE 'resolved_%' THEN r.confidence END rconf
            FROM bucket b JOIN doc d USING (document_id, owner_id) LEFT JOIN resolved r ON r.owner_id=b.owner_id AND r.normalized_form=b.nf AND r.language_profile=d.language_stage""",
        "topref": """SELECT * FROM (SELECT c.owner_id, c.normalized_form, c.surface_form, c.definition, s.language_stage, c.display_name,
            row_number() OVER (PARTITION BY c.owner_id, c.normalized_form ORDER BY c.surface_form, c.entry_id) k FROM cat c JOIN rsource s USING (owner_id, source_id)) WHERE k<=3""",
        "topner": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY normalized_surface ORDER BY source_kind, occurrence_count DESC, entity_surface, source_id, entity_type) k
            FROM ner WHERE source_id<>'system') WHERE k<=3""",
        "topext": """SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.matched_form ORDER BY r.result_seq, r.cache_id) k FROM eresult r
            JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY normalized_form ORDER BY fetched_at DESC) z FROM ecache WHERE status='completed') WHERE z=1) c USING (cache_id)) WHERE k<=3""",
        "rawevid": f"""SELECT scoped.owner_id, nf, profile, has_digits, NULL::VARCHAR document_id, 'internal_lexicon' pk, 'curated_lexicon' pt, 'mixed' ep, canonical_form mf, canonical_form hw, '' lem,
              CASE WHEN nf=lower(canonical_form) THEN 'exact_headword_match' WHEN contains(lower(canonical_form),nf) OR contains(nf,lower(canonical_form)) THEN 'substring_match' ELSE 'ambiguous_search_result' END mt,
              CASE WHEN nf=lower(canonical_form) THEN 'strong' ELSE 'none' END es, 'good' dq, CASE WHEN nf=lower(canonical_form) THEN 1.0::DOUBLE ELSE 0.05 END conf, nf=lower(canonical_form) ex, 100 ord
              FROM scoped JOIN (SELECT f.owner_id, f.normalized_form, l.canonical_form FROM lexform f JOIN lexeme l USING (owner_id, lexeme_id)) l ON l.owner_id=scoped.owner_id AND l.normalized_form=nf
            UNION ALL SELECT s.owner_id, nf, profile, has_digits, NULL, 'imported_references', 'imported_dictionary', t.language_stage, t.surface_form, t.surface_form, '',
              CASE WHEN t.definition IS NULL AND ({noise} OR {single}) THEN 'rejected_artifact' ELSE 'exact_headword_match' END,
              CASE WHEN t.definition IS NULL AND ({noise} OR {single}) THEN 'none' ELSE 'strong' END,
              CASE WHEN t.definition IS NULL AND ({noise} OR {single}) THEN 'unknown' WHEN t.definition IS NULL THEN 'missing' ELSE 'good' END,
              CASE WHEN t.definition IS NULL AND ({noise} OR {single}) THEN 0.0 ELSE 0.95 END, NOT (t.definition IS NULL AND ({noise} OR {single})), 200+k
              FROM scoped s JOIN topref t ON t.owner_id=s.owner_id AND t.normalized_form=nf
            UNION ALL SELECT s.owner_id, nf, profile, has_digits, NULL, 'internal_lexicon', 'curated_lexicon', 'mixed', l.canonical_form, l.canonical_form, dl, 'exact_lemma_match', 'medium', 'good',
              least(CASE WHEN ndl=lower(l.canonical_form) THEN 1.0 ELSE 0.05 END, coalesce(rconf,0.8)), true, 300
              FROM scoped s JOIN (SELECT f.owner_id, f.normalized_form, l.canonical_form FROM lexform f JOIN lexeme l USING (owner_id, lexeme_id)) l ON l.owner_id=s.owner_id AND l.normalized_form=ndl WHERE ndl<>nf
            UNION ALL SELECT s.owner_id, nf, profile, has_digits, NULL, 'imported_references', 'imported_dictionary', t.language_stage, t.surface_form, t.surface_form, dl, 'exact_lemma_match', 'medium',
              CASE WHEN t.definition IS NULL THEN 'missing' ELSE 'good' END, least(coalesce(rconf,0.8), CASE WHEN t.definition IS NULL THEN 0.55 ELSE 0.8 END), true, 400+k
              FROM scoped s JOIN topref t ON t.owner_id=s.owner_id AND t.normalized_form=ndl WHERE ndl<>nf AND k<=2
            UNION ALL SELECT owner_id, nf, profile, has_digits, NULL, 'nayiri_western_corpus', 'corpus', 'western', lemma, lemma, lemma, mt,
              CASE WHEN mt='corpus_token_attestation' THEN CASE WHEN strong THEN CASE WHEN {west}<0.75 THEN 'medium' ELSE 'strong' END ELSE 'weak' END ELSE 'none' END, 'unknown',
              CASE WHEN {west}<0.75 THEN round((CASE mt WHEN 'corpus_token_attestation' THEN CASE WHEN strong THEN 0.65 ELSE 0.45 END WHEN 'rejected_artifact' THEN 0 ELSE 0.05 END)::DOUBLE*({west})::DOUBLE,3)
                ELSE (CASE mt WHEN 'corpus_token_attestation' THEN CASE WHEN strong THEN 0.65 ELSE 0.45 END WHEN 'rejected_artifact' THEN 0 ELSE 0.05 END)::DOUBLE END, mt='corpus_token_attestation', 500+k
              FROM (SELECT s.owner_id, nf, profile, has_digits, c.lemma, c.lemma_rank k, c.token_count>=3 OR c.source_count>1 strong,
                CASE WHEN (length(nf)>1 AND regexp_matches(nf,'[\\p{{P}}\\p{{S}}]') AND length(regexp_replace(nf,'\\P{{L}}','','g'))<=1) OR {single} THEN 'rejected_artifact' WHEN nf=c.lemma THEN 'corpus_token_attestation'
                  WHEN contains(c.lemma, nf) THEN 'substring_match' ELSE 'ambiguous_search_result' END mt FROM scoped s JOIN clookup c ON c.normalized_form=nf WHERE c.lemma_rank<=3)
            UNION ALL SELECT owner_id, nf, profile, has_digits, NULL, 'nayiri_western_corpus', 'corpus', 'western', lemma, lemma, dl, 'corpus_lemma_attestation',
              CASE WHEN bad THEN 'none' WHEN ndl=lemma THEN CASE WHEN strong THEN 'strong' ELSE 'weak' END ELSE 'none' END, 'unknown',
              round((CASE WHEN bad THEN 0 WHEN ndl=lemma THEN CASE WHEN strong THEN 0.65 ELSE 0.45 END ELSE 0.05 END)::DOUBLE*({west})::DOUBLE,3), false, 600+k
              FROM (SELECT s.*, c.lemma, c.lemma_rank k, c.token_count>=3 OR c.source_count>1 strong,
                (length(ndl)>1 AND regexp_matches(ndl,'[\\p{{P}}\\p{{S}}]') AND length(regexp_replace(ndl,'\\P{{L}}','','g'))<=1) OR regexp_full_match(ndl,'\\p{{Armenian}}') bad
                FROM scoped s JOIN clookup c ON c.normalized_form=ndl WHERE ndl<>nf AND c.lemma_rank<=2)
            UNION ALL SELECT b.owner_id, nf, a.language_profile profile, b.has_digits, a.document_id, CASE a.language_profile WHEN 'classical' THEN 'pie_classical_morphology' ELSE 'pie_eastern_morphology' END, 'morphology', a.language_profile, NULL, NULL, a.l,
              CASE WHEN {noise} OR {single} THEN 'rejected_artifact' ELSE 'morphology_analysis_only' END, CASE WHEN {noise} OR {single} THEN 'none' ELSE 'weak' END, 'unknown',
              CASE WHEN {noise} OR {single} THEN 0.0 ELSE 0.35 END, false, 700
              FROM bucket b JOIN (SELECT DISTINCT document_id, normalized_form, language_profile, lower(lemma) l FROM analysis WHERE lemma<>'') a ON a.document_id=b.document_id AND a.normalized_form=nf
            UNION ALL SELECT s.owner_id, nf, profile, has_digits, NULL, 'pioner_ner', 'ner', 'eastern', entity_surface, NULL, '', 'named_entity_signal', CASE source_kind WHEN 'gold' THEN 'medium' ELSE 'weak' END, 'unknown',
              round(greatest(least(t.confidence-(CASE WHEN profile='classical' THEN 0.2 ELSE 0 END), 0.95), 0.1)::DOUBLE*({east})::DOUBLE,3), true, 800+k FROM scoped s JOIN topner t ON t.normalized_surface=nf
            UNION ALL SELECT owner_id, nf, profile, has_digits, NULL, 'nayiri_web', CASE WHEN trusted AND mt NOT IN ('fuzzy_ocr_candidate','ambiguous_search_result') THEN 'web_dictionary' ELSE 'ambiguous_external' END, 'mixed', matched_form,
              CASE WHEN mt='exact_headword_match' THEN matched_form END, '', mt, CASE mt WHEN 'fuzzy_ocr_candidate' THEN 'weak' WHEN 'exact_headword_match' THEN 'strong' ELSE 'none' END,
              CASE WHEN mt='rejected_artifact' THEN 'unknown' WHEN snippet IS NOT NULL THEN 'good' ELSE 'unknown' END,
              CASE mt WHEN 'rejected_artifact' THEN 0 WHEN 'fuzzy_ocr_candidate' THEN match_score/100 WHEN 'exact_headword_match' THEN 0.9 ELSE 0.05 END::DOUBLE, mt='exact_headword_match', 900+k
              FROM (SELECT s.*, t.*, CASE WHEN {noise} OR {single} THEN 'rejected_artifact' WHEN match_type='fuzzy' THEN 'fuzzy_ocr_candidate' WHEN trusted AND nf=matched_form THEN 'exact_headword_match' ELSE 'ambiguous_search_result' END mt
                FROM scoped s JOIN topext t ON t.matched_form=nf)""",
        "evid": f"""SELECT *, CASE mt WHEN 'exact_headword_match' THEN 'validates_word' WHEN 'exact_lemma_match' THEN 'supports_word' WHEN 'corpus_token_attestation' THEN 'supports_word'
              WHEN 'corpus_lemma_attestation' THEN 'supports_word' WHEN 'morphology_analysis_only' THEN 'suggests_candidate' WHEN 'named_entity_signal' THEN 'suggests_candidate'
              WHEN 'fuzzy_ocr_candidate' THEN 'suggests_candidate' WHEN 'rejected_artifact' THEN 'rejects' ELSE 'does_not_validate' END vs FROM (
              SELECT * FROM rawevid UNION ALL SELECT owner_id, nf, profile, has_digits, NULL, 'strict_validation', 'validation', 'mixed', NULL, NULL, '', 'rejected_artifact', 'none', 'unknown', 0.0, false, 990
              FROM scoped s WHERE ({noise} OR {single}) AND NOT EXISTS (SELECT 1 FROM rawevid r WHERE r.mt='exact_headword_match' AND r.owner_id=s.owner_id AND r.nf=s.nf AND r.profile=s.profile AND r.has_digits=s.has_digits))""",
        "rankevid": f"""SELECT *, p2 + CASE WHEN ep IN ('mixed','unknown') OR profile IN ('mixed','unknown') OR ep=profile THEN 0 ELSE 25 END p1, -conf c, {tier} tier,
              coalesce(nullif(hw,''), nullif(mf,''), nullif(lem,'')) cform,
              mt NOT IN ('substring_match','ambiguous_search_result') AND (pt NOT IN ('curated_lexicon','imported_dictionary') OR ex) AND (pk<>'nayiri_web' OR coalesce(hw,'')<>'') usable
              FROM (SELECT *, CASE pk WHEN 'internal_lexicon' THEN 1 WHEN 'imported_references' THEN 2 WHEN 'pie_classical_morphology' THEN 10 WHEN 'pie_eastern_morphology' THEN 11
                WHEN 'nayiri_western_corpus' THEN 21 WHEN 'pioner_ner' THEN 30 WHEN 'nayiri_web' THEN 50 ELSE 0 END p2 FROM evid)""",
        "bevid": """SELECT b.owner_id, b.document_id bdoc, b.n, b.pages, r.* EXCLUDE (owner_id) FROM bucket b JOIN doc d USING (document_id, owner_id)
              JOIN rankevid r ON r.owner_id=b.owner_id AND r.nf=b.nf AND r.profile=d.language_stage AND r.has_digits=b.has_digits AND (r.document_id IS NULL OR r.document_id=b.document_id)""",
        "fused": f"""SELECT bdoc, nf, {", ".join(best(n, f) for n, f in rules.items())},
              count(*) FILTER (es IN ('strong','medium') AND vs IN ('validates_word','supports_word') AND pt<>'ner') meaningful,
              count(DISTINCT CASE WHEN es IN ('strong','medium') AND vs IN ('validates_word','supports_word') AND pt<>'ner' THEN nullif(trim(coalesce(nullif(lem,''), mf)),'') END) meant,
              max(CASE dq WHEN 'good' THEN 1.0 WHEN 'poor' THEN 0.35 WHEN 'missing' THEN 0.0 ELSE 0.2 END::DOUBLE) dscore, count(*) evidence_count,
              min({{'tier':tier,'c':c,'pk':pk,'ord':ord,'f':cform}}) FILTER (tier IS NOT NULL) canon,
              {", ".join(f"count(DISTINCT cform) FILTER (tier={t}) t{t}" for t in (1, 3, 4, 5))} FROM bevid GROUP BY 1,2""",
        "cand0": """SELECT b.*, d.language_stage profile, x.lexeme_id linked, coalesce(m.ok, false) plausible, s.dl, f.* EXCLUDE (bdoc, nf),
              least(greatest(round((CASE WHEN dominant_script_type='digit_mixed' OR b.has_digits THEN 0.8 WHEN dominant_script_type IN ('mixed','latin') THEN 0.55 WHEN dominant_script_type='other' THEN 0.7 ELSE 0 END
                + CASE WHEN NOT has_armenian THEN 0.2 ELSE 0 END - CASE WHEN n>1 THEN 0.15 ELSE 0 END - CASE WHEN pages>1 THEN 0.1 ELSE 0 END)::DOUBLE, 2), 0.0), 1.0) risk
              FROM bucket b JOIN doc d USING (document_id, owner_id) LEFT JOIN lexform x ON x.owner_id=b.owner_id AND x.normalized_form=b.nf
              LEFT JOIN (SELECT document_id, normalized_form, true ok FROM analysis WHERE analysis_status='completed' GROUP BY 1,2) m ON m.document_id=b.document_id AND m.normalized_form=b.nf
              LEFT JOIN scoped s ON s.owner_id=b.owner_id AND s.nf=b.nf AND s.profile=d.language_stage AND s.has_digits=b.has_digits
              LEFT JOIN fused f ON f.bdoc=b.document_id AND f.nf=b.nf""",
        "cand1": """SELECT *, CASE WHEN linked IS NOT NULL OR r_known IS NOT NULL THEN 0 WHEN r_dictionary IS NOT NULL THEN 1 WHEN r_lemma IS NOT NULL THEN 2
              WHEN meaningful>=2 AND meant>1 THEN 4 WHEN r_corpus IS NOT NULL AND risk<0.45 THEN 5 WHEN r_poor IS NOT NULL THEN 6
              WHEN r_morph IS NOT NULL AND has_armenian AND risk<0.45 THEN 7 WHEN r_reject IS NOT NULL THEN 8 WHEN r_entity IS NOT NULL AND has_armenian THEN 9
              WHEN r_weak IS NOT NULL THEN 10 WHEN dominant_script_type='latin' AND NOT has_armenian THEN 11 WHEN risk>=0.75 AND n<=1 THEN 12 WHEN risk>=0.45 THEN 13
              WHEN has_armenian AND (n>1 OR plausible) THEN 14 ELSE 15 END rule FROM cand0""",
        "cand": f"""SELECT *, CASE WHEN resolution_status IN ({hidden}) THEN base ELSE least(100, greatest(0, base + least(15,n) + least(10,pages*2) + CASE WHEN plausible THEN 10 ELSE 0 END - CASE WHEN risk>=0.45 THEN 30 ELSE 0 END)) END::DOUBLE interest_score,
              resolution_status IN ({hidden}) OR candidate_type LIKE '%_suppressed' suppressed,
              CASE WHEN rule IN (8,11) THEN greatest(risk,0.75) ELSE risk END ocr_risk_score,
              CASE rule WHEN 0 THEN r_known WHEN 1 THEN r_dictionary WHEN 2 THEN r_lemma WHEN 5 THEN r_corpus WHEN 6 THEN r_poor WHEN 7 THEN r_morph WHEN 8 THEN r_reject WHEN 9 THEN r_entity WHEN 10 THEN r_weak END best,
              CASE WHEN canon IS NULL THEN NULL WHEN CASE canon.tier WHEN 1 THEN t1 WHEN 3 THEN t3 WHEN 4 THEN t4 ELSE t5 END>1 THEN NULL ELSE canon.f END canonical_form,
              resolution_status NOT IN ({hidden}) AND candidate_type NOT IN ('known_suppressed','attested_suppressed','noise_suppressed') AND has_armenian AND n_foreign=0
                AND (resolution_status<>'unknown_plausible' OR (n<4 AND pages<6)) visible
              FROM (SELECT *, CASE rule WHEN 0 THEN 'resolved_known' WHEN 1 THEN 'resolved_by_dictionary' WHEN 2 THEN 'resolved_by_lemma' WHEN 4 THEN 'conflicting_sources'
                WHEN 5 THEN 'attested_in_corpus' WHEN 6 THEN 'poorly_defined' WHEN 7 THEN 'unknown_plausible' WHEN 8 THEN 'probable_ocr_noise' WHEN 9 THEN 'possible_named_entity'
                WHEN 10 THEN 'weakly_attested' WHEN 11 THEN 'probable_ocr_noise' WHEN 12 THEN 'probable_ocr_noise' WHEN 13 THEN 'possible_ocr_noise' WHEN 14 THEN 'unknown_plausible' ELSE 'needs_linguist_research' END resolution_status,
              CASE rule WHEN 0 THEN 'known_suppressed' WHEN 1 THEN 'known_suppressed' WHEN 2 THEN 'known_suppressed' WHEN 4 THEN 'conflicting_sources' WHEN 5 THEN 'attested_suppressed' WHEN 6 THEN 'poorly_defined'
                WHEN 7 THEN 'unknown_plausible' WHEN 8 THEN 'noise_suppressed' WHEN 9 THEN 'named_entity_candidate' WHEN 10 THEN 'weakly_attested' WHEN 11 THEN 'noise_suppressed' WHEN 12 THEN 'noise_suppressed'
                WHEN 13 THEN 'possible_ocr_corruption' WHEN 14 THEN 'unknown_plausible' ELSE 'needs_linguist_research' END candidate_type,
              CASE rule WHEN 2 THEN 10 WHEN 4 THEN 70 WHEN 7 THEN 75 WHEN 9 THEN 72 WHEN 13 THEN 55 WHEN 14 THEN 80 ELSE 0 END base FROM cand1)""",
        "reviewed": """SELECT c.*, CASE WHEN l.quality=1 AND length(c.nf)%2=0 THEN 'reviewed' ELSE 'unreviewed' END review_status FROM cand c
              LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR)=c.document_id""",
    }


TABLES: dict[str, str] = {
    "doc": """SELECT CAST(doc_id AS VARCHAR) document_id, lang owner_id, 'doc-'||doc_id title,
        'scans/'||source||'/'||doc_id||'.pdf' original_filename,
        CASE WHEN right(source,1) IN ('0','4','8') THEN 'classical' WHEN right(source,1) IN ('1','5') THEN 'eastern'
             WHEN right(source,1) IN ('2','6') THEN 'western' ELSE 'unknown' END language_stage,
        CASE right(source,1) WHEN '9' THEN 'failed' WHEN '7' THEN 'processing' ELSE 'completed' END status, n_chars
        FROM documents""",
    "rawdoc": f"""SELECT CAST(doc_id AS VARCHAR) document_id, lang owner_id,
        CASE WHEN lang IN ('en','fr') THEN regexp_replace({armenian('text')},
               '([{ARMENIAN[0]}-{ARMENIAN[-1]}]{{4}})([{ARMENIAN[0]}-{ARMENIAN[-1]}]{{4}})', '\\1-'||chr(10)||'\\2', 'g')
             WHEN lang='es' THEN replace(text,'la','լա') ELSE text END AS text FROM documents""",
    "rawpage": f"""SELECT owner_id, document_id, document_id||':'||(i+1) page_id, CAST(i+1 AS INTEGER) page_number,
        {cleaned("array_to_string(lines[i*20+1:i*20+20], chr(10))")} raw_text
        FROM (SELECT owner_id, document_id, string_split(text, chr(10)) lines FROM rawdoc), unnest(range(0, (len(lines)-1)//20+1)) t(i)""",
    "page": f"""SELECT owner_id, document_id, page_id, page_number, {rejoined('raw_text')} page_text FROM rawpage""",
    "piece": f"""SELECT owner_id, document_id, page_id, page_number, unnest(regexp_extract_all(page_text, '{WORD}')) token,
        unnest(string_split_regex(page_text, '{WORD}')[1:len(regexp_extract_all(page_text, '{WORD}'))]) gap,
        unnest(range(1, len(regexp_extract_all(page_text, '{WORD}'))+1)) i FROM page""",
    "placed": """SELECT *, CAST(sum(length(gap)+length(token)) OVER (PARTITION BY page_id ORDER BY i) AS BIGINT) char_end FROM piece""",
    "occ": f"""SELECT owner_id, document_id, page_id, page_number, token, lower(token) normalized_token, {SCRIPT_CASE} script_type,
        regexp_matches(token,'\\p{{Nd}}') has_digits, regexp_matches(token,'\\p{{Latin}}') has_latin,
        regexp_matches(token,'\\p{{Armenian}}') has_armenian, length(token) token_length,
        char_end-length(token) char_start, char_end FROM placed WHERE regexp_matches(token,'\\p{{L}}')""",
    "occs": """SELECT o.*, (CASE WHEN o.char_start>25 THEN '...' ELSE '' END)
        || regexp_replace(regexp_replace(substr(p.page_text, greatest(o.char_start-25,0)+1,
             least(o.char_end+25, length(p.page_text))-greatest(o.char_start-25,0)), '\\s+', ' ', 'g'), '^ ', '')
        || (CASE WHEN o.char_end+25<length(p.page_text) THEN '...' ELSE '' END) AS context_snippet
        FROM occ o JOIN page p USING (page_id)""",
    "slice": """SELECT owner_id, normalized_token normalized_form, document_id, count(*) occurrence_count,
        count(DISTINCT page_id) page_count, count(*) FILTER (script_type='armenian') n_armenian,
        count(*) FILTER (script_type='digit_mixed') n_digit_mixed, count(*) FILTER (script_type='latin') n_latin,
        count(*) FILTER (script_type='mixed') n_mixed, count(*) FILTER (script_type='other') n_other FROM occ GROUP BY 1,2,3""",
    "scripts": "SELECT owner_id, normalized_token normalized_form, script_type, count(*) n FROM occ GROUP BY 1,2,3",
    "dominant": """SELECT owner_id, normalized_form, script_type dominant_script_type FROM
        (SELECT *, row_number() OVER (PARTITION BY owner_id, normalized_form ORDER BY n DESC, script_type) k FROM scripts) WHERE k=1""",
    "groups": """SELECT g.*, d.dominant_script_type FROM (SELECT owner_id, normalized_token normalized_form, count(*) occurrence_count,
        count(DISTINCT document_id) document_count, count(DISTINCT page_id) page_count FROM occ GROUP BY 1,2) g
        JOIN dominant d USING (owner_id, normalized_form)""",
}

TABLES.update(curated_tables())
TABLES.update(evidence_tables())
TABLES.update(discovery_tables())
TABLES.update({
    "ev": """SELECT user_id job_id, ['ingestion','reference_import','reference_matching','morphology','nayiri_trusted_lookup','discovery_build'][user_id%6+1] job_kind, event_id,
        ts created_at, event_type stage_code, least(100, floor(value))::INTEGER progress_percent FROM events""",
    "jb": """SELECT job_id, job_kind, ['en','fr','de','es'][job_id%4+1] owner_id, CASE l WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'queued' ELSE 'running' END status,
        c created_at, u updated_at, n items_processed, CAST(job_id%40 AS VARCHAR) document_id, CASE WHEN job_id%5=0 THEN job_id-7 END retry_of, CASE WHEN job_id%5=1 THEN job_id-7 END resume_of FROM (
        SELECT job_id, job_kind, min(created_at) c, max(created_at) FILTER (stage_code='view') u, arg_max(stage_code, (created_at, event_id)) l, count(*) n, max(created_at) last_at FROM ev GROUP BY 1,2)""",
    "jbstale": """SELECT j.*, coalesce(greatest(j.updated_at, e.m), j.created_at) last_progress_at, j.status IN ('queued','running') AND
        coalesce(greatest(j.updated_at, e.m), j.created_at) + INTERVAL 30 MINUTE <= TIMESTAMP '2024-01-30 20:00:00' is_stale FROM jb j LEFT JOIN (SELECT job_id, max(created_at) m FROM ev GROUP BY 1) e USING (job_id)""",
})


#: Evidence tables read one another several times over; each is worked out once.
SHARED = {*evidence_tables(), *discovery_tables()}


def sql(body: str) -> str:
    """``body`` with every common table expression it needs in front, dependencies first."""
    ordered: list[str] = []
    open_: set[str] = set()

    def place(text: str) -> None:
        words = set(re.findall(r"\w+", text))
        for name in TABLES:
            if name in words and name not in ordered and name not in open_:
                open_.add(name)
                place(TABLES[name])
                ordered.append(name)

    place(body)
    if not ordered:
        return body
    own = re.match(r"\s*WITH\s+", body)
    rest = ",\n" + body[own.end():] if own else "\n" + body
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in SHARED else ''}({TABLES[n]})" for n in ordered) + rest
