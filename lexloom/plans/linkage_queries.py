"""Queries on wordlist import, matching and reference status."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import profiles as pf
from lexloom.operators import linkage as lk, status as st
from lexloom.plans.index_queries import _long
from lexloom.plans.registry import query


@query("REF-1", """SELECT owner_id, source_id, count(*) rows_read, count(*) FILTER (latin NOT LIKE '%s') rows_imported, count(*) FILTER (latin LIKE '%s') rows_skipped
   FROM (SELECT DISTINCT owner_id, owner_id||'-wl-'||(item_id%4) source_id, latin FROM vocab) GROUP BY 1,2""")
def import_counts(w):
    """Entries with a lemma are already there; the whole list is imported again."""
    held = w.reference_entries.where(F.col("metadata")["lemma"].isNotNull())
    return lk.import_entries(held, w.reference_entries)[1]


@query("REF-2", "SELECT owner_id, source_id, display_name, surface_form, normalized_form, last_import_method FROM cat")
def active_catalog(w):
    return w.catalog.select("owner_id", "source_id", "display_name", "surface_form", "normalized_form", "last_import_method")


MATCH = "owner_id, target_type, target_key, source_id, entry_id, surface_form, match_type"


@query("REF-3", f"SELECT {MATCH} FROM direct WHERE match_type='exact'")
def exact_matches(w):
    return lk.exact_matches(w.targets, w.catalog).select(*MATCH.split(", "))


@query("REF-4", f"SELECT {MATCH} FROM direct WHERE match_type='normalized'")
def normalized_matches(w):
    return lk.normalized_matches(w.targets, w.catalog).select(*MATCH.split(", "))


# Common subsequence by rows; pairs that byte edit distance rules out are left out first.
FUZZY = """WITH rest AS (SELECT t.* FROM target t WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.owner_id=t.owner_id AND d.target_type=t.target_type AND d.target_key=t.target_key)),
   pair AS (SELECT DISTINCT r.owner_id, r.value a, c.normalized_form b, length(r.value) la, length(c.normalized_form) lb FROM rest r JOIN cat c ON c.owner_id=r.owner_id
     AND left(c.normalized_form, 1)=left(r.value, 1) AND length(c.normalized_form) BETWEEN length(r.value)-2 AND length(r.value)+2
     WHERE length(r.value)>2 AND c.last_import_method<>'pdf_ocr' AND c.normalized_form<>r.value AND (length(r.value)=3 OR left(c.normalized_form,2)=left(r.value,2))
     AND levenshtein(r.value, c.normalized_form) <= 3*((length(r.value)+length(c.normalized_form))//10)),
   scored AS (SELECT * FROM (WITH RECURSIVE lcs AS (SELECT owner_id, a, b, la, lb, 0 i, list_transform(range(0, lb+1), lambda x: 0::BIGINT) line FROM pair
     UNION ALL SELECT owner_id, a, b, la, lb, i+1, list_concat([0::BIGINT], list_transform(range(1, lb+1), lambda j: list_max(c[1:j]))) FROM
       (SELECT *, list_transform(range(1, lb+1), lambda j: CASE WHEN substr(a, i+1, 1)=substr(b, j, 1) THEN line[j]+1 ELSE line[j+1] END) c FROM lcs WHERE i<la))
     SELECT owner_id, a, b, (1.0::DOUBLE-(la+lb-2*line[lb+1])/(la+lb)::DOUBLE)*100 score FROM lcs WHERE i=la) WHERE score>=90)
   SELECT r.owner_id, r.target_type, r.target_key, c.source_id, c.entry_id, c.surface_form, 'fuzzy' match_type, round(max(s.score), 2) match_score
   FROM rest r JOIN scored s ON s.owner_id=r.owner_id AND s.a=r.value JOIN cat c ON c.owner_id=r.owner_id AND c.normalized_form=s.b AND c.last_import_method<>'pdf_ocr' GROUP BY ALL"""


@query("REF-5 SCL-13", FUZZY)
def fuzzy_matches(w):
    """Conservative fuzzy matches of candidate forms and lexemes nothing else matched."""
    rest = w.targets.join(w.direct_matches.select(*lk.TARGET_KEY).distinct(), lk.TARGET_KEY, "left_anti")
    return lk.fuzzy_matches(rest, w.catalog).select(*MATCH.split(", "), "match_score")


@query("REF-6", f"SELECT {MATCH}, row_number() OVER (PARTITION BY owner_id, target_type, target_key ORDER BY torder, display_name, surface_form, entry_id)::BIGINT match_rank FROM direct")
def ranked_matches(w):
    return lk.ranked(w.direct_matches).select(*MATCH.split(", "), *_long("match_rank"))


@query("REF-7", "SELECT owner_id, target_type, target_key, target_label, value FROM target")
def match_targets(w):
    return w.targets


@query("REF-8 REF-12", """SELECT t.owner_id, t.target_type, t.target_key, t.target_label, CASE WHEN d.n>0 THEN 'matched' ELSE 'unmatched' END match_status, coalesce(d.n,0) match_count,
   d.best_type best_match_type, d.best_source best_source_display_name, d.best_form best_matched_form
   FROM (SELECT DISTINCT owner_id, target_type, target_key, target_label FROM target) t LEFT JOIN dsum d USING (owner_id, target_type, target_key)""")
def internal_to_reference(w):
    return lk.internal_to_reference(w.targets, w.catalog, allow_fuzzy=False).drop("best_match_score")


@query("REF-8", """SELECT t.owner_id, t.target_type, count(*) total_items, count(d.n) matched_items, count(*)-count(d.n) unmatched_items,
   count(*) FILTER (d.best_type='exact') exact_match_count, count(*) FILTER (d.best_type='normalized') normalized_match_count, 0::BIGINT fuzzy_match_count
   FROM (SELECT DISTINCT owner_id, target_type, target_key FROM target) t LEFT JOIN dsum d USING (owner_id, target_type, target_key) GROUP BY 1,2""")
def match_run_totals(w):
    return lk.run_stats(lk.internal_to_reference(w.targets, w.catalog, allow_fuzzy=False))


# The same runs with fuzzy matches on; the three queries without them keep their SQL.
FUZZY_RUN = f"""SELECT t.*, CASE WHEN m.n>0 THEN 'matched' ELSE 'unmatched' END match_status, coalesce(m.n, 0) match_count, m.best_type best_match_type,
   m.best_score best_match_score, m.best_source best_source_display_name, m.best_form best_matched_form
   FROM (SELECT DISTINCT owner_id, target_type, target_key, target_label FROM target) t
   LEFT JOIN (SELECT owner_id, target_type, target_key, n, best_type, NULL::DOUBLE best_score, best_source, best_form FROM dsum
     UNION ALL SELECT owner_id, target_type, target_key, count(*), 'fuzzy', max(match_score),
       arg_min(display_name, (-match_score, display_name, surface_form, entry_id)), arg_min(surface_form, (-match_score, display_name, surface_form, entry_id))
     FROM (SELECT f.*, c.display_name FROM ({FUZZY}) f JOIN cat c ON c.owner_id=f.owner_id AND c.entry_id=f.entry_id) GROUP BY 1,2,3) m USING (owner_id, target_type, target_key)"""


@query("REF-8 REF-5", FUZZY_RUN)
def internal_to_reference_fuzzy(w):
    return lk.internal_to_reference(w.targets, w.catalog)


@query("REF-8 REF-5", f"""SELECT owner_id, target_type, count(*) total_items, count(*) FILTER (match_status='matched') matched_items,
   count(*) FILTER (match_status='unmatched') unmatched_items, count(*) FILTER (best_match_type='exact') exact_match_count,
   count(*) FILTER (best_match_type='normalized') normalized_match_count, count(*) FILTER (best_match_type='fuzzy') fuzzy_match_count FROM ({FUZZY_RUN}) GROUP BY 1,2""")
def match_run_totals_fuzzy(w):
    return lk.run_stats(lk.internal_to_reference(w.targets, w.catalog))


@query("REF-13 REF-5", f"""SELECT owner_id, target_key, target_label FROM ({FUZZY_RUN})
   WHERE match_status='unmatched' AND target_type='lexicon_group' AND contains(target_label, 'եղ')""")
def unmatched_target_results_fuzzy(w):
    rows = lk.internal_to_reference(w.targets, w.catalog)
    return lk.list_target_results(rows, "unmatched", "lexicon_group", "եղ").select("owner_id", "target_key", "target_label")


RESULT = """owner_id, source_id, run_id, entry_id, target_label, match_status, match_count::BIGINT match_count, exists_in_lexicon, found_in_books,
   matching_lexeme_count::BIGINT matching_lexeme_count, best_lexeme_id, best_document_id, best_document_title, best_page_number::BIGINT best_page_number, best_context_snippet"""
RESULT_COLS = ["owner_id", "source_id", "run_id", "entry_id", "target_label", "match_status", "match_count", "exists_in_lexicon", "found_in_books",
               "matching_lexeme_count", "best_lexeme_id", "best_document_id", "best_document_title", "best_page_number", "best_context_snippet"]


def _result(df):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in ("best_page_number", "match_count", "matching_lexeme_count") else F.col(c) for c in RESULT_COLS])


@query("REF-9", f"SELECT {RESULT} FROM result")
def source_to_internal(w):
    return _result(w.run_results)


@query("REF-9", """SELECT entry_id, coalesce(x.matching_lexeme_count,0) match_count, coalesce(x.matching_lexeme_count,0)>0 exists_in_lexicon, false found_in_books
   FROM entry e LEFT JOIN lexev x ON x.owner_id=e.owner_id AND x.normalized_form=e.normalized_form""")
def source_to_lexicon_only(w):
    rows = lk.source_to_internal(w.reference_entries, lk.lexeme_evidence(w.lexemes, w.lexeme_forms), w.book_evidence, "lexicon")
    return rows.select("entry_id", "match_count", "exists_in_lexicon", "found_in_books")


@query("REF-10", "SELECT * FROM lexev")
def matching_lexemes(w):
    return lk.lexeme_evidence(w.lexemes, w.lexeme_forms)


@query("REF-11 SCL-30", """SELECT owner_id, normalized_form, occurrence_count, best_document_id, best_document_title, best_page_number::BIGINT best_page_number,
   best_context_snippet, '/documents/'||best_document_id||'?page='||best_page_number reference_link FROM bookev""")
def book_evidence(w):
    return w.book_evidence.select(
        "owner_id", "normalized_form", "occurrence_count", "best_document_id", "best_document_title", *_long("best_page_number"),
        "best_context_snippet", "reference_link",
    )


@query("REF-13", """SELECT t.owner_id, t.target_key, t.target_label FROM (SELECT DISTINCT owner_id, target_type, target_key, target_label FROM target) t
   LEFT JOIN dsum d USING (owner_id, target_type, target_key) WHERE d.n IS NULL AND t.target_type='lexicon_group' AND contains(t.target_label, 'եղ')""")
def unmatched_target_results(w):
    rows = lk.internal_to_reference(w.targets, w.catalog, allow_fuzzy=False)
    return lk.list_target_results(rows, "unmatched", "lexicon_group", "եղ").select("owner_id", "target_key", "target_label")


@query("REF-14", f"SELECT {RESULT} FROM result WHERE match_status='matched' AND found_in_books AND contains(normalized_form, 'ե')")
def book_entry_results(w):
    return _result(lk.list_entry_results(w.run_results, "matched", "books_only", "Ե"))


@query("REF-15", """SELECT r.run_id, r.entry_id, o.document_id, o.page_number::BIGINT page_number, o.char_start::BIGINT char_start
   FROM result r JOIN occ o ON o.owner_id=r.owner_id AND o.normalized_token=r.normalized_form WHERE r.run_status='completed' AND r.created_seq=3""")
def entry_result_details(w):
    """All book occurrences behind the newest run of every source."""
    newest = w.match_runs.groupBy("source_id").agg(F.max_by("run_id", "created_seq").alias("run_id"))
    rows = w.run_results.join(newest.select("run_id"), "run_id", "left_semi")
    return lk.entry_result_details(rows, w.any_occ, w.documents).select("run_id", "entry_id", "document_id", *_long("page_number", "char_start"))


@query("REF-16", "SELECT owner_id, source_id, run_id, status FROM runs ORDER BY created_seq DESC, run_id DESC LIMIT 20")
def run_listing(w):
    return w.match_runs.orderBy(F.desc("created_seq"), F.desc("run_id")).limit(20).select("owner_id", "source_id", "run_id", "status")


@query("REF-17", """SELECT s.owner_id, s.source_id, s.display_name, (SELECT count(*) FROM entry e WHERE e.source_id=s.source_id) entry_count,
   s.source_id||'-run-3' latest_import_id, 'completed' latest_import_status FROM rsource s""")
def source_listing(w):
    return lk.list_sources(w.reference_sources, w.reference_entries, w.imports).select(
        "owner_id", "source_id", "display_name", "entry_count", "latest_import_id", "latest_import_status"
    )


@query("REF-18", """SELECT s.owner_id, s.source_id, s.source_id||'-run-3' latest_run_id, count(e.entry_id) entry_count, count(m.entry_id) matched_entry_count,
   count(e.entry_id)-count(m.entry_id) unmatched_entry_count FROM rsource s JOIN entry e USING (owner_id, source_id) LEFT JOIN mentry m ON m.entry_id=e.entry_id GROUP BY 1,2,3""")
def source_details(w):
    return lk.source_details(w.reference_sources, w.reference_entries, w.imports, w.match_runs, w.entry_status).select(
        "owner_id", "source_id", "latest_run_id", "entry_count", "matched_entry_count", "unmatched_entry_count"
    )


@query("REF-19", "SELECT source_id, run_id import_id, status FROM runs ORDER BY created_seq DESC, run_id DESC LIMIT 20 OFFSET 5")
def import_listing(w):
    return w.imports.orderBy(F.desc("created_seq"), F.desc("import_id")).offset(5).limit(20).select("source_id", "import_id", "status")


@query("SCL-19", """WITH n AS (SELECT owner_id, regexp_replace(lower(display_name), '[^a-z0-9]+', '_', 'g') slug, source_id FROM rsource)
   SELECT owner_id, source_id, 'word_list'||CASE WHEN k=1 THEN '_2' ELSE '_'||(k+1) END source_key FROM
   (SELECT owner_id, source_id, row_number() OVER (PARTITION BY owner_id ORDER BY source_id) k FROM n)""")
def next_source_keys(w):
    """Every source asks for the same name again; one key is taken already."""
    names = w.reference_sources.select("owner_id", F.col("source_id").alias("seq"), F.lit(" Word - List! ").alias("display_name"))
    taken = w.reference_sources.select("owner_id", F.lit("word_list").alias("source_key")).distinct()
    return lk.next_source_keys(taken, names).select("owner_id", F.col("seq").alias("source_id"), "source_key")


@query("STA-1", f"SELECT {RESULT} FROM latest")
def latest_entry_results(w):
    return _result(w.latest)


@query("STA-2", "SELECT * FROM gstatus")
def group_reference_status(w):
    return st.group_status(w.group_numbers, w.latest, w.direct_matches, w.reference_entries, w.reference_sources)


@query("STA-3 STA-9", "SELECT owner_id, lexeme_id, has_reference_match, reference_match_count, best_source, best_form FROM lstatus")
def lexeme_reference_status(w):
    return w.lexeme_status.select("owner_id", "lexeme_id", "has_reference_match", "reference_match_count", "best_source", "best_form")


@query("STA-4", """SELECT e.owner_id, e.source_id, e.entry_id, coalesce(l.match_status='matched', d.n>0, false) has_reference_match,
   CASE WHEN l.match_status='matched' THEN l.match_count WHEN l.entry_id IS NULL AND d.n>0 THEN d.n ELSE 0 END::BIGINT reference_match_count,
   CASE WHEN l.entry_id IS NOT NULL THEN l.match_status WHEN d.n>0 THEN 'matched' END latest_match_status,
   CASE WHEN l.entry_id IS NOT NULL THEN l.exists_in_lexicon WHEN d.n>0 THEN true END exists_in_lexicon,
   CASE WHEN l.entry_id IS NOT NULL THEN l.found_in_books WHEN d.n>0 THEN false END found_in_books
   FROM entry e LEFT JOIN latest l ON l.entry_id=e.entry_id LEFT JOIN (SELECT entry_id, count(*) n FROM direct GROUP BY 1) d ON d.entry_id=e.entry_id""")
def entry_reference_status(w):
    return w.entry_status.select(
        "owner_id", "source_id", "entry_id", "has_reference_match", "reference_match_count", "latest_match_status", "exists_in_lexicon", "found_in_books"
    )


@query("STA-5", "SELECT DISTINCT owner_id, normalized_form FROM mgroup")
def matched_group_keys(w):
    return st.matched_group_keys(w.latest, w.direct_matches, w.reference_entries, w.reference_sources)


@query("STA-5", "SELECT DISTINCT owner_id, lexeme_id FROM mlexeme")
def matched_lexeme_keys(w):
    return st.matched_lexeme_keys(w.lexemes, w.lexeme_forms, w.latest, w.direct_matches)


@query("STA-6", "SELECT DISTINCT owner_id, entry_id FROM mentry")
def matched_entries(w):
    return st.matched_entries(w.latest, w.direct_matches)


@query("STA-7", "SELECT owner_id, target_type, target_key, n reference_match_count, best_source, best_form, best_type FROM dsum")
def direct_match_summary(w):
    parts = [st.direct_summary(w.direct_matches, w.reference_sources, t).withColumn("target_type", F.lit(t)) for t in ("lexicon_group", "lexeme")]
    return parts[0].unionByName(parts[1]).drop("best_score")


@query("STA-8", "SELECT owner_id, normalized_form, n reference_match_count, best_source, best_form FROM esum")
def exact_entry_summary(w):
    return st.exact_summary(w.reference_entries, w.reference_sources).drop("best_type", "best_score")


@query("SCL-25", "SELECT entry_id, CASE WHEN definition IS NOT NULL THEN 'good' ELSE 'missing' END definition_quality, lemma dictionary_lemma FROM entry")
def entry_definition_quality(w):
    return w.reference_entries.select(
        "entry_id", pf.definition_quality(F.col("metadata")).alias("definition_quality"), pf.dictionary_lemma(F.col("metadata")).alias("dictionary_lemma")
    )
