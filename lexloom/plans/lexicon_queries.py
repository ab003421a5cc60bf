"""Queries on groups, curation and lemma resolution."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lexloom import session
from lexloom.functions import text as tx
from lexloom.operators import curation as cu, lexicon as lx, occurrences as oc, resolve as rs
from lexloom.plans.index_queries import _listed, _long
from lexloom.plans.registry import query

STATE = "owner_id, normalized_form, occurrence_count, document_count, page_count, dominant_script_type, group_state"
STATE_COLS = STATE.split(", ")


@query("LEX-10 LEX-12 LEX-13", f"""SELECT {STATE} FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY occurrence_count DESC, normalized_form) k
   FROM gstate WHERE group_state='unreviewed' AND dominant_script_type='armenian') WHERE k<=50""")
def top_candidate_forms(w):
    """The fifty most frequent candidate forms of every owner."""
    from pyspark.sql import Window

    order = Window.partitionBy("owner_id").orderBy(*lx.ordering())
    return lx.view(w.groups, "candidates").withColumn("k", F.row_number().over(order)).where("k <= 50").select(*STATE_COLS)


@query("LEX-5", f"SELECT {STATE}, linked_lexeme_id, linked_lexeme_canonical_form FROM gstate")
def group_state(w):
    return w.groups.select(*STATE_COLS, "linked_lexeme_id", "linked_lexeme_canonical_form")


@query("LEX-9", f"SELECT {STATE}, linked_lexeme_id FROM gstate")
def live_groups(w):
    return lx.live_groups(w.page_words, w.lexeme_forms, w.lexemes, w.reviews).select(*STATE_COLS, "linked_lexeme_id")


@query("LEX-9", """SELECT o.owner_id, o.document_id, o.normalized_token normalized_form, count(*) occurrence_count,
   CASE WHEN f.lexeme_id IS NOT NULL THEN 'linked' WHEN r.owner_id IS NOT NULL THEN 'ignored_noise' ELSE 'unreviewed' END group_state
   FROM occ o LEFT JOIN lexform f ON f.owner_id=o.owner_id AND f.normalized_form=o.normalized_token
   LEFT JOIN review r ON r.owner_id=o.owner_id AND r.normalized_form=o.normalized_token GROUP BY ALL""")
def live_document_groups(w):
    counts = w.page_words.groupBy("owner_id", "document_id", F.col("normalized_token").alias("normalized_form")).agg(
        F.count("*").alias("occurrence_count")
    )
    return lx.with_state(counts, w.lexeme_forms, w.lexemes, w.reviews).select(
        "owner_id", "document_id", "normalized_form", "occurrence_count", "group_state"
    )


@query("LEX-10", f"SELECT {STATE} FROM gstate WHERE group_state='unreviewed' AND dominant_script_type='armenian'")
def view_candidates(w):
    return lx.view(w.groups, "candidates").select(*STATE_COLS)


@query("LEX-10", f"SELECT {STATE} FROM gstate WHERE group_state='linked'")
def view_linked(w):
    return lx.view(w.groups, "linked").select(*STATE_COLS)


@query("LEX-10 SCL-8", f"SELECT {STATE} FROM gstate WHERE dominant_script_type<>'armenian' AND group_state<>'ignored_noise'")
def view_suspicious(w):
    return lx.view(w.groups, "suspicious").select(*STATE_COLS)


@query("LEX-10", f"SELECT {STATE} FROM gstate WHERE group_state='ignored_noise'")
def view_ignored(w):
    return lx.view(w.groups, "ignored").select(*STATE_COLS)


@query("LEX-10 LEX-13", "SELECT count(*) total FROM gstate")
def view_all_total(w):
    return lx.total(lx.view(w.groups, "all"))


@query("LEX-11", f"SELECT {STATE} FROM gstate WHERE normalized_form LIKE '%եղ%'")
def group_search(w):
    return lx.search_forms(w.groups, "ԵՂ").select(*STATE_COLS)


@query("LEX-12 LEX-13", f"SELECT {STATE} FROM gstate ORDER BY page_count, normalized_form, owner_id LIMIT 200 OFFSET 100")
def group_page_by_page_count(w):
    return lx.page(w.groups, 200, 100, "page_count", descending=False).select(*STATE_COLS)


@query("LEX-12", """SELECT sort_key, k, owner_id, normalized_form FROM (
   SELECT 'normalized_form' sort_key, row_number() OVER (ORDER BY normalized_form DESC, owner_id) k, owner_id, normalized_form FROM gstate
   UNION ALL SELECT 'occurrence_count', row_number() OVER (ORDER BY occurrence_count DESC, normalized_form, owner_id), owner_id, normalized_form FROM gstate
   UNION ALL SELECT 'page_count', row_number() OVER (ORDER BY page_count DESC, normalized_form, owner_id), owner_id, normalized_form FROM gstate
   UNION ALL SELECT 'group_state', row_number() OVER (ORDER BY group_state DESC, normalized_form, owner_id), owner_id, normalized_form FROM gstate
   UNION ALL SELECT 'dominant_script_type', row_number() OVER (ORDER BY dominant_script_type DESC, normalized_form, owner_id), owner_id, normalized_form FROM gstate
   ) WHERE k<=20""")
def group_sort_orders(w):
    """First page of every sort key."""
    from pyspark.sql import Window

    out = None
    for key in lx.SORT_KEYS:
        first = lx.page(w.groups, 20, 0, key)
        ordered = first.withColumn("k", F.row_number().over(Window.orderBy(*lx.ordering(key), "owner_id")).cast("bigint"))
        part = ordered.select(F.lit(key).alias("sort_key"), "k", "owner_id", "normalized_form")
        out = part if out is None else out.unionByName(part)
    return out


@query("LEX-14", """SELECT s.owner_id, s.document_id, s.normalized_form, s.occurrence_count, s.page_count, g.dominant_script_type, g.group_state, 1::BIGINT document_count
   FROM slice s JOIN gstate g USING (owner_id, normalized_form)""")
def document_group_listing(w):
    return lx.document_groups(w.groups, w.slice_numbers).select(
        "owner_id", "document_id", "normalized_form", "occurrence_count", "page_count", "dominant_script_type", "group_state", "document_count"
    )


@query("LEX-15 STA-5", f"SELECT {STATE} FROM gstate WHERE (owner_id, normalized_form) IN (SELECT (owner_id, normalized_form) FROM mgroup)")
def matched_groups(w):
    from lexloom.operators import status as st

    keys = st.matched_group_keys(w.latest, w.direct_matches, w.reference_entries, w.reference_sources)
    return lx.by_reference_status(w.groups, keys, "matched").select(*STATE_COLS)


@query("LEX-15", f"SELECT {STATE} FROM gstate g WHERE NOT EXISTS (SELECT 1 FROM mgroup m WHERE m.owner_id=g.owner_id AND m.normalized_form=g.normalized_form)")
def unmatched_groups(w):
    from lexloom.operators import status as st

    keys = st.matched_group_keys(w.latest, w.direct_matches, w.reference_entries, w.reference_sources)
    return lx.by_reference_status(w.groups, keys, "unmatched").select(*STATE_COLS)


FIRST100 = """(SELECT *, row_number() OVER (PARTITION BY owner_id, normalized_token ORDER BY page_number, char_start, document_id) k FROM occs)"""


@query("LEX-16", f"""SELECT o.owner_id, normalized_token normalized_form, k::BIGINT AS rank, document_id, page_id, token, context_snippet, char_start::BIGINT char_start,
   instr(context_snippet, token) > 0 AS has_token FROM {FIRST100} o WHERE k<=100""")
def group_detail(w):
    d = lx.group_detail(w.any_occ, w.documents)
    hit = F.substring("context_snippet", F.col("highlight_start") + 1, F.col("highlight_end") - F.col("highlight_start"))
    return d.select(
        "owner_id", "normalized_form", *_long("rank"), "document_id", "page_id", "token", "context_snippet", *_long("char_start"),
        (hit == F.col("token")).alias("has_token"),
    )


@query("LEX-17", f"""WITH f AS {FIRST100}, v AS (
   SELECT owner_id, normalized_token nf, 't' kind, token v, min(k) k FROM f WHERE k<=100 GROUP BY ALL
   UNION ALL SELECT owner_id, normalized_token, 'c', context_snippet, min(k) FROM f WHERE k<=100 GROUP BY ALL
   UNION ALL SELECT f.owner_id, normalized_token, 'd', title, min(k) FROM f JOIN doc USING (document_id) WHERE k<=100 GROUP BY ALL)
   SELECT owner_id, nf normalized_form, string_agg(v,' | ' ORDER BY rn) FILTER (kind='t') sample_tokens, string_agg(v,' | ' ORDER BY rn) FILTER (kind='c') sample_contexts,
     string_agg(v,' | ' ORDER BY rn) FILTER (kind='d') sample_document_titles FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, nf, kind ORDER BY k, v) rn FROM v) WHERE rn<=5 GROUP BY 1,2""")
def group_samples(w):
    return lx.detail_samples(w.any_occ, w.documents).select(
        "owner_id", "normalized_form", *_listed("sample_tokens", "sample_contexts", "sample_document_titles")
    )


@query("LEX-2", """WITH s AS (SELECT *, row_number() OVER (PARTITION BY owner_id, nf, document_id, kind ORDER BY k, v) pos FROM (
     SELECT owner_id, normalized_token nf, document_id, 't' kind, token v, min(page_number::BIGINT*10000000+char_start) k FROM occ GROUP BY ALL
     UNION ALL SELECT owner_id, normalized_token, document_id, 'c', context_snippet, min(page_number::BIGINT*10000000+char_start) FROM occs GROUP BY ALL)),
   m AS (SELECT owner_id, nf, kind, v, min((document_id, pos)) k FROM s WHERE pos<=5 GROUP BY ALL
     UNION ALL SELECT o.owner_id, normalized_token, 'd', title, min((document_id, 0::BIGINT)) FROM occ o JOIN doc USING (document_id) GROUP BY ALL)
   SELECT owner_id, nf normalized_form, string_agg(v,' | ' ORDER BY rn) FILTER (kind='t') sample_tokens, string_agg(v,' | ' ORDER BY rn) FILTER (kind='c') sample_contexts,
     string_agg(v,' | ' ORDER BY rn) FILTER (kind='d') sample_document_titles FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, nf, kind ORDER BY k, v) rn FROM m) WHERE rn<=5 GROUP BY 1,2""")
def group_rollup_samples(w):
    return lx.group_samples(w.any_samples, w.documents).select(
        "owner_id", "normalized_form", *_listed("sample_tokens", "sample_contexts", "sample_document_titles")
    )


LAST_PAGES = "(SELECT document_id, max(page_number) page_number FROM page GROUP BY 1)"


@query("LEX-6 LEX-8", "SELECT * FROM slice")
def incremental_index(w):
    """Index without every document's last page, then the last pages as a delta."""
    # Pages lie by document, so the last one is marked where it is, before any word is read.
    pages = w.pages.withColumn("last_page", F.max("page_number").over(Window.partitionBy("document_id")))
    is_last = F.col("page_number") == F.col("last_page")
    base, delta = (oc.page_words(pages.where(side)) for side in (~is_last, is_last))
    arriving = pages.where(is_last).select("document_id", "page_id")
    merged = lx.replace_document_pages(base, delta, arriving)
    return lx.refresh_slices(lx.slice_counts(base), merged, arriving).drop(*lx.FLAGS)


@query("LEX-7 LEX-8", """SELECT owner_id, normalized_token normalized_form, count(*) occurrence_count, count(DISTINCT document_id) document_count, count(DISTINCT page_id) page_count
   FROM occ JOIN doc d USING (document_id, owner_id) WHERE d.status<>'failed' GROUP BY 1,2""")
def cleared_documents(w):
    """Failed documents leave the index; only their forms are recomputed."""
    gone = w.documents.where(F.col("status") == "failed").select("document_id")
    slices = w.slice_numbers
    affected = slices.join(gone, "document_id", "left_semi")
    kept = slices.join(gone, "document_id", "left_anti")
    return lx.refresh_groups(w.group_numbers, kept, affected).select(
        "owner_id", "normalized_form", "occurrence_count", "document_count", "page_count"
    )


# Curation -------------------------------------------------------------------------


@query("OCC-3", """SELECT o.page_id, o.char_start::BIGINT char_start, f.lexeme_id FROM occ o
   LEFT JOIN lexform f ON f.owner_id=o.owner_id AND f.normalized_form=o.normalized_token""")
def assigned_lexemes(w):
    return oc.assign_lexemes(w.any_occ, w.lexeme_forms).select("page_id", *_long("char_start"), "lexeme_id")


REQUEST_SQL = """request AS (SELECT owner_id, owner_id||'-rq-'||left(normalized_form,2) request_id, normalized_form FROM vocab GROUP BY ALL),
   refused AS (SELECT DISTINCT request_id FROM request r JOIN lexform f USING (owner_id, normalized_form))"""


def _kept(df):
    return session.save(df, "claims")


def _requests(w):
    """Forms that share two first letters are asked for as one new lexeme."""
    forms = w.vocabulary.select("owner_id", "normalized_form").distinct()
    return forms.groupBy("owner_id", F.concat(F.col("owner_id"), F.lit("-rq-"), F.substring("normalized_form", 1, 2)).alias("request_id")).agg(
        F.array_sort(F.collect_set("normalized_form")).alias("forms")
    ).select(
        "owner_id", "request_id", "forms", F.get("forms", F.lit(0)).alias("canonical_form"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("notes"), F.lit(99).cast("bigint").alias("created_seq"),
    )


@query("CUR-1", f"WITH {REQUEST_SQL} SELECT owner_id, request_id, normalized_form, lexeme_id FROM request JOIN lexform USING (owner_id, normalized_form)")
def lexeme_conflicts(w):
    return cu.form_conflicts(_requests(w), w.lexeme_forms).select("owner_id", "request_id", "normalized_form", "lexeme_id")


@query("CUR-1", f"""WITH {REQUEST_SQL} SELECT owner_id, min(normalized_form) canonical_form, min(normalized_form) canonical_normalized_form, 'draft' status, count(*) forms
   FROM request WHERE request_id NOT IN (SELECT request_id FROM refused) GROUP BY owner_id, request_id""")
def created_lexemes(w):
    made, forms = cu.create_lexemes(_requests(w), w.lexeme_forms, _kept)
    counts = forms.groupBy("owner_id", "lexeme_id").agg(F.count("*").alias("forms"))
    return made.join(counts, ["owner_id", "lexeme_id"]).select("owner_id", "canonical_form", "canonical_normalized_form", "status", "forms")


def _chains(w):
    """Free words by rank; in every four, requests 1, 2 and 3 each want a word and the next."""
    free = w.vocabulary.select("owner_id", "normalized_form").distinct().join(w.lexeme_forms, ["owner_id", "normalized_form"], "left_anti")
    ranked = free.withColumn("n", F.row_number().over(Window.partitionBy("owner_id").orderBy("normalized_form")))
    wanted = ranked.select("owner_id", "normalized_form", F.explode(F.array(F.col("n"), F.col("n") - 1)).alias("n")).where("n % 4 IN (1, 2, 3)")
    return wanted.groupBy("owner_id", "n").agg(F.array_sort(F.collect_set("normalized_form")).alias("forms"))


@query("CUR-1", """WITH v AS (SELECT owner_id, normalized_form, row_number() OVER (PARTITION BY owner_id ORDER BY normalized_form) n FROM
     (SELECT DISTINCT owner_id, normalized_form FROM vocab x WHERE NOT EXISTS (SELECT 1 FROM lexform f WHERE f.owner_id=x.owner_id AND f.normalized_form=x.normalized_form)))
   SELECT a.owner_id, a.n::BIGINT request, b.normalized_form FROM v a JOIN v b ON b.owner_id=a.owner_id AND b.n-a.n IN (0, 1) WHERE a.n%4 IN (1, 3)""")
def overlapping_requests(w):
    """Requests of one batch that want the same words: the first of each pair wins."""
    chains = _chains(w)
    request = chains.select(
        "owner_id", F.concat_ws("-", "owner_id", "n").alias("request_id"), "forms", F.get("forms", F.lit(0)).alias("canonical_form"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("notes"), F.col("n").cast("bigint").alias("created_seq"),
    )
    made, forms = cu.create_lexemes(request, w.lexeme_forms, _kept)
    return forms.join(made.select("lexeme_id", "created_seq"), "lexeme_id").select("owner_id", F.col("created_seq").alias("request"), "normalized_form")


@query("CUR-5", """WITH v AS (SELECT owner_id, normalized_form, row_number() OVER (PARTITION BY owner_id ORDER BY normalized_form) n FROM
     (SELECT DISTINCT owner_id, normalized_form FROM vocab x WHERE NOT EXISTS (SELECT 1 FROM lexform f WHERE f.owner_id=x.owner_id AND f.normalized_form=x.normalized_form)))
   SELECT owner_id, normalized_form, CASE WHEN n%4 IN (1, 2) THEN 'linked' WHEN n%4=3 THEN 'unreviewed' ELSE 'ignored_noise' END group_state FROM v v2
   WHERE n%4 IN (0, 1, 3) OR EXISTS (SELECT 1 FROM v p WHERE p.owner_id=v2.owner_id AND p.n=v2.n-1)""")
def ordered_actions(w):
    """Actions in request order: a merge after a creation of the same word fails, the last of ignore and unignore counts."""
    chains = _chains(w)
    none = F.lit(None).cast("string")
    base = chains.select("owner_id", "n", "forms", F.get("forms", F.lit(0)).alias("first"))
    some = w.lexemes.groupBy("owner_id").agg(F.min("lexeme_id").alias("some_id"))
    def act(rows, action, forms, seq, lexeme=none):
        return rows.select(
            "owner_id", F.concat_ws("-", "owner_id", F.lit(action), "n", F.lit(str(seq))).alias("request_id"), F.lit(action).alias("action"), forms.alias("forms"),
            F.get(forms, F.lit(0)).alias("canonical_form"), lexeme.alias("lexeme_id"), none.alias("status"), none.alias("notes"), none.alias("reviewer_note"),
            F.lit(seq).cast("bigint").alias("created_seq"),
        )
    ones, threes = base.where("n % 4 = 1"), base.where("n % 4 = 3")
    last = F.slice("forms", 2, 1)
    actions = (
        act(ones, "create_lexeme", F.col("forms"), 1).unionByName(act(ones.join(some, "owner_id"), "merge_into_lexeme", F.col("forms"), 2, F.col("some_id")))
        .unionByName(act(threes, "ignore", F.array("first"), 1)).unionByName(act(threes, "unignore", F.array("first"), 2))
        .unionByName(act(threes, "unignore", last, 3)).unionByName(act(threes, "ignore", last, 4))
    )
    return cu.run_actions(actions, w.lexemes, w.lexeme_forms, w.reviews, _kept)[3].select("owner_id", "normalized_form", "group_state")


MERGE_SQL = """merges AS (SELECT DISTINCT l.owner_id, l.lexeme_id, v.normalized_form FROM lexeme l JOIN vocab v ON v.owner_id=l.owner_id
     AND left(v.normalized_form,3)=left(l.canonical_normalized_form,3)),
   bad AS (SELECT DISTINCT m.owner_id, m.lexeme_id FROM merges m JOIN lexform f USING (owner_id, normalized_form) WHERE f.lexeme_id<>m.lexeme_id)"""


@query("CUR-2", f"""WITH {MERGE_SQL} SELECT owner_id, normalized_form, lexeme_id FROM lexform UNION
   SELECT m.owner_id, m.normalized_form, m.lexeme_id FROM merges m WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.owner_id=m.owner_id AND b.lexeme_id=m.lexeme_id)""")
def merged_lexeme_forms(w):
    near = w.vocabulary.select("owner_id", "normalized_form", F.substring("normalized_form", 1, 3).alias("p")).distinct()
    merges = w.lexemes.withColumn("p", F.substring("canonical_normalized_form", 1, 3)).join(near, ["owner_id", "p"]).select(
        "owner_id", "lexeme_id", "normalized_form"
    )
    return cu.merge_forms(w.lexeme_forms, merges, _kept)


@query("CUR-3", """SELECT owner_id, lexeme_id, CASE WHEN status='draft' THEN canonical_form||'X' ELSE canonical_form END canonical_form,
   CASE WHEN status='draft' THEN lower(canonical_form||'X') ELSE canonical_normalized_form END canonical_normalized_form,
   CASE WHEN status='draft' THEN 'approved' ELSE status END status FROM lexeme""")
def updated_lexemes(w):
    updates = w.lexemes.where(F.col("status") == "draft").select(
        "owner_id", "lexeme_id", F.concat(F.lit(" "), "canonical_form", F.lit("X ")).alias("canonical_form"),
        F.lit(None).cast("string").alias("notes"), F.lit("approved").alias("status"),
    )
    return cu.update_lexemes(w.lexemes, updates).drop("notes", "created_seq")


@query("CUR-4", """SELECT owner_id, normalized_form, 'ignored_noise' review_status FROM (SELECT owner_id, normalized_form FROM review
   UNION SELECT owner_id, normalized_form FROM vocab WHERE length(latin)=5) x WHERE NOT EXISTS
   (SELECT 1 FROM vocab v WHERE v.owner_id=x.owner_id AND v.normalized_form=x.normalized_form AND length(v.latin)=6)""")
def ignore_and_unignore(w):
    of = lambda n: w.vocabulary.where(F.length("latin") == n).select("owner_id", "normalized_form", F.lit("noise").alias("reviewer_note"))
    return cu.unignore_forms(cu.ignore_forms(w.reviews, of(5)), of(6)).select("owner_id", "normalized_form", "review_status")


@query("CUR-5", """WITH a AS (SELECT DISTINCT owner_id, normalized_form, CASE WHEN length(latin)=5 THEN 'ignore' WHEN length(latin)=6 THEN 'unignore' ELSE 'create_lexeme' END act FROM vocab),
   made AS (SELECT * FROM a WHERE act='create_lexeme' AND NOT EXISTS (SELECT 1 FROM lexform f WHERE f.owner_id=a.owner_id AND f.normalized_form=a.normalized_form)),
   rv AS (SELECT owner_id, normalized_form FROM review UNION SELECT owner_id, normalized_form FROM a WHERE act='ignore')
   SELECT DISTINCT a.owner_id, a.normalized_form, CASE WHEN f.lexeme_id IS NOT NULL OR m.act IS NOT NULL THEN 'linked'
     WHEN r.owner_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a u WHERE u.owner_id=a.owner_id AND u.normalized_form=a.normalized_form AND u.act='unignore') THEN 'ignored_noise' ELSE 'unreviewed' END group_state
   FROM a LEFT JOIN lexform f USING (owner_id, normalized_form) LEFT JOIN made m ON m.owner_id=a.owner_id AND m.normalized_form=a.normalized_form
   LEFT JOIN rv r ON r.owner_id=a.owner_id AND r.normalized_form=a.normalized_form""")
def batch_actions(w):
    n = F.length("latin")
    actions = w.vocabulary.select("owner_id", "latin", "normalized_form").distinct().select(
        "owner_id", "normalized_form", F.when(n == 5, "ignore").when(n == 6, "unignore").otherwise("create_lexeme").alias("action")
    ).distinct().select(
        "owner_id", F.concat_ws("/", "owner_id", "action", "normalized_form").alias("request_id"), "action",
        F.array("normalized_form").alias("forms"), F.col("normalized_form").alias("canonical_form"),
        F.lit(None).cast("string").alias("lexeme_id"), F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("notes"), F.lit(None).cast("string").alias("reviewer_note"), F.lit(99).cast("bigint").alias("created_seq"),
    )
    return cu.run_actions(actions, w.lexemes, w.lexeme_forms, w.reviews, _kept)[3].select("owner_id", "normalized_form", "group_state")


@query("CUR-6", """SELECT l.owner_id, l.lexeme_id, l.canonical_form, l.status, count(*) form_count, coalesce(sum(g.occurrence_count),0)::BIGINT occurrence_count
   FROM lexeme l JOIN lexform f USING (owner_id, lexeme_id) LEFT JOIN groups g ON g.owner_id=f.owner_id AND g.normalized_form=f.normalized_form GROUP BY ALL""")
def lexeme_listing(w):
    return cu.list_lexemes(w.lexemes, w.lexeme_forms, w.group_numbers).select(
        "owner_id", "lexeme_id", "canonical_form", "status", "form_count", "occurrence_count"
    )


@query("CUR-7", "SELECT owner_id, lexeme_id, canonical_form FROM lexeme ORDER BY canonical_form, lexeme_id LIMIT 100")
def lexeme_picker(w):
    return cu.lexeme_picker(w.lexemes, 100).select("owner_id", "lexeme_id", "canonical_form")


@query("CUR-8", """WITH last AS (SELECT f.owner_id, f.lexeme_id, o.context_snippet, row_number() OVER (PARTITION BY f.owner_id, f.lexeme_id
     ORDER BY document_id DESC, page_number DESC, char_start DESC) k FROM occs o JOIN lexform f ON f.owner_id=o.owner_id AND f.normalized_form=o.normalized_token),
   u AS (SELECT owner_id, lexeme_id, context_snippet, min(k) k FROM last WHERE k<=50 GROUP BY ALL),
   v AS (SELECT *, row_number() OVER (PARTITION BY owner_id, lexeme_id ORDER BY k, context_snippet) rn FROM u)
   SELECT l.owner_id, l.lexeme_id, (SELECT string_agg(context_snippet, ' | ' ORDER BY rn) FROM v WHERE v.owner_id=l.owner_id AND v.lexeme_id=l.lexeme_id AND rn<=5) sample_contexts FROM lexeme l""")
def lexeme_details(w):
    occ = oc.assign_lexemes(w.any_occ, w.lexeme_forms)
    return cu.lexeme_detail(w.lexemes, w.lexeme_forms, occ, w.group_numbers).select("owner_id", "lexeme_id", *_listed("sample_contexts"))


# Lemma resolution -------------------------------------------------------------------


@query("RES-1", "SELECT owner_id, normalized_form, language_profile, lemma, normalized_lemma, source, round(confidence,3) confidence FROM amap")
def approved_mappings(w):
    return rs.approved_mappings(w.scoped_forms, w.form_mappings).select(
        "owner_id", "normalized_form", "language_profile", "lemma", "normalized_lemma", "source", F.round("confidence", 3).alias("confidence")
    )


@query("RES-2", "SELECT owner_id, normalized_form, canonical_form lemma, canonical_normalized_form normalized_lemma FROM lexform JOIN lexeme USING (owner_id, lexeme_id)")
def curated_lemmas(w):
    return rs.curated_lemmas(w.lexeme_forms, w.lexemes).select("owner_id", "normalized_form", "lemma", "normalized_lemma")


@query("RES-3 SCL-26", "SELECT owner_id, normalized_form, lemma, normalized_lemma FROM imap")
def imported_lemmas(w):
    return rs.imported_lemmas(w.reference_entries, w.reference_sources).select("owner_id", "normalized_form", "lemma", "normalized_lemma")


@query("RES-4", "SELECT * FROM resolved")
def lemma_resolution(w):
    return w.resolutions.withColumn("confidence", F.round("confidence", 3))


@query("RES-5", "SELECT DISTINCT owner_id, normalized_dictionary_lemma normalized_form FROM resolved WHERE coalesce(normalized_dictionary_lemma,'')<>''")
def structured_lemmas(w):
    return rs.structured_lemmas(w.resolutions)
