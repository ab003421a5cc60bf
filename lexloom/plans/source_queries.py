"""Queries on file sources and sinks; the files are written from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexloom import session
from lexloom.operators import external as ex, lexicon as lx, morphology as mo
from lexloom.plans.index_queries import _long
from lexloom.plans.registry import query
from lexloom.sources import files as fl, html as ht, sinks as sk


def _folder(w, name):
    return f"{session.shared_dir(w.spark)}/lexloom/{name}-{uuid.uuid4().hex[:12]}"


@query("SRC-3 SRC-14 SCL-11", r"""SELECT DISTINCT trim(line) surface_form, lower(trim(line)) normalized_form FROM (SELECT unnest(string_split(text, chr(10))) line FROM documents)
   WHERE trim(line)<>'' AND length(trim(line))<=120 AND NOT regexp_full_match(trim(line), '[^\p{L}\p{N}]+')""")
def txt_wordlist(w):
    """Every line of every document as a text file of entries."""
    folder = _folder(w, "txt_in")
    w.table("documents").select(F.explode(F.split("text", "\n")).alias("value")).write.text(folder)
    return fl.read_wordlists(w.spark, folder).select("surface_form", "normalized_form").distinct()


@query("SCL-11", r"""WITH b AS (SELECT trim(line) v FROM (SELECT unnest(string_split(text, chr(10))) line FROM documents) WHERE trim(line)<>'' AND length(trim(line))<=120 AND NOT regexp_full_match(trim(line), '[^\p{L}\p{N}]+')),
   p AS (SELECT unnest(CASE WHEN regexp_matches(v,'[;|/]') OR (length(v)-length(replace(v,',',''))=1 AND len(string_split_regex(v,'\s+'))<=6) THEN list_transform(string_split_regex(v,'\s*[;,|/]\s*'), lambda x: trim(x)) ELSE [v] END) c FROM b)
   SELECT DISTINCT c surface_form FROM p WHERE c<>'' AND NOT regexp_full_match(c, '[^\p{L}\p{N}]+')""")
def split_wordlist_blocks(w):
    blocks = w.table("documents").select(F.lit("all").alias("file"), F.explode(F.split("text", "\n")).alias("block"))
    return fl.entries_from_blocks(blocks, True).select("surface_form").distinct()


@query("SRC-4", """SELECT DISTINCT surface_form, normalized_form FROM vocab""")
def csv_wordlist(w):
    folder = _folder(w, "csv_in")
    w.vocabulary.select(F.col("surface_form").alias("Surface Form"), F.col("item_id").alias("item")).write.option("header", True).csv(folder)
    return fl.read_csv(w.spark, folder).select("surface_form", "normalized_form").distinct()


@query("SRC-4 SCL-12", r"""SELECT DISTINCT trim(line) surface_form FROM (SELECT unnest(string_split(text, ' ')) line FROM documents) WHERE trim(line)<>'' AND NOT regexp_matches(line,'[.!?։…]') AND NOT regexp_matches(trim(line),'\s')""")
def csv_single_column(w):
    """One-column files keep only rows that look like a word."""
    lines = w.table("documents").select(F.lit("all").alias("file"), F.explode(F.split("text", " ")).alias("words"))
    return fl.csv_entries(lines).select("surface_form").distinct()


@query("SRC-6", r"""WITH f AS (SELECT document_id, sum(greatest(length(raw_text),0)) FILTER (page_number%2=1) sz FROM rawpage GROUP BY 1),
   l AS (SELECT p.document_id, CASE WHEN page_number%2=1 THEN 'text' ELSE 'ocr' END kind, unnest(string_split(raw_text, chr(10))) line FROM rawpage p WHERE raw_text<>''),
   b AS (SELECT l.document_id, trim(line) v, coalesce(f.sz,0)>=40 layer FROM l JOIN f USING (document_id)
     WHERE (kind='text')=(coalesce(f.sz,0)>=40) AND trim(line)<>'' AND length(trim(line))<=120 AND NOT regexp_full_match(trim(line), '[^\p{L}\p{N}]+')),
   p AS (SELECT document_id, layer, unnest(CASE WHEN layer AND (regexp_matches(v,'[;|/]') OR (length(v)-length(replace(v,',',''))=1 AND len(string_split_regex(v,'\s+'))<=6))
     THEN list_transform(string_split_regex(v,'\s*[;,|/]\s*'), lambda x: trim(x)) ELSE [v] END) c FROM b)
   SELECT document_id, count(DISTINCT c) entries, CASE WHEN layer THEN 'pdf_text' ELSE 'pdf_ocr' END import_method FROM p WHERE c<>'' AND NOT regexp_full_match(c, '[^\p{L}\p{N}]+') GROUP BY 1,3""")
def pdf_wordlist_lines(w):
    """Odd pages have a text layer, even pages were recognized; only text layers are split at separators."""
    pages = w.raw_pages.where("raw_text <> ''").select(
        F.col("document_id").alias("file"), F.col("page_number").alias("page"), F.when(F.col("page_number") % 2 == 1, "text").otherwise("ocr").alias("kind"),
        F.explode(F.split("raw_text", "\n")).alias("block"),
    )
    return fl.pdf_entries(pages).groupBy(F.col("file").alias("document_id"), "import_method").agg(F.countDistinct("surface_form").alias("entries"))


@query("SRC-7", """SELECT role source, count(DISTINCT (conv_id, turn)) sentences, count(*) tokens, count(*) FILTER (cap) labelled FROM turnword GROUP BY 1""")
def sentence_files(w):
    """Token and label lines with blank lines between sentences, read back as sentences."""
    folder = _folder(w, "conll_in")
    block = F.concat(F.array_join(F.transform(F.arrays_zip("tokens", "labels"), lambda x: F.concat(x["tokens"], F.lit(" _ "), x["labels"])), "\n"), F.lit("\n"))
    w.sentences.where(F.size("tokens") > 0).select("source_id", block.alias("value")).write.partitionBy("source_id").text(folder)
    read = fl.read_sentence_files(w.spark, f"{folder}/source_id=*/*.txt")
    return read.groupBy(F.regexp_extract("file", "source_id=([a-z]+)/", 1).alias("source")).agg(
        F.count("*").alias("sentences"), F.sum(F.size("tokens")).cast("bigint").alias("tokens"),
        F.sum(F.size(F.filter("labels", lambda x: x != "O"))).cast("bigint").alias("labelled"),
    )


@query("SRC-8", """SELECT conv_id, turn, count(*) tokens, count(*) FILTER (cap) labelled FROM turnword GROUP BY 1,2""")
def sentence_records(w):
    """Records with other column names and integer labels."""
    names = ["O", "B-PER", "B-ORG", "B-LOC", "B-MISC", "I-PER", "I-ORG", "I-LOC", "I-MISC"]
    known = F.array(*[F.lit(n) for n in names])
    coded = w.sentences.where(F.size("tokens") > 0).select("conv_id", "turn", F.col("tokens").alias("words"), F.transform("labels", lambda x: (F.array_position(known, x) - 1).cast("int")).alias("ner_tags"))
    out = fl.sentence_records(coded, names)
    return out.select("conv_id", "turn", F.size("tokens").cast("bigint").alias("tokens"), F.size(F.filter("labels", lambda x: x != "O")).cast("bigint").alias("labelled"))


@query("SRC-9", r"""SELECT page_id, CASE WHEN contains(lower(url),'gold') OR contains(lower(url),'manual') OR contains(lower(regexp_extract(url,'([^/]*)$',1)),'test') THEN 'gold' ELSE 'silver' END kind,
   CASE WHEN contains(s,'train') THEN 'train' WHEN contains(s,'dev') THEN 'dev' WHEN contains(s,'test') THEN 'test' WHEN contains(s,'val') THEN 'val' WHEN s='' THEN 'unknown' ELSE s END split
   FROM (SELECT page_id, url, lower(regexp_replace(regexp_extract(url,'([^/]*)$',1), '^(.+)\.[^.]*$', '\1')) s FROM pages)""")
def source_kinds(w):
    kind, split = fl.source_kind_and_split(F.col("url"), F.lit("http://"))
    return w.table("pages").select("page_id", kind.alias("kind"), split.alias("split"))


@query("SRC-11", """SELECT nf normalized_surface_form, normalized_lemma normalized_dictionary_lemma, profile language_profile, max(confidence) confidence FROM mapping GROUP BY 1,2,3""")
def mapping_upsert(w):
    """Mapping rows of all owners written as csv and read back over the shared ones."""
    folder = _folder(w, "mapping_in")
    own = w.form_mappings.where(F.col("owner_id").isNotNull())
    own.select(
        F.col("normalized_surface_form").alias("surface_form"), "dictionary_lemma", "language_profile", "mapping_type", "source_type", "source_key", "confidence", "review_status"
    ).distinct().write.option("header", True).csv(folder)
    new = fl.mapping_rows(w.spark.read.csv(folder, header=True))
    old = w.form_mappings.where(F.col("owner_id").isNull()).select(
        F.col("normalized_surface_form").alias("surface_form"), "normalized_surface_form", "dictionary_lemma", "normalized_dictionary_lemma", F.lit(None).cast("string").alias("pos"),
        "language_profile", "mapping_type", "source_type", "source_key", "confidence", "review_status", F.lit(None).cast("string").alias("notes"),
    )
    return fl.upsert_mappings(old, new).select("normalized_surface_form", "normalized_dictionary_lemma", "language_profile", "confidence")


@query("SRC-12 SCL-20 SCL-21")
def dictionary_pages(w):
    """List items of every page as evidence for the page's first list word."""
    pages = w.table("pages")
    queries = pages.select("page_id", F.coalesce(F.nullif(F.regexp_extract("html", r'<a href="[^"]*">([^<]+)</a>', 1), F.lit("")), F.lit("none")).alias("query"))
    rows = ht.dictionary_results(pages, queries, "fuzzy")
    return rows.select("page_id", "query", "matched_form", "match_type", F.round("match_score", 4).alias("match_score"), "source_title", "reference_link", "source_subtitle", "snippet")


@query("SRC-13", """SELECT page_id sequence_key, char_start::BIGINT char_start, token token_surface, lemma, pos FROM analysis WHERE has_text""".replace("has_text", "analysis_status='completed'"))
def tagger_output(w):
    """Tagger rows written as tab-separated lines, parsed and put next to their tokens."""
    from lexloom.plans.inputs import Workbench

    done = w.analyses.where("analysis_status = 'completed'")
    raw = Workbench.tag(F.col("token_surface"))
    cells = F.concat_ws("\t", "token_surface", raw["raw_lemma"], raw["raw_pos"], raw["raw_features"])
    packed = done.select("page_id", F.struct("position", cells.alias("line")).alias("p")).groupBy("page_id").agg(F.array_sort(F.collect_list("p")).alias("lines"))
    head = F.array(F.lit("token\tlemma\tpos\tfeats"))
    lines = packed.select(F.col("page_id").alias("file"), F.posexplode(F.concat(head, F.transform("lines", lambda x: x["line"]))).alias("line_no", "line"))
    predictions = fl.tagger_rows(lines)
    tokens = packed.select(F.col("page_id").alias("file"), F.lit(0).alias("sequence"), F.posexplode("lines").alias("position", "t")).select(
        "file", "sequence", "position", F.col("t.position").alias("char_start"), F.substring_index("t.line", "\t", 1).alias("token_surface")
    )
    return fl.align_predictions(predictions, tokens).select(
        F.col("file").alias("sequence_key"), *_long("char_start"), "token_surface", mo.optional_text(F.col("raw_lemma")).alias("lemma"), mo.optional_text(F.col("raw_pos")).alias("pos")
    )


# Sinks --------------------------------------------------------------------------------


@query("SNK-1 SNK-2", "SELECT document_id, count(*) n FROM occ GROUP BY 1")
def replaced_documents(w):
    """Rows on disk, then all rows of the French owner's partition written again."""
    folder = _folder(w, "occ_table")
    narrow = w.any_occ.select("owner_id", "document_id", "page_id", "token")
    sk.append_occurrences(narrow, folder)
    sk.overwrite_partitions(narrow.where("owner_id = 'fr'"), folder, "owner_id")
    stored = w.spark.read.schema(narrow.schema).parquet(folder)
    again = sk.replace_documents(stored, narrow.where("owner_id = 'de'").select(stored.columns))
    return again.groupBy("document_id").agg(F.count("*").alias("n"))


@query("SNK-3", "SELECT page_id, CASE WHEN page_number>=2 THEN 'new' ELSE 'old' END origin FROM page")
def resumed_pages(w):
    """Pages from the second on come from a second extraction."""
    base = w.pages.select("document_id", "page_id", "page_number")
    starts = w.documents.select("document_id", F.lit(2).alias("start_page"))
    return sk.replace_from_page(base.withColumn("origin", F.lit("old")), base.withColumn("origin", F.lit("new")), starts).select("page_id", "origin")


@query("SNK-4", "SELECT owner_id, normalized_form, CASE WHEN occurrence_count>1 THEN occurrence_count+1 ELSE occurrence_count END occurrence_count FROM groups")
def upserted_groups(w):
    old = w.group_numbers.select("owner_id", "normalized_form", "occurrence_count")
    new = old.where("occurrence_count > 1").withColumn("occurrence_count", F.col("occurrence_count") + 1)
    return sk.upsert(old, new, lx.GROUP_KEY)


@query("SNK-5", "SELECT owner_id, target_type, target_key, entry_id, match_type FROM direct WHERE target_type='lexeme' OR match_type='exact'")
def replaced_matches(w):
    """Group targets are matched again, keeping exact matches only."""
    cols = ["owner_id", "target_type", "target_key", "entry_id", "match_type"]
    old = w.direct_matches.select(*cols)
    groups = old.where("target_type = 'lexicon_group'")
    return sk.replace_scope(old, groups.where("match_type = 'exact'"), cols[:3], scopes=groups)


@query("SNK-6", "SELECT document_id, nf normalized_form FROM cand WHERE n>1")
def dropped_candidates(w):
    return sk.drop_missing(w.any_candidates, w.buckets.where("occurrence_count > 1"), lx.SLICE_KEY).select("document_id", "normalized_form")


@query("SNK-7", "SELECT document_id, analysis_status, count(*) n FROM analysis WHERE model_key='eastern' OR analysis_status='completed' GROUP BY 1,2")
def replaced_analyses(w):
    """Classical documents are analyzed again and keep completed rows only."""
    scope = ["owner_id", "source_type", "model_key", "document_id"]
    rows = w.analyses.select(*scope, "page_id", "position", "analysis_status")
    classical = rows.where("model_key = 'xcl'")
    out = sk.replace_scope(rows, classical.where("analysis_status = 'completed'"), scope, scopes=classical)
    return out.groupBy("document_id", "analysis_status").agg(F.count("*").alias("n"))


@query("EXT-5", "SELECT cache_id, CASE WHEN expires_at IS NULL THEN NULL ELSE (epoch(expires_at)-epoch(fetched_at))::BIGINT END ttl_seconds FROM ecache")
def cache_lifetimes(w):
    ttl = F.unix_timestamp("expires_at") - F.unix_timestamp("fetched_at")
    return w.external_cache.select("cache_id", ttl.cast("bigint").alias("ttl_seconds"))
