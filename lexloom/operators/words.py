"""Evidence about words across books, wordlists, lexicon and external sources (WRD).

Requests are a table (owner_id, query_form), so one word and a million words are
answered by the same plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.functions import profiles as pf, text as tx
from lexloom.functions.similarity import block_similarity, similar_pairs
from lexloom.operators import linkage as lk


FUZZY_THRESHOLD = 85.0
FUZZY_FORM_LIMIT = 5
ASK = ["owner_id", "query_form"]
ITEM = [
    "source_type", "source_id", "source_title", "word_form", "item_form", "matched_form", "page_number", "item_key", "reference_link", "via",
]


def _items(rows: DataFrame, **fields) -> DataFrame:
    kinds = {"page_number": "int"}
    return rows.select(*ASK, *[
        (f if isinstance(f, Column) else F.lit(f)).cast(kinds.get(n, "string")).alias(n) for n, f in ((n, fields.get(n)) for n in ITEM)
    ])


def occurrence_key() -> Column:
    return F.concat_ws("@", "page_id", "char_start")


def book_items(requests: DataFrame, occ: DataFrame, documents: DataFrame) -> DataFrame:
    """WRD-1: book occurrences of the form; the few requests are broadcast, or frequent forms split, at run time."""
    hits = requests.join(occ.withColumnRenamed("normalized_token", "query_form"), ASK)
    return _book(hits.withColumn("own_form", F.col("query_form")), documents, F.lit(None).cast("string"), "token")


def book_lemma_items(requests: DataFrame, analyses: DataFrame, documents: DataFrame) -> DataFrame:
    """WRD-2: book occurrences whose tagger lemma is the form."""
    done = analyses.where(F.col("analysis_status") == "completed").select(
        "owner_id", F.col("lemma_normalized").alias("query_form"), "document_id", "page_id", F.col("position").alias("char_start"),
        F.col("token_surface").alias("token"), F.col("token_normalized").alias("own_form"), "lemma",
        "page_number",
    )
    hits = requests.join(done, ASK)
    return _book(hits, documents, F.coalesce("lemma", "query_form"), "lemma")


def _book(hits: DataFrame, documents: DataFrame, matched: Column, via: str) -> DataFrame:
    rows = hits.join(documents.select("document_id", "title"), "document_id")
    return _items(
        rows, source_type="imported_book", source_id=F.col("document_id"), source_title=F.col("title"), word_form=F.col("token"),
        item_form=F.col("own_form"), matched_form=matched, page_number=F.col("page_number"), item_key=occurrence_key(),
        reference_link=pf.document_link(F.col("document_id"), F.col("page_number")), via=via,
    )


def merge_items(token_items: DataFrame, lemma_items: DataFrame) -> DataFrame:
    """WRD-3/4: one item per place, the direct hit wins over the lemma hit."""
    rows = token_items.withColumn("rank", F.lit(0)).unionByName(lemma_items.withColumn("rank", F.lit(1)))
    fields = [n for n in ITEM if n not in ("source_type", "item_key")]
    best = F.min_by(F.struct(*fields), F.struct("rank", F.coalesce("matched_form", F.lit(""))))
    return rows.groupBy(*ASK, "source_type", "item_key").agg(best.alias("i")).select(
        *ASK, *[F.col(n) if n in ("source_type", "item_key") else F.col(f"i.{n}").alias(n) for n in ITEM]
    )


def entry_items(requests: DataFrame, entries: DataFrame, sources: DataFrame) -> DataFrame:
    """WRD-4: wordlist entries of the form."""
    rows = requests.join(entries.withColumn("query_form", F.col("normalized_form")), ASK)
    return _entry(rows, sources, F.lit(None).cast("string"), "token")


def entry_lemma_items(requests: DataFrame, entry_analyses: DataFrame, entries: DataFrame, sources: DataFrame) -> DataFrame:
    """WRD-4: wordlist entries with a word whose tagger lemma is the form."""
    done = entry_analyses.where(F.col("analysis_status") == "completed").select("owner_id", "entry_id", F.col("lemma_normalized").alias("query_form"), "lemma")
    rows = requests.join(done, ASK).join(entries, ["owner_id", "entry_id"])
    return _entry(rows, sources, F.coalesce("lemma", "query_form"), "lemma")


def _entry(rows: DataFrame, sources: DataFrame, matched: Column, via: str) -> DataFrame:
    named = rows.join(sources.select("owner_id", "source_id", "display_name"), ["owner_id", "source_id"])
    return _items(
        named, source_type="reference_source", source_id=F.col("source_id"), source_title=F.col("display_name"), word_form=F.col("surface_form"),
        item_form=F.col("normalized_form"), matched_form=matched, item_key=F.col("entry_id"),
        reference_link=F.concat(F.lit("/reference-sources/"), "source_id"), via=via,
    )


def lexeme_samples(occ: DataFrame, lexeme_forms: DataFrame) -> DataFrame:
    """WRD-5: first occurrence of each lexeme; per form first, on the map side."""
    order = F.struct("page_number", "document_id", "char_start")
    per_form = occ.groupBy("owner_id", F.col("normalized_token").alias("normalized_form")).agg(
        F.min(order).alias("place"), F.min_by("context_snippet", order).alias("context_snippet")
    )
    return per_form.join(lexeme_forms, ["owner_id", "normalized_form"]).groupBy("owner_id", "lexeme_id").agg(
        F.min("place").alias("place"), F.min_by("context_snippet", "place").alias("context_snippet")
    ).select("owner_id", "lexeme_id", F.col("place.page_number").alias("page_number"), "context_snippet")


def lexicon_items(requests: DataFrame, lexemes: DataFrame, lexeme_forms: DataFrame, samples: DataFrame) -> DataFrame:
    """WRD-5: lexemes by canonical form or any form; two equi joins instead of one OR join."""
    hits = lk.matching_lexemes(lexemes, lexeme_forms).withColumnRenamed("normalized_form", "query_form")
    rows = requests.join(hits, ASK).join(samples, ["owner_id", "lexeme_id"], "left")
    return _items(
        rows, source_type="lexicon", source_id=F.col("lexeme_id"), source_title=F.col("canonical_form"), word_form=F.col("canonical_form"),
        item_form=F.col("query_form"), page_number=F.col("page_number"), item_key=F.col("lexeme_id"),
        reference_link=F.concat(F.lit("/lexemes/"), "lexeme_id"), via="token",
    )


def entity_items(requests: DataFrame, entries: DataFrame, sources: DataFrame, limit: int = 10) -> DataFrame:
    """WRD-6: named-entity entries of the form."""
    active = sources.where("is_active").select("source_id", "source_kind", "dataset_split", "display_name")
    order = Window.partitionBy("normalized_surface").orderBy("source_kind", F.desc("occurrence_count"), "entity_surface", "source_id", "entity_type")
    top = entries.drop("source_kind").join(active, "source_id").withColumn("entity_rank", F.row_number().over(order)).where(F.col("entity_rank") <= limit)
    return requests.join(top.withColumnRenamed("normalized_surface", "query_form"), "query_form")


def corpus_items(requests: DataFrame, matches: DataFrame, limit: int = 20) -> DataFrame:
    """WRD-7: corpus lemmas of the form with their match type."""
    hits = matches.where(F.col("lemma_rank") <= limit).withColumnRenamed("normalized_form", "query_form")
    same = F.col("lemma") == F.col("query_form")
    return requests.join(hits, "query_form").select(
        *ASK, F.lit(pf.CORPUS_PROVIDER).alias("provider_key"), F.lit("Nayiri Corpus").alias("provider_display_name"),
        F.lit("Nayiri Western Armenian Corpus").alias("source_title"), F.col("lemma").alias("matched_form"), F.lit(None).cast("string").alias("reference_link"),
        F.concat(F.col("token_count"), F.lit(" attested tokens across "), F.col("source_count"), F.lit(" sources")).alias("source_subtitle"),
        F.when(same, "normalized").otherwise("fuzzy").alias("match_type"), F.when(same, 100.0).alias("match_score"),
    )


def external_items(requests: DataFrame, cached: DataFrame, corpus: DataFrame) -> DataFrame:
    """WRD-8/14: cached dictionary results and corpus rows, cached ones first on equal keys."""
    hits = requests.join(cached.withColumnRenamed("normalized_form", "query_form"), "query_form").select(
        *ASK, "provider_key", "provider_display_name", F.coalesce("source_title", "provider_display_name").alias("source_title"), "matched_form",
        "reference_link", F.lit(None).cast("string").alias("source_subtitle"), "match_type", "match_score", F.lit(0).alias("rank"),
    )
    rows = hits.unionByName(corpus.withColumn("rank", F.lit(1)))
    key = [*ASK, "provider_key", "matched_form", "link_key", "source_title"]
    keyed = rows.withColumn("link_key", F.coalesce("reference_link", F.lit("")))
    names = ["provider_display_name", "reference_link", "source_subtitle", "match_type", "match_score"]
    return keyed.groupBy(*key).agg(F.min_by(F.struct(*names), F.col("rank")).alias("r")).select(
        *[k for k in key if k != "link_key"], *[F.col(f"r.{n}").alias(n) for n in names]
    )


def external_status(requests: DataFrame, items: DataFrame, statuses: DataFrame) -> DataFrame:
    """WRD-14: completed when anything was found, else what the cache says."""
    found = items.groupBy(*ASK).agg(F.count("*").alias("n"))
    known = statuses.withColumnRenamed("normalized_form", "query_form")
    return requests.join(found, ASK, "left").join(known, "query_form", "left").select(
        *ASK, F.when(F.col("n") > 0, "completed").otherwise(F.coalesce("lookup_status", F.lit("unavailable"))).alias("external_status"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("external_hits"),
    )


def evidence_summary(items: DataFrame) -> DataFrame:
    """WRD-9: hits and distinct sources per word."""
    per_source = items.groupBy(*ASK, "source_type", "source_id").agg(F.count("*").alias("n"))
    return per_source.groupBy(*ASK).agg(F.sum("n").alias("total_hits"), F.count("*").alias("source_count"))


def evidence_page(items: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """WRD-9: one page of every word's evidence in display order."""
    order = Window.partitionBy(*ASK).orderBy("source_type", "source_title", F.coalesce("page_number", F.lit(0)), "word_form", "item_key")
    return items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= offset + limit).where(F.col("place") > offset)


def related_matches(requests: DataFrame, group_status: DataFrame, lexeme_status: DataFrame, lexemes: DataFrame, lexeme_forms: DataFrame) -> DataFrame:
    """WRD-10: best reference matches of the form and of its lexemes, without repeats."""
    best = ["best_source", "best_form", "best_type", "best_score"]
    own = requests.join(group_status.where("has_reference_match").withColumnRenamed("normalized_form", "query_form"), ASK).select(*ASK, *best)
    hits = lk.matching_lexemes(lexemes, lexeme_forms).select("owner_id", F.col("normalized_form").alias("query_form"), "lexeme_id")
    via = requests.join(hits, ASK).join(lexeme_status.where("has_reference_match"), ["owner_id", "lexeme_id"]).select(*ASK, *best)
    return own.unionByName(via).distinct()


def best_lemma(requests: DataFrame, external: DataFrame, resolutions: DataFrame, morphology: DataFrame) -> DataFrame:
    """WRD-10: external form, else dictionary lemma, else tagger lemma.

    ``resolutions``: owner_id, query_form, dictionary_lemma; ``morphology``: owner_id, query_form, best_lemma.
    """
    order = F.struct(
        F.when(F.col("match_type") == "exact", 0).otherwise(1).alias("e"), F.col("match_score").isNull().alias("z"),
        (-F.coalesce("match_score", F.lit(0.0))).alias("s"), "provider_display_name", "source_title", "matched_form", F.coalesce("reference_link", F.lit("")).alias("l"),
    )
    top = external.where(tx.strip(F.col("matched_form")) != "").groupBy(*ASK).agg(F.min_by("matched_form", order).alias("external_form"))
    return requests.join(top, ASK, "left").join(resolutions, ASK, "left").join(morphology, ASK, "left").select(
        *ASK, F.coalesce("external_form", "dictionary_lemma", "best_lemma").alias("best_lemma")
    )


def filter_by_mode(items: DataFrame, mode: str) -> DataFrame:
    """WRD-11: exact keeps the form as written, normalized compares normalized forms, fuzzy keeps all.

    Exact mode needs ``raw_query``, the word as the user typed it.
    """
    if mode == "fuzzy":
        return items
    hit = tx.normalize_token(F.coalesce("matched_form", F.lit("")))
    q = F.col("query_form")
    if mode == "exact":
        raw = F.col("raw_query")
        keep = (F.col("word_form") == raw) | F.coalesce(F.col("matched_form") == raw, F.lit(False)) | ((hit == q) & (F.col("item_form") != q))
        return items.where(keep)
    return items.where((F.col("item_form") == q) | (hit == q))


def top_per_category(items: DataFrame, limit: int) -> DataFrame:
    """WRD-11: first items of every category in display order."""
    order = Window.partitionBy(*ASK, "source_type").orderBy("source_title", F.coalesce("page_number", F.lit(0)), "word_form", "item_key")
    return items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def scored_forms(requests: DataFrame, forms: DataFrame) -> DataFrame:
    """WRD-12: known forms above the threshold for every word of three letters or more.

    ``forms``: owner_id, normalized_form.  Candidates come from shared pieces, so nothing
    above the threshold is missed and no full product is made.
    """
    left = requests.select("owner_id", F.col("query_form").alias("value")).where(F.length("value") > 2).distinct()
    right = forms.select("owner_id", F.col("normalized_form").alias("value")).where(F.col("value") != "").distinct()
    same = left.join(right, ["owner_id", "value"]).select("owner_id", F.col("value").alias("query_form"), F.col("value").alias("form"), F.lit(100.0).alias("score"))
    near = (
        similar_pairs(left, right, ["owner_id"], FUZZY_THRESHOLD)
        .withColumn("score", block_similarity("value_left", "value_right")).where(F.col("score") >= FUZZY_THRESHOLD)
        .select("owner_id", F.col("value_left").alias("query_form"), F.col("value_right").alias("form"), "score")
    )
    return same.unionByName(near)


def _ranked_forms(scored: DataFrame, key: list[str]) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "form")
    return scored.withColumn("form_rank", F.row_number().over(order)).where(F.col("form_rank") <= FUZZY_FORM_LIMIT)


def fuzzy_forms(requests: DataFrame, forms: DataFrame) -> DataFrame:
    """WRD-12: the five most similar known forms of every word."""
    return _ranked_forms(scored_forms(requests, forms), ASK)


def known_forms(lexeme_values: DataFrame, book_forms: DataFrame, analyses: DataFrame, entries: DataFrame, entry_analyses: DataFrame) -> DataFrame:
    """WRD-12: the forms that fuzzy mode compares with: owner_id, source_type, normalized_form, distinct.

    Books and wordlists know their own forms and the lemmas of their finished tagger rows.
    ``book_forms`` is one row per form (the groups), not the fact table.
    """
    lemmas = lambda rows: rows.where("analysis_status = 'completed' and lemma_normalized is not null").select("owner_id", F.col("lemma_normalized").alias("normalized_form"))
    of = {
        "lexicon": lexeme_values.select("owner_id", "normalized_form"),
        "imported_book": book_forms.select("owner_id", "normalized_form").unionByName(lemmas(analyses)),
        "reference_source": entries.select("owner_id", "normalized_form").unionByName(lemmas(entry_analyses)),
    }
    parts = [rows.where("normalized_form <> ''").select("owner_id", F.lit(kind).alias("source_type"), "normalized_form") for kind, rows in of.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def fuzzy_category_forms(requests: DataFrame, known: DataFrame) -> DataFrame:
    """WRD-12: the five most similar forms of every word in each category; a pair is scored once for all categories."""
    scored = scored_forms(requests, known)
    in_category = known.withColumnRenamed("normalized_form", "form")
    return _ranked_forms(scored.join(in_category, ["owner_id", "form"]), [*ASK, "source_type"])


def fuzzy_items(near: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """WRD-11/12: first items of every asked word and category over its similar forms.

    ``near``: owner_id, query_form (asked), source_type, form.  ``items``: evidence of the
    forms, with the form as query_form.  Items are cut to ``limit`` per form before they are
    dealt to the words that ask for the form.  An item found through several forms counts
    once, direct hits before lemma hits.
    """
    asked = near.select("owner_id", F.col("query_form").alias("asked"), "source_type", F.col("form").alias("query_form"))
    first = top_per_category(items, limit).drop("place")
    dealt = asked.join(first, [*ASK, "source_type"])
    fields = [n for n in ITEM if n not in ("source_type", "item_key")]
    order = F.struct((F.col("via") != "token").alias("l"), F.coalesce("matched_form", F.lit("")).alias("m"), "query_form")
    one = dealt.groupBy("owner_id", "asked", "source_type", "item_key").agg(F.min_by(F.struct("query_form", *fields), order).alias("i"))
    rows = one.select("owner_id", F.col("asked").alias("query_form"), F.col("i.query_form").alias("form"), "source_type", "item_key", *[F.col(f"i.{n}").alias(n) for n in fields])
    return top_per_category(rows, limit)


def external_by_mode(items: DataFrame, mode: str) -> DataFrame:
    """WRD-14: trusted external items under a search mode, in display order (``place``).

    An external item's own form is its matched form.  Exact mode needs ``raw_query``.
    """
    rows = items.withColumns({"word_form": F.col("matched_form"), "item_form": tx.normalize_token(F.coalesce("matched_form", F.lit("")))})
    order = Window.partitionBy(*ASK).orderBy(F.coalesce("provider_display_name", F.lit("")), "source_title", "word_form", F.coalesce("reference_link", F.lit("")))
    return filter_by_mode(rows, mode).withColumn("place", F.row_number().over(order)).drop("word_form", "item_form")


def check_sources(requests: DataFrame, cached: DataFrame, corpus: DataFrame, corpus_limit: int = 5) -> DataFrame:
    """WRD-15: the external sources behind a word check: cached items and the first corpus lemmas."""
    names = ["provider_display_name", "matched_form", "reference_link"]
    hits = requests.join(cached.withColumnRenamed("normalized_form", "query_form"), "query_form").select(
        *ASK, F.coalesce("provider_display_name", "provider_key", F.lit("External")).alias(names[0]), *names[1:]
    )
    return hits.unionByName(corpus_items(requests, corpus, corpus_limit).select(*ASK, *names))


def quick_check(
    requests: DataFrame, lexeme_evidence: DataFrame, book_forms: DataFrame, book_lemmas: DataFrame, entry_forms: DataFrame, entry_lemmas: DataFrame,
    external: DataFrame,
) -> DataFrame:
    """WRD-13/15: lexicon hits and where the word was found.

    The form tables hold owner_id and normalized_form; ``external`` the external items.
    """
    def flag(name: str, *tables: DataFrame) -> DataFrame:
        rows = tables[0].select("owner_id", F.col("normalized_form").alias("query_form"))
        for t in tables[1:]:
            rows = rows.unionByName(t.select("owner_id", F.col("normalized_form").alias("query_form")))
        return rows.join(requests, ASK, "left_semi").distinct().withColumn(name, F.lit(True))

    no, zero = F.lit(False), F.lit(0).cast("bigint")
    hits = external.groupBy(*ASK).agg(F.count("*").alias("external_match_count"))
    lex = lexeme_evidence.withColumnRenamed("normalized_form", "query_form")
    return (
        requests.join(lex, ASK, "left").join(flag("in_books", book_forms, book_lemmas), ASK, "left")
        .join(flag("in_entries", entry_forms, entry_lemmas), ASK, "left").join(hits, ASK, "left")
        .select(
            *ASK, (F.coalesce("matching_lexeme_count", zero) > 0).alias("exists_in_lexicon"), F.coalesce("matching_lexeme_count", zero).alias("matching_lexeme_count"),
            F.coalesce("in_books", no).alias("found_in_imported_books"), F.coalesce("in_entries", no).alias("found_in_reference_sources"),
            (F.coalesce("external_match_count", zero) > 0).alias("found_in_trusted_external"), F.coalesce("external_match_count", zero).alias("external_match_count"),
        )
    )


