"""Steps that read the words once: nothing stored, and grouping by document shuffles nothing more."""

from pyspark.sql import functions as F

from lexloom.operators import discovery, lexicon
from lexloom.plans.inputs import Workbench

FOLDER = "/root/testdata/sf0.001"


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_groups_store_no_occurrences(spark):
    w = Workbench(spark, FOLDER)
    assert w.groups.count() and w.book_evidence.count() and w.slices.count()
    assert "occ" not in w.__dict__


def test_document_groups_are_not_shuffled(spark):
    w = Workbench(spark, FOLDER)
    for df in (lexicon.slice_counts(w.page_words), lexicon.document_slices(w.streamed_occ), discovery.bucket_samples(w.streamed_occ)):
        assert _exchanges(df) == 1  # the texts dealt by document


def test_page_words_are_the_occurrences(spark):
    w = Workbench(spark, FOLDER)
    names = ["owner_id", "document_id", "page_id", "page_number", "normalized_token", "script_type", "has_digits", "has_latin", "has_armenian", "token_length"]
    short, whole = w.page_words.select(names), w.streamed_occ.select(names)
    assert short.exceptAll(whole).isEmpty() and whole.exceptAll(short).isEmpty()


def test_slices_hold_the_numbers(spark):
    w = Workbench(spark, FOLDER)
    names = w.slice_numbers.columns
    assert w.slices.select(names).exceptAll(w.slice_numbers).isEmpty() and w.slices.count() == w.slice_numbers.count()


def test_reading_place_keeps_the_order(spark):
    rows = spark.createDataFrame([(p, c) for p in (None, 0, 1, 2, 2**31 - 1) for c in (None, 0, 7, 2**31 - 1)], "page_number int, char_start int")
    by_place = rows.orderBy(lexicon.reading_place()).collect()
    assert by_place == rows.orderBy(F.asc_nulls_first("page_number"), F.asc_nulls_first("char_start")).collect()


def test_highlights_read_no_page_for_each_word(spark):
    from lexloom.plans.index_queries import snippet_highlights

    assert "Join" not in snippet_highlights(Workbench(spark, FOLDER))._jdf.queryExecution().optimizedPlan().toString()


def test_book_evidence_carries_no_snippet_of_losing_words(spark):
    """Only pages that hold a first place make snippets; equal titles are ordered by place, then document."""
    from lexloom.operators import linkage, occurrences

    docs = spark.createDataFrame([("b", "same"), ("a", "same"), ("c", "zzz")], "document_id string, title string")
    pages = spark.createDataFrame(
        [("o", "b", "b:1", 1, "one two"), ("o", "a", "a:1", 1, "two  one"), ("o", "c", "c:1", 1, "three one"), ("o", "c", "c:2", 2, "three four")],
        "owner_id string, document_id string, page_id string, page_number int, page_text string",
    )
    found = linkage.book_evidence(occurrences.occurrences(pages), docs, pages)
    rows = {r.normalized_form: (r.occurrence_count, r.best_document_id, r.best_page_number, r.best_context_snippet) for r in found.collect()}
    assert rows == {"one": (3, "b", 1, "one two"), "two": (2, "a", 1, "two one"), "three": (2, "c", 1, "three one"), "four": (1, "c", 2, "three four")}
    # Before, the first snippet was an aggregate that sorts every word with its text.
    aggregates = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert not any("context_snippet" in x for x in aggregates)


def test_resolutions_and_lemmas_store_no_row_per_word(spark):
    """Steps that need no places read distinct words; their numbers equal those of the stored tagger rows."""
    from lexloom.operators import morphology

    w = Workbench(spark, FOLDER)
    few = morphology.word_distribution(w.tagged_words)
    assert w.resolutions.count() and few.count() and "analyses" not in w.__dict__
    all_rows = morphology.word_distribution(w.analyses)
    assert few.exceptAll(all_rows.select(few.columns)).isEmpty() and few.count() == all_rows.count()
    assert w.tagged_words.count() < w.analyses.count()


def test_candidates_store_no_row_per_word(spark):
    """Lemmas and main providers per document and form come from its distinct words, as from every word."""
    w = Workbench(spark, FOLDER)
    short = discovery.morphology_buckets(w.tagged_document_words)
    assert w.candidates.count() and "analyses" not in w.__dict__
    for few, every in zip(short, discovery.morphology_buckets(w.analyses)):
        assert few.exceptAll(every).isEmpty() and few.count() == every.count()


def test_group_samples_store_no_slices(spark):
    """Samples of groups come straight from the words: no slice with its texts is written first."""
    from lexloom.plans import all_queries

    w = Workbench(spark, FOLDER)
    df = all_queries()["group_rollup_samples"].plan(w)
    assert "slices" not in w.__dict__ and all("/lexloom/" not in f for f in df.inputFiles())


def test_group_samples_of_unknown_documents(spark):
    """A slice without its document keeps tokens and contexts and has no title."""
    slices = spark.createDataFrame([("o", "a", "1", ["A", "a"], ["x"]), ("o", "a", "2", ["a"], ["y"])], "owner_id string, normalized_form string, document_id string, sample_tokens array<string>, sample_contexts array<string>")
    got = lexicon.group_samples(slices, spark.createDataFrame([("2", "t2")], "document_id string, title string")).collect()
    assert [tuple(r) for r in got] == [("o", "a", ["A", "a"], ["x", "y"], ["t2"])]


def test_incremental_index_shuffles_texts_only(spark):
    """Without broadcasts too, joins with the arriving pages leave the words where they lie."""
    from lexloom.plans import all_queries

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = all_queries()["incremental_index"].plan(Workbench(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_corpus_filled_cache_resolves_no_lemmas(spark):
    """The corpus is asked for the pending forms alone; lemmas are not resolved for it."""
    from lexloom.plans import all_queries

    w = Workbench(spark, FOLDER)
    all_queries()["corpus_filled_cache"].plan(w)
    assert "resolutions" not in w.__dict__ and "corpus_matches" not in w.__dict__


def test_slice_words_hold_every_spelling(spark):
    """Numbers as slice_counts has them; spellings with their numbers, null where the form is the only one."""
    from lexloom.operators import occurrences

    pages = spark.createDataFrame(
        [("o", "a", "a:1", 1, "One one TWO three"), ("o", "a", "a:2", 2, "one ONE Two"), (None, "b", "b:1", 1, "Four")],
        "owner_id string, document_id string, page_id string, page_number int, page_text string",
    )
    words = occurrences.page_words(pages)
    rows, numbers = lexicon.slice_words(words), lexicon.slice_counts(words)
    assert rows.select(numbers.columns).exceptAll(numbers).isEmpty() and rows.count() == numbers.count()
    found = {r.normalized_form: r.spellings and [tuple(x) for x in r.spellings] for r in rows.collect()}
    assert found == {"one": [("one", 2), ("ONE", 1), ("One", 1)], "two": [("TWO", 1), ("Two", 1)], "three": None, "four": [("Four", 1)]}


def test_tagged_words_come_from_stored_slices(spark):
    """The same distinct words with the same numbers, whether the texts or the stored slices are read."""
    w, stored = Workbench(spark, FOLDER), Workbench(spark, FOLDER)
    assert stored.document_words.count() == w.slice_numbers.count()
    for scope in ([], ["document_id"]):
        texts, slices = w.word_tokens(scope), stored.word_tokens(scope)
        slices = slices.select(texts.columns)
        assert texts.exceptAll(slices).isEmpty() and slices.exceptAll(texts).isEmpty()


def test_candidates_read_the_texts_once(spark):
    """Evidence is made per case from the stored slices; neither words nor tagger rows are made again for it."""
    w = Workbench(spark, FOLDER)
    assert w.any_candidates.count() == w.document_words.where("stages is not null").count()
    assert not {"tagged_document_words", "tagged_words", "occ", "candidates"} & set(w.__dict__)
    assert w.cases.select(*discovery.CASE_KEY).distinct().count() < w.document_words.count()


def test_build_totals_read_no_reviews(spark):
    """Reviews are unique by bucket, so a step that does not look at them needs no join with them."""
    from lexloom.plans import all_queries

    w = Workbench(spark, FOLDER)
    plan = all_queries()["build_summary"].plan(w)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2  # the buckets and their cases, no reviews


def test_candidates_without_an_owner(spark):
    """They meet no evidence, yet they stay with what their own counts say."""
    w = Workbench(spark, FOLDER)
    one = w.case_buckets.limit(1).withColumn("owner_id", F.lit(None).cast("string")).withColumn("stages", F.array(F.lit("classical"), F.lit("classical")))
    built = discovery.build_candidates(one, discovery.distinct_cases(one), w.case_resolutions, w.lexeme_map,
                                       w.spark.createDataFrame([], "owner_id string, normalized_form string, entry_id string, source_id string, surface_form string, display_name string, entry_rank int, source_profile string, entry_quality string"), w.tag_cases)
    rows = built.collect()
    assert len(rows) == 2 and all(r.evidence_count == 0 and not r.morphology_plausible and r.canonical_reason == discovery.NO_CANON for r in rows)


def test_slice_words_group_once(spark):
    """Collected spellings are grouped in one pass over sorted rows, not sorted and merged twice."""
    plan = lexicon.slice_words(Workbench(spark, FOLDER).page_words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ObjectHashAggregate") == 0 and plan.count("SortAggregate") == 1 and plan.count("Exchange ") == 1
