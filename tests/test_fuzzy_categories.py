"""Fuzzy word search over lexicon, books and wordlists against plain loops over all pairs."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lexloom.operators import words as wd

KINDS = ("imported_book", "lexicon", "reference_source")


def near(word, known):
    scores = {f: SequenceMatcher(a=word, b=f).ratio() * 100 for f in known if f} if len(word) > 2 else {}
    return [f for f in sorted(scores, key=lambda f: (-scores[f], f)) if scores[f] >= 85][:5]


def words_of(rnd, n):
    base = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(2, 9))) for _ in range(n // 4)]
    out = set(base)
    for w in base:
        for _ in range(3):
            at = rnd.randrange(len(w))
            out.add(w[:at] + rnd.choice(["", "x", w[at] * 2]) + w[at + 1:])
    return sorted(out)


def test_forms_and_items_of_every_category(spark):
    rnd = random.Random(9)
    pool = words_of(rnd, 120)
    known = {(o, k): set(rnd.sample(pool, 40)) for o in "pq" for k in KINDS}
    asked = [(o, w) for o in "pq" for w in rnd.sample(pool, 30)] + [("p", "ab"), ("p", "zzzzz")]
    requests = spark.createDataFrame(asked, "owner_id string, query_form string").distinct()
    table = spark.createDataFrame([(o, k, f) for (o, k), fs in known.items() for f in fs], "owner_id string, source_type string, normalized_form string")
    found = wd.fuzzy_category_forms(requests, table)
    got = {(r.owner_id, r.query_form, r.source_type, r.form_rank): r.form for r in found.collect()}
    want = {(o, w, k, i): f for o, w in set(asked) for k in KINDS for i, f in enumerate(near(w, known[o, k]), 1)}
    assert got == want and len(got) > 100

    # One to four places a form; some places stand under two forms, once as a lemma hit.
    items, places = [], {}
    for (o, k), fs in known.items():
        for f in sorted(fs):
            for n in range(rnd.randint(1, 4)):
                items.append((o, f, k, f"s{n}", f"T{rnd.randint(0, 2)}", f, f, None, n, f"{f}@{n}", None, "token"))
        for f in sorted(fs)[::3]:
            other = sorted(fs)[0]
            items.append((o, f, k, "s0", "T0", other, other, f, 0, f"{other}@0", None, "lemma"))
    names = "owner_id, query_form, " + ", ".join(wd.ITEM)
    schema = ", ".join(f"{n.strip()} {'int' if n.strip() == 'page_number' else 'string'}" for n in names.split(","))
    rows = wd.fuzzy_items(found, spark.createDataFrame(items, schema), 3)
    got = {(r.owner_id, r.query_form, r.source_type, r.place): (r.item_key, r.via) for r in rows.collect()}
    want = {}
    for o, w in set(asked):
        for k in KINDS:
            best = {}
            for it in items:
                if it[0] == o and it[2] == k and it[1] in near(w, known[o, k]):
                    rank = (it[11] != "token", it[7] or "", it[1])
                    if it[9] not in best or rank < best[it[9]][0]:
                        best[it[9]] = (rank, (it[4], it[8] or 0, it[5], it[9]), it)
            for i, (_, _, it) in enumerate(sorted(best.values(), key=lambda b: b[1])[:3], 1):
                want[o, w, k, i] = (it[9], it[11])
    assert got == want


def test_known_forms_hold_lemmas(spark):
    def forms(*values):
        return spark.createDataFrame([("o", v) for v in values], "owner_id string, normalized_form string")

    done = spark.createDataFrame([("o", "completed", "lemma"), ("o", "failed", "no"), ("o", "completed", None)], "owner_id string, analysis_status string, lemma_normalized string")
    out = wd.known_forms(forms("lex"), forms("book", ""), done, forms("list"), done)
    assert {(r.source_type, r.normalized_form) for r in out.collect()} == {
        ("lexicon", "lex"), ("imported_book", "book"), ("imported_book", "lemma"), ("reference_source", "list"), ("reference_source", "lemma")
    }


def test_external_items_by_mode(spark):
    rows = [("o", "ab", "Ab", 1), ("o", "ab", "ab", 2), ("o", "ab", "abx", 3)]
    items = spark.createDataFrame(rows, "owner_id string, query_form string, matched_form string, n int").select(
        "*", F.lit("p").alias("provider_display_name"), F.lit("t").alias("source_title"), F.lit(None).cast("string").alias("reference_link"), F.lit("ab").alias("raw_query")
    )
    got = {m: [r.n for r in wd.external_by_mode(items, m).orderBy("place").collect()] for m in ("exact", "normalized", "fuzzy")}
    assert got == {"exact": [2], "normalized": [1, 2], "fuzzy": [1, 2, 3]}
