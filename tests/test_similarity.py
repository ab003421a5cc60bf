import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lexloom.functions import similarity as sm
from lexloom.operators import linkage as lk, words as wd


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def variants(rng, words, alphabet):
    out = set(words)
    for w in words:
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randint(1, 4)):
                i = rng.randrange(len(v) + 1)
                if rng.random() < 0.5 and len(v) > 1:
                    v.pop(min(i, len(v) - 1))
                else:
                    v.insert(i, rng.choice(alphabet))
            out.add("".join(v))
    return sorted(out)


def sample(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("աբգդ") for _ in range(rng.choice([3, 4, 6, 9, 12, 17, 24, 33]))) for _ in range(25)]
    return variants(rng, words, "աբգդ")


def test_indel_ratio_is_lcs_based():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(2))
        assert abs(sm.indel_ratio(a, b) - 200.0 * lcs(a, b) / (len(a) + len(b))) < 1e-9
    assert sm.indel_ratio("dictionarry", "dictionary") > 90


def test_linkage_candidates_lose_nothing(spark):
    values = sample(2)
    frame = spark.createDataFrame([("o", v) for v in values], "owner_id string, value string")
    left = frame.where(F.length("value") > 2)
    got = {(r.value_left, r.value_right) for r in sm.similar_pairs(left, frame, ["owner_id"], 90.0, prefix=2, length_band=2).collect()}
    wanted = set()
    for a in values:
        head = 2 if len(a) >= 4 else 1
        for b in values:
            if len(a) > 2 and a != b and a[:head] == b[:head] and abs(len(a) - len(b)) <= 2 and sm.indel_ratio(a, b) >= 90:
                wanted.add((a, b))
    assert wanted and wanted <= got
    assert len(got) < len(values) ** 2 / 20


def test_fuzzy_forms_equal_brute_force(spark):
    values = sample(3)
    asked = values[::3]
    requests = spark.createDataFrame([("o", v) for v in asked], "owner_id string, query_form string")
    forms = spark.createDataFrame([("o", v) for v in values], "owner_id string, normalized_form string")
    got = {}
    for r in wd.fuzzy_forms(requests, forms).orderBy("form_rank").collect():
        got.setdefault(r.query_form, []).append(r.form)
    for q in asked:
        scored = [(SequenceMatcher(a=q, b=c).ratio() * 100, c) for c in values] if len(q) > 2 else []
        wanted = [c for s, c in sorted(((s, c) for s, c in scored if s >= 85), key=lambda x: (-x[0], x[1]))[:5]]
        assert got.get(q, []) == wanted


def test_fuzzy_match_rules(spark):
    sources = spark.createDataFrame(
        [("o", "s1", "list", True, "csv", None), ("o", "s2", "scan", True, "pdf_ocr", "warn"), ("o", "s3", "off", False, "csv", None)],
        "owner_id string, source_id string, display_name string, is_active boolean, last_import_method string, last_import_warning string",
    )
    entries = spark.createDataFrame(
        [("o", "s1", "e1", "dictionarry", "dictionarry"), ("o", "s2", "e2", "dictionarry", "dictionarry"), ("o", "s2", "e3", "exactly", "exactly"), ("o", "s3", "e4", "dictionarry", "dictionarry")],
        "owner_id string, source_id string, entry_id string, surface_form string, normalized_form string",
    )
    targets = spark.createDataFrame(
        [("o", "lexicon_group", v, v, v) for v in ("dictionary", "exactly")], "owner_id string, target_type string, target_key string, target_label string, value string"
    )
    cat = lk.catalog(entries, sources)
    got = {(r.target_key, r.entry_id, r.match_type, r.match_score) for r in lk.find_matches(targets, cat).collect()}
    assert got == {("dictionary", "e1", "fuzzy", 95.24), ("exactly", "e3", "exact", None), ("exactly", "e3", "normalized", None)}
    result = {r.target_key: (r.match_status, r.match_count, r.best_match_type) for r in lk.internal_to_reference(targets, cat).collect()}
    assert result == {"dictionary": ("matched", 1, "fuzzy"), "exactly": ("matched", 2, "exact")}
