"""The near-dedup stage and its similarity join against brute-force Jaccard."""

import collections

import corpus_pipeline
import numpy as np
from lexloom.llm import golay, shingle_join
from llm_rows import rows
from pyspark.sql import functions as F

DATA = "/root/testdata"


def leads(marks, words=5, similarity=0.8):
    """Smallest id of every class of (id, text) linked by Jaccard similarity, and the linked pairs of unequal sets."""
    held = []
    for _, text in marks:
        w = (text or "").encode().lower().split()
        held.append(frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    root, near = list(range(len(held))), set()

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(held)):
        for b in range(a):
            x, y = held[a], held[b]
            common = len(x & y)
            if x == y or common >= similarity * (len(x) + len(y) - common):
                root[find(a)] = find(b)
                near |= {(a, b)} if x != y else set()
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(marks):
        ids[find(k)].append(i)
    return collections.Counter(min((i for i in g if i is not None), default=None) for g in ids.values()), near


def test_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    want, near = leads([(r.doc_id, r.text) for r in docs.collect()])
    assert len(near) > 5
    got = collections.Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, f"{DATA}/sf0.01").collect())
    assert got == want


def test_odd_rows(docs, none):
    kept = golay.keep_one(docs, words=5, similarity=0.8)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == leads([r[:2] for r in rows()])[0]
    assert golay.keep_one(none, words=5, similarity=0.8).count() == 0


def test_frequent_shingles_and_pairs_at_the_bound(spark, monkeypatch):
    rng, line = np.random.default_rng(3), " ".join(f"site{i}" for i in range(30))
    marks = []
    for n in range(60):
        body = [f"w{x}" for x in rng.integers(0, 500, 8 + n)]
        marks.append((len(marks), f"{' '.join(body)} {line}"))
        for cut in range(1, 5):
            changed = list(body)
            changed[cut] = "X"
            marks.append((len(marks), f"{' '.join(changed[:len(body) - cut])} {line.upper()}"))
    want, near = leads(marks)
    assert near
    frame = spark.createDataFrame(marks, "doc_id long, text string")
    for frequent in (6, 10**9):
        monkeypatch.setattr(shingle_join, "FREQUENT", frequent)
        assert collections.Counter(r.doc_id for r in golay.keep_one(frame, words=5, similarity=0.8).collect()) == want


def test_pairs_of_near_copies_and_of_more_rows(spark):
    """A group of g near copies gives about g pairs; texts that share a passage give no more than a few a text, however many they are."""
    rng = np.random.default_rng(6)
    body, line = [f"w{x}" for x in rng.integers(0, 10**6, 120)], " ".join(f"shared{i}" for i in range(20))
    copies = [" ".join([*body[:k % 120], f"new{k}", *body[k % 120 + 1:]]) for k in range(400)]

    def pairs(texts):
        frame = spark.createDataFrame([(t,) for t in texts], "text string")
        held = frame.select(F.struct(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2")).alias("row"), "text")
        marks = shingle_join.session.save(shingle_join.marks(held, "row", "text", 5), "marks")
        first = shingle_join.session.save(shingle_join.leader_pairs(held, "text", 5, 0.8), "first")
        known = shingle_join.session.save(shingle_join.components(shingle_join.verified(held, marks, first, "row", "text", 5, 0.8)), "known")
        return first.count(), shingle_join.candidates(held, known, "text", 5, 0.8, len(texts)).count()

    first, rest = pairs(copies)
    assert first < 4 * len(copies) and rest < len(copies)
    others = [" ".join([line, *[f"v{x}" for x in rng.integers(0, 10**6, 25)]]) for _ in range(1000)]
    for some in (others[:200], others):
        first, rest = pairs(some)
        assert first <= len(some) and rest <= len(some)
