"""Repetitive and reordered passages against every window; texts of very many removed lines."""

import random
from collections import Counter

from lexloom.llm import decontaminate, line_spread

SCHEMA = "doc_id long, text string, source string"


def shingles(words, n):
    return Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def best_window(text, item):
    """(first word, words, similarity) of the best item-sized window, the earliest of equals; None below 0.8."""
    words, wanted = text.split(), item.split()
    n, size = min(5, len(wanted)), min(len(wanted), len(words))
    if size < n or not wanted:
        return None
    b, best = shingles(wanted, n), None
    for first in range(len(words) - size + 1):
        a = shingles(words[first:first + size], n)
        got = sum((a & b).values()) / sum((a | b).values())
        if got >= 0.8 and (best is None or got > best[2]):
            best = (first, size, got)
    return best


def test_every_window(spark):
    rnd = random.Random(3)
    half = [" ".join(f"{c}{rnd.randint(0, 999)}" for _ in range(45)) for c in "ab"]
    items = ["x y " * 6 + "x", "z " * 30, " ".join(half), "p q r s t u v w " * 3, "one two", " ".join(f"n{i}" for i in range(40)) + " k" * 12, "u v " * 9]
    texts = [
        "y x " * 6 + "y", "a b " * 4 + "z " * 31 + "c", "z " * 400, f"{half[1]} {half[0]}", "lead in " + f"{half[1]} {half[0]} and out", "q r s t u v w p " * 3,
        "zero one two three", " ".join(f"n{i}" for i in range(40)) + " k" * 9 + " m n o", "v u " * 9 + "end", "x y " * 7, "", "k " * 70 + "n1",
    ]
    for _ in range(60):
        words = rnd.choice(items).split()
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = rnd.choice(["x", "y", "z", "k", "new"])
        texts.append(" ".join(["pre"] * rnd.randint(0, 4) + words + ["post"] * rnd.randint(0, 4)))
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.at_word, r.n_words, round(r.similarity, 9)) for r in decontaminate.contaminated(docs, bench).collect()}
    want = {(d, i): w for d, t in enumerate(texts) for i, x in enumerate(items) if (w := best_window(t, x))}
    assert got == {k: (a, n, round(s, 9)) for k, (a, n, s) in want.items()} and {(0, 0), (3, 2), (4, 2)} <= set(got)
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_many_removed_lines_in_one_text(spark):
    shared = [f"line {i}" for i in range(100_000)]
    texts = ["\n".join([f"own {d}", *shared, "", f"end {d}"]) for d in range(3)]
    docs = spark.createDataFrame([(d, t, f"s{d}") for d, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_spread.without_boilerplate(docs, 3).collect()}
    assert got == {d: (100_003, 100_000, f"own {d}\n\nend {d}") for d in range(3)}
