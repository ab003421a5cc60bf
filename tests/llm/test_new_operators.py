"""Quality model, conversation repair and phrases against brute force, held-out rows and SQL."""

import collections
import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from llm_rows import rows

from check_queries import TABLES, rows_of
from lexloom.llm import phrases, quality_model, queries, turn_repair

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]")


# --- conversations -------------------------------------------------------------------------------

def damage(table):
    """Rows of every conversation after the fixed damage, in order."""
    out = collections.defaultdict(list)
    for conv, turn, role, text in table:
        out[conv] += []
        role, text = " " if role is None else role, " " if text is None else text
        by = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if by == 0:
            continue
        text = "" if by == 1 else re.sub("[.!?]", "", text) if by == 2 else text
        out[conv] += [(turn, "user" if by == 4 else role, text)] * (2 if by == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def faults(kept):
    seen, out = set(), []
    for _, role, text in kept:
        bare = WORD.findall(text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(kept, found):
    """Least (cost, audit, repaired) by Dijkstra over (row, roles so far) with whole audits as ties."""
    import heapq

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, made = heapq.heappop(heap)
        if at == len(kept) and state in ("", "a"):
            return cost, audit, made
        if (at, state) in done:
            continue
        done.add((at, state))
        want = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[want]
        heapq.heappush(heap, (cost + 2, audit + "I", at, want, (*made, f"{name}:")))
        if at < len(kept):
            _, role, text = kept[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, made))
            if found[at] not in ("blank", "duplicate"):
                late = found[at] == "truncated"
                heapq.heappush(heap, (cost + 2 + late, audit + "R", at + 1, want, (*made, f"{name}:{text}")))
                if role[:1] == want or (role[:1] == "s" and state == ""):
                    heapq.heappush(heap, (cost + late, audit + "K", at + 1, role[:1], (*made, f"{role}:{text}")))


def repaired(table):
    out = []
    for conv, kept in damage(table).items():
        found = faults(kept)
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, made = cheapest(kept, found)
        n = collections.Counter(found)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, c string, at string, audit string, kind string"
ORDER = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def save_table(spark, table, path):
    spark.createDataFrame([(*r, *["clash"] * 4) for r in table], SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def got_of(spark, folder):
    return collections.Counter(tuple(r) for r in queries.op12_turn_repair(spark, folder).select(*ORDER).collect())


def test_repair_of_given_table(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_of(spark, FOLDER) == collections.Counter(repaired(table))


def test_repair_of_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User", "usher"], ["One.", "Two!", "no end", "", " \t\n", None, "x. ", "…", "é?", "\x85"]
    table = []
    for conv in [*range(400), None]:
        for _ in range(int(rng.integers(0, 11))):
            turn = None if rng.random() < 0.1 else int(rng.integers(-3, 9))
            table.append((conv, turn, roles[int(rng.choice(8, p=[0.4, 0.3, 0.1, 0.05, 0.05, 0.05, 0.03, 0.02]))], texts[rng.integers(10)]))
    table += [(1000, n, ("user", "assistant")[n % 2 ^ (n % 7 == 3)], "word " * (n % 50) + f"{n}.") for n in range(3000)]
    table += [(1001, 0, "user", "long " * 200_000 + "."), (1001, 1, "assistant", " " * 300_000)]
    assert got_of(spark, save_table(spark, table, tmp_path)) == collections.Counter(repaired(table))


def test_all_short_signatures():
    path, names = turn_repair.Path(), {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for text in sorted("".join(s) for n in range(6) for s in itertools.product("suaoUAd", repeat=n)):
        path.move(text)
        rows_ = [(None, names.get(x.lower(), "user"), f"{x}{k}") for k, x in enumerate(text[::-1])]
        want = cheapest(rows_, ["blank" if x == "d" else "truncated" if x.isupper() else "" for x in text[::-1]])
        assert path.best() == want[:2], text
    assert path.built < 7 ** 6 and len(path.automaton.steps) < 400


def test_repaired_rows(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    placed = turn_repair.ordered(turn_repair.damaged(spark.read.parquet(f"{FOLDER}/conversations.parquet")))
    got = collections.defaultdict(list)
    for r in turn_repair.repaired(placed, turn_repair.facts_of(placed)).orderBy("c", "seq").collect():
        assert r.seq == len(got[r.c])
        got[r.c].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(v).encode()).hexdigest() for c, v in got.items()} == {r[0]: r[-1] for r in repaired(table) if r[0] in got}


def test_no_conversations(spark, tmp_path):
    assert not got_of(spark, save_table(spark, [], tmp_path))


# --- phrases -------------------------------------------------------------------------------------

def best_phrases(table, threshold, top=2000):
    fold = {c: c + 32 for c in range(65, 91)}
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in table:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                f[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= threshold}
        inside = collections.Counter()
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], a)
        found = []
        for p, a in often.items():
            if len(p) > 1 and inside[p] < a:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        found.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return out


@pytest.mark.parametrize("tight", [False, True])
def test_phrases_against_brute_force(spark, docs, monkeypatch, tight):
    if tight:  # summaries that have to shrink and to be handed on early
        monkeypatch.setattr(phrases, "GATHERED", 1000)
        monkeypatch.setattr(phrases, "HELD", 200)
        monkeypatch.setattr(phrases, "COUNTED", 50)
    rng = np.random.default_rng(8)
    vocabulary = ["New", "york", "city", "…", "ÉTÉ", "été", "a-b", "x", "the", "of"] + [f"w{k}" for k in range(300)]
    table = [(r[1], r[2]) for r in rows()]
    for k in range(300):
        words = [vocabulary[i] for i in np.minimum(rng.zipf(1.3, 80), len(vocabulary)) - 1]
        table.append(("".join(w + (" ", "\t", "  ", ", ", "\n", ". ", " ")[rng.integers(7)] for w in words) + (" new york city hall of the" * (k % 4)), [None, "und", "en", "fr"][k % 4]))
    frame = spark.createDataFrame([(*r, "clash") for r in table], "text string, lang string, phrase string").repartition(5)
    for threshold, bits in ((7, 27), (20, 12)):
        got = phrases.collocations(frame, threshold, top=300, bits=bits)
        want = best_phrases(table, threshold, 300)
        assert len(want) > 50
        assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert phrases.collocations(frame.limit(0)).count() == 0


def test_summaries_keep_what_is_frequent():
    rng, slots = np.random.default_rng(1), 4
    keys = np.concatenate([rng.integers(0, 2**63, 20000).astype(np.uint64) * np.uint64(2), np.repeat(rng.integers(0, 2**63, 40).astype(np.uint64), rng.integers(30, 400, 40))])
    rng.shuffle(keys)
    mass = np.bincount(phrases.slot_of(keys, slots), minlength=slots)
    capacity, whole = mass // 30 + 1, phrases.Summary(slots, mass // 30 + 1)
    for part in np.array_split(keys, 37):
        one = phrases.Summary(slots, capacity)
        for small in np.array_split(part, 3):
            one.add(small, np.ones(len(small), np.int64))
        whole.lost += one.lost
        whole.add(one.keys, one.counts)
        assert (np.bincount(phrases.slot_of(whole.keys, slots), minlength=slots) <= capacity).all()
    u, n = np.unique(keys, return_counts=True)
    assert whole.lost.max() > 0 and (whole.lost < 30).all()
    held = dict(zip(whole.keys.tolist(), whole.counts.tolist()))
    for k, c in zip(u.tolist(), n.tolist()):
        lost = int(whole.lost[phrases.slot_of(np.array([k], np.uint64), slots)[0]])
        assert held.get(k, 0) <= c <= held.get(k, 0) + lost


def test_phrases_against_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = rows_of(con.execute(phrases.SQL).df())
    assert len(want[1]) > 20
    assert rows_of(queries.op13_collocations(spark, FOLDER).toPandas()) == want


# --- quality model -------------------------------------------------------------------------------

def test_held_out_quality(spark):
    got = {r.doc_id: r for r in queries.op11_nb_svm(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert len(got) == docs.count()
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = [(got[i].score, q, got[i].predicted) for i, q in known.items() if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    good, poor = ([s for s, q, _ in held if q == label] for label in (1, 0))
    assert len(poor) > 10
    area = np.mean([(g > p) + (g == p) / 2 for g in good for p in poor])
    accuracy = np.mean([q == p for _, q, p in held])
    assert area > 0.97 and accuracy > 0.95, (area, accuracy)


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", quality_model.F.when(quality_model.held_out(quality_model.F.col("doc_id")), 1 - labels["quality"]).otherwise(labels["quality"]).cast("int"))
    one, other = (sorted(map(tuple, quality_model.classify(docs, x).collect())) for x in (labels, turned))
    assert one == other


def test_odd_texts_and_labels(spark, docs, none):
    schema = "doc_id long, quality int, toxic int, label int, t string"
    some = [(i, int(i % 2), 0, 1, "c") for i in range(2, 17)] + [(None, 1, 0, 0, ""), (5, None, 0, 0, ""), (6, 1, 0, 0, ""), (6, 0, 0, 0, ""), (7, 3, 0, 0, "")]
    for chosen in (some, [r for r in some if r[1] == 1], []):
        got = quality_model.classify(docs, spark.createDataFrame(chosen, schema)).collect()
        assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows())
        assert all(0 <= r.score <= 1 for r in got)
        same = collections.defaultdict(set)
        texts = {(r[0], r[1]) for r in rows()}
        for r in got:
            same[r.doc_id].add(r.score)
        assert len(same[8]) <= len({t for i, t in texts if i == 8})
    assert {r.score for r in got} == {0.5}
    assert quality_model.classify(none, spark.createDataFrame([], schema)).count() == 0


def test_features_against_plain_sets():
    texts = [b"", b"a", b"ab ab ab", "Été!! ÉTÉ!! x".encode(), b" \n ", b"Word word, WORD; w1"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = list(quality_model.features(data, offsets))
    for t, got in zip(texts, together):
        alone = next(quality_model.features(np.frombuffer(t, np.uint8), np.array([0, len(t)])))
        assert got.tolist() == alone.tolist()
    assert len(together[0]) == 0 and len(together[1]) == 2
    assert len(together[2]) == 12 + 5


def test_descent_against_primal():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    y = np.where(x @ [1, -2, 0.5, 0, 0] + 0.3 + rng.normal(scale=0.5, size=60) > 0, 1.0, -1.0)
    cost = np.full(60, 0.7)
    w, b = quality_model.descend([np.arange(5)] * 60, list(x), y, cost, 5, rounds=3000)
    z = np.column_stack([x, np.ones(60)])
    v = np.append(w, b)
    slope = v - 2 * (z * (cost * y * np.maximum(0, 1 - y * (z @ v)))[:, None]).sum(axis=0)
    assert np.abs(slope).max() < 0.02


def test_handed_on_summaries_are_small():
    """Counters of a task compress to far less than the 16 bytes they have in memory, and come back."""
    rng = np.random.default_rng(5)
    keys, counts = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64) << np.uint64(1), rng.integers(1, 4, 200_000)
    held = phrases.Summary(64, None)
    held.add(keys, counts)
    out = held.out()
    packed = [v for c in ("keys", "counts") for v in out.column(c).to_pylist()]
    assert sum(len(pa.compress(v, "lz4_raw", asbytes=True)) for v in packed) < 6.5 * len(held.keys)
    short = np.concatenate([phrases.from_planes(v, phrases.KEY_BITS // 8) for v in out.column("keys").to_pylist()])
    assert (short == held.keys >> np.uint64(64 - phrases.KEY_BITS)).all()
    assert (np.concatenate([phrases.from_planes(v, 8) for v in out.column("counts").to_pylist()]) == held.counts.astype(np.uint64)).all()
