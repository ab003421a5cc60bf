"""Operators on rows with nulls, blanks, long texts, copies, repeated rows and clashing columns."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers as tokenizers
from llm_rows import BODY, LINE, rows

from check_queries import TABLES, rows_of
from lexloom import session
from lexloom.llm import decontaminate, golay, licences, line_spread, pareto_mix, queries, repeats, repetition, splitters, token_files, token_rollups

FOLDER = "/root/testdata/sf0.001"
ROWS = [(r[0], r[1]) for r in rows()]
WORD = r"[^\x20\x09-\x0D]+"


def bag(frame):
    return collections.Counter(tuple(r) for r in frame.collect())


def test_token_files(spark, docs, none):
    path = tokenizers.path("byte_bpe_50k.json")
    manifest = token_files.write_tokens(docs, session.shared_dir(spark), path)
    got = sorted(token_files.read_documents(manifest).collect(), key=lambda r: r.start)
    made, at, want = token_files.encoder(path), 0, collections.Counter()
    for i, t in ROWS:
        ids = np.append(made.tokenizer.encode(t or "", add_special_tokens=False).ids, 0).astype("<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _ in ROWS if i is not None)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert token_files.read_documents(token_files.write_tokens(none, session.shared_dir(spark), path)).count() == 0


def test_line_spread(spark, docs, none):
    sites = collections.defaultdict(set)
    for r in rows():
        for line in (r[1] or "").split("\n"):
            sites[line.strip(" \t\r\x0b\x0c")].add(r[3])
    for least in (1, 2, 3):
        want = collections.Counter()
        for i, t in ROWS:
            kept = [x for x in (t or "").split("\n") if not x.strip(" \t\r\x0b\x0c") or len(sites[x.strip(" \t\r\x0b\x0c")]) < least]
            want[i, 0 if t is None else t.count("\n") + 1, 0 if t is None else t.count("\n") + 1 - len(kept), None if t is None else "\n".join(kept)] += 1
        assert bag(line_spread.without_boilerplate(docs, least)) == want
    assert line_spread.without_boilerplate(none).count() == 0


def test_sketches_decide_far_from_the_threshold(spark):
    pages = spark.range(6000).selectExpr("id AS doc_id", "concat('site', id) AS source", f"CASE WHEN id < 300 THEN '{LINE}' WHEN id < 340 THEN 'rare' ELSE concat('own ', id) END AS text")
    assert bag(line_spread.boilerplate(line_spread.lines(pages), 40)) == bag(line_spread.lines(pages).where("h1 IN (xxhash64('rare'), xxhash64('%s'))" % LINE).select("h1", "h2").distinct())


def test_token_rollups(spark, docs, none, tmp_path):
    store = token_rollups.Rollups(spark, str(tmp_path / "r"))
    versions = {"multi@1": tokenizers.path("byte_bpe_multi_50k.tiktoken"), "bytes@1": tokenizers.path("byte_bpe_50k.json")}
    counted = token_rollups.count_tokens(docs, versions, tokenizers.PATTERN)
    state = {}
    for r in counted.collect():
        key = (r.doc_key, r.tokenizer)
        state[key] = max(state.get(key, (-1,)), (r.n_tokens, r.source, r.lang), key=lambda x: x[0])

    def totals():
        out = collections.defaultdict(lambda: [0, 0])
        for (_, tok), (n, source, lang) in state.items():
            out[source, lang, tok][0] += 1
            out[source, lang, tok][1] += n
        return {(k[0], k[1], k[2], *v) for k, v in out.items()}

    def strip(frame):  # equal ids: ties by count leave source and language open, so they are compared as one
        return {tuple(r) for r in frame.collect()}

    once = counted.where("doc_key <> '8' AND doc_key <> '1'")
    for k in [k for k in state if k[0] in ("8", "1")]:
        del state[k]
    schema = "op string, doc_key string, tokenizer string, source string, lang string, n_tokens long, seq int"
    assert store.apply(1, once.selectExpr("'insert' AS op", "doc_key", "tokenizer", "source", "lang", "n_tokens", "0 AS seq"))
    assert strip(store.totals()) == totals()
    changes = spark.createDataFrame([
        ("delete", "5", "multi@1", None, None, None, 1), ("revise", "6", "multi@1", "moved", "xx", 7, 1), ("revise", "6", "multi@1", "moved", "xx", 9, 2),
        ("insert", "99", "new@2", None, None, 3, 1), ("delete", "404", "multi@1", None, None, None, 1), ("insert", "98", "new@2", "s", "l", 3, 1), ("delete", "98", "new@2", None, None, None, 2),
    ], schema)
    assert store.apply(2, changes)
    del state["5", "multi@1"]
    state["6", "multi@1"], state["99", "new@2"] = (9, "moved", "xx"), (3, None, None)
    assert strip(store.totals()) == totals()
    assert not store.apply(2, changes) and not store.apply(1, changes) and strip(store.totals()) == totals()
    # a batch that failed before its commit leaves rows that don't count, and is written anew
    store._write(changes.selectExpr("'x' AS source", "'x' AS lang", "'x' AS tokenizer", "5L AS n_docs", "5L AS n_tokens"), "deltas", 3)
    assert strip(store.totals()) == totals()
    assert store.apply(3, spark.createDataFrame([], schema)) and strip(store.totals()) == totals()
    with pytest.raises(ValueError):
        store.apply(0, changes)
    assert token_rollups.count_tokens(none, versions, tokenizers.PATTERN).count() == 0


def water(sizes, weights, cap):
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(cap * sizes[i] for i in capped)
        share = sum(w for i, w in enumerate(weights) if i not in capped)
        out = [cap * s if i in capped else rest * w / share for i, (s, w) in enumerate(zip(sizes, weights))]
        more = {i for i, s in enumerate(sizes) if out[i] > cap * s + 1e-9} - capped
        if not more:
            return out
        capped |= more


def check_mix(got, docs_rows):
    """got: (doc_id, source, size, source_size, target, copies)"""
    sizes = collections.Counter()
    for _, source, n in docs_rows:
        sizes[source] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, water([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)))
    assert collections.Counter((r[0], r[1], r[2]) for r in got) == collections.Counter(docs_rows)
    taken, largest = collections.Counter(), collections.Counter()
    for _, source, n, source_size, target, copies in got:
        assert source_size == sizes[source] and abs(target - want[source]) < 1e-6 and 0 <= copies <= 3
        taken[source] += n * copies
        largest[source] = max(largest[source], n)
    for s in names:
        assert abs(taken[s] - want[s]) <= max(1, largest[s] / 2 + 1), (s, taken[s], want[s])


def test_mix(docs, none):
    got = [tuple(r) for r in pareto_mix.one_by_one(pareto_mix.sample(docs)).select("id", "source", "size", "source_size", "target", "copies").collect()]
    check_mix(got, [(r[0], r[3], len(re.findall(WORD, r[1] or ""))) for r in rows()])
    again = pareto_mix.one_by_one(pareto_mix.sample(docs.repartition(7))).select("id", "source", "size", "source_size", "target", "copies")
    assert bag(again) == collections.Counter(got)
    mixed = pareto_mix.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r[5] for r in got if r[2])
    assert pareto_mix.sample(none).count() == 0 and pareto_mix.mixed(none).count() == 0


def test_mix_splits_equal_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "x")] * 5000 + [(2, "d e", "y")] * 100, "doc_id long, text string, source string")
    got = [tuple(r) for r in pareto_mix.one_by_one(pareto_mix.sample(docs)).select("id", "source", "size", "source_size", "target", "copies").collect()]
    check_mix(got, [(1, "x", 3)] * 5000 + [(2, "y", 2)] * 100)
    assert pareto_mix.mixed(docs).count() == sum(r[5] for r in got)


def test_larger_copies_are_likelier(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', IF(id % 2 = 0, 4, 256)) AS text", "'s' AS source")
    got = pareto_mix.sample(docs, pareto_mix.Mix(share=0.5)).toPandas()
    share = got.assign(copies=got.whole + got.extra).groupby("size").copies.mean()
    # expected copies go by size ** 0.25, so 64 times the size is 2.83 times as likely
    assert 2.2 < share[256] / share[4] < 3.6 and abs((got["size"] * (got.whole + got.extra)).sum() - 260 * 2000 / 2) < 140


def test_repetition(docs, none):
    got = {(r.doc_id, r.n_words, r.n_repeat_words): (r.base_failed, r.kept) for r in repetition.repetition(docs).collect()}
    assert got[1, 0, 0] == (True, False) and got[5, 360, 0] == (False, True) and got[11, 42, 42] == (True, False)
    kept = repetition.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == repetition.repetition(docs).where("kept").count()
    assert repetition.repetition(none).count() == 0 and repetition.keep_good(none).count() == 0


def removed(docs):
    """Brute force of the removal: (id, bytes, removed, spans, hash)."""
    last = 1 << 63
    firsts = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            firsts[b[p:p + 50]] = min(firsts.get(b[p:p + 50], last), last - 1 if i is None else i)
    out = collections.Counter()
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if firsts[b[p:p + 50]] < (last - 1 if i is None else i):
                gone[p:p + 50] = b"\1" * 50
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    return out


def test_repeats(spark, docs, none):
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in repeats.without_repeats(docs).collect())
    assert got == removed(ROWS)
    assert sum(c for k, c in got.items() if k[2]) >= 4
    assert repeats.without_repeats(none).count() == 0
    runs = "a" * 300
    odd = [(1, runs), (2, "b" + runs + "b"), (3, BODY[:49]), (4, BODY[:50]), (5, BODY[1:51] + "!" + BODY[:50]), (None, BODY[:60]), (None, BODY[:60]), (1, BODY[:70]), (7, BODY * 3)]
    frame = spark.createDataFrame(odd, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in repeats.without_repeats(frame).collect())
    assert got == removed(odd)


def test_licences(spark, docs, none):
    mit = next(t for n, t in licences.KNOWN if n == "MIT")
    frame = spark.createDataFrame([
        (1, "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.replace("noninfringement", "non-infringement").upper()),
        (2, mit + " and more"), (3, None), (4, "words\n  licenced under the MIT licence!\n" + "Licensed under CC BY-NC 4.0"), (5, "..."), (5, "..."),
    ], "doc_id long, text string")
    got = bag(licences.scan(frame, licences.catalogue(spark)).select("doc_id", "licence", "notices", "n_notices"))
    assert got == {(1, "MIT", "MIT", 1): 1, (2, None, "", 0): 1, (3, None, "", 0): 1, (4, None, "CC-BY-NC-4.0,MIT", 2): 1, (5, None, "", 0): 2}
    assert licences.scan(docs, licences.catalogue(spark)).count() == len(ROWS) and licences.scan(none, licences.catalogue(spark)).count() == 0


def test_decontamination(spark, docs, none, monkeypatch):
    items = spark.createDataFrame([(1, BODY), (2, "one two three four five six seven " * 6), (3, None), (4, "short"), (4, "short")], "item_id long, text string")
    got = bag(decontaminate.contaminated(docs, items).select("doc_id", "item_id"))
    assert got == {(5, 1): 1, (6, 1): 1, (7, 1): 1, (15, 1): 1, (11, 2): 1, (8, 4): 4}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 7
    monkeypatch.setattr(decontaminate, "SLICE_ITEMS", 2)  # the same in slices
    assert bag(decontaminate.contaminated(docs, items).select("doc_id", "item_id")) == got and decontaminate.clean(docs, items).count() == kept.count()
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0


def classes(marks):
    """Smallest id reachable at three bits of every mark; the smallest ids of the classes."""
    todo, out, least = set(range(len(marks))), {}, []
    while todo:
        group, front = set(), [todo.pop()]
        while front:
            one = front.pop()
            group.add(one)
            near = {k for k in todo if (marks[k][1] ^ marks[one][1]).bit_count() <= 3}
            todo -= near
            front += near
        ids = [marks[k][0] for k in group if marks[k][0] is not None]
        least.append(min(ids, default=None))
        out |= {k: least[-1] for k in group}
    return out, least


def test_near_duplicates(docs, none):
    marks = [(i, golay.simhash((t or "").encode())) for i, t in ROWS]
    want, least = classes(marks)
    got = bag(golay.near_duplicates(docs))
    assert got == collections.Counter((i, f"{p:016x}", want[k]) for k, (i, p) in enumerate(marks))
    kept = golay.keep_one(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(least)
    assert golay.near_duplicates(none).count() == 0 and golay.keep_one(none).count() == 0


def test_many_close_prints_are_one_class(spark):
    prints = [sum(1 << b for b in range(40) if i >> (b % 11) & 1 and b < 11) | (i & 1) << 50 for i in range(2048)]
    frame = spark.createDataFrame([(p,) for p in prints], "print long")
    assert golay.print_classes(frame.distinct()).select("class").distinct().count() == 1


def test_shards(spark, docs, none):
    got = splitters.assign(docs, carry=("doc_id", "text")).select("row.*", "size", "shard", "slot").collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(ROWS)
    assert all(r["size"] == len((r.text or "").encode()) + 1 and 0 <= r.shard < 16 for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert splitters.assign(none).count() == 0
    hot = spark.range(3000).selectExpr("IF(id < 2000, 5L, id) AS doc_id", "IF(id < 2000, 'the same text', repeat('x', int(id % 50))) AS text")
    load = collections.Counter()
    for r in splitters.assign(hot, carry=("doc_id",)).collect():
        load[r.shard] += r["size"]
    assert len(load) == 16 and max(load.values()) < 1.05 * min(load.values())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert rows_of(queries.QUERIES[name](spark, FOLDER).toPandas()) == rows_of(con.execute(queries.ORACLES[name]).df())
