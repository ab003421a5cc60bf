"""Parts of the operators that need no cluster, against brute force."""

import base64
import collections
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers as tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow.fs import LocalFileSystem

from lexloom.llm import arrays as ar
from lexloom.llm import decontaminate, golay, repeats, repetition, token_files

TEXT = st.text(st.sampled_from("ab \n\t\x0b\x85 éß.#"), max_size=80)


def batch_of(texts):
    return pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=12))
def test_word_spans_and_hashes(texts):
    for _, data, offsets in ar.chunks([batch_of(texts)]):
        starts, ends, rows = ar.word_spans(data, offsets)
        raw = data.tobytes()
        got = [(r, raw[a:b].decode()) for a, b, r in zip(starts, ends, rows)]
        assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        hashes = ar.span_hashes(data, starts, ends, block=7)
        assert len(set(zip(hashes.tolist(), [w for _, w in got]))) == len({w for _, w in got})
        for n in (1, 2, 3, 5, 7):
            windows = ar.window_hashes(hashes, n)
            runs = [tuple(hashes[i:i + n].tolist()) for i in range(max(0, len(hashes) - n + 1))]
            assert len(windows) == len(runs) and len(set(zip(windows.tolist(), runs))) == len(set(runs)) == len(set(windows.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=8))
def test_repetition_counts(texts):
    for _, data, offsets in ar.chunks([batch_of(texts)]):
        got = repetition.measure(data, offsets, repetition.Rules())
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for n in (5, 7):
            grams = collections.Counter(tuple(words[k:k + n]) for k in range(len(words) - n + 1))
            seen, any_copy, later = set(), set(), set()
            for k in range(len(words) - n + 1):
                gram = tuple(words[k:k + n])
                if grams[gram] > 1:
                    any_copy |= set(range(k, k + n))
                    later |= set(range(k, k + n)) if gram in seen else set()
                seen.add(gram)
            if n == 5:
                assert got["n_repeat_words"][i] == len(any_copy)
            assert got[f"dup_chars_{n}"][i] == sum(len(words[k]) for k in later)
        lines, dups = set(), 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dups += line in lines
                lines.add(line)
        assert (got["n_words"][i], got["word_chars"][i], got["n_dup_lines"][i]) == (len(words), sum(map(len, words)), dups)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=1500), st.sampled_from([1, 300, 70000, 2**32]))
def test_blocks_round_trip(ids, most):
    ids = (np.array(ids, np.uint64) % most).astype(np.uint32)
    parts, index = token_files.encode_blocks(ids, 0)
    assert (token_files.decode_blocks(np.frombuffer(b"".join(parts), np.uint8), index) == ids).all()


def test_outliers_are_patched():
    ids = np.tile(np.arange(512, dtype=np.uint32) % 16, 3)
    ids[5] = 2**31
    parts, index = token_files.encode_blocks(ids, 0)
    assert index["width"].tolist() == [4, 4, 4] and index["patched"].tolist() == [1, 0, 0] and len(parts[0]) == 256 + 6


def test_file_reads_any_range(tmp_path):
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 50000, n, dtype=np.uint32) for n in rng.integers(0, 3000, 80)]
    writer = token_files.Writer(LocalFileSystem(), str(tmp_path / "f"), hold=1024)
    for i, t in enumerate(texts):
        writer.add(None if i == 3 else i, t)
    writer.close()
    reader, whole = token_files.Reader(LocalFileSystem(), str(tmp_path / "f")), np.concatenate(texts)
    for start, n in ((0, 0), (0, 1), (511, 2), (1000, 5000), (len(whole) - 3, 3)):
        assert (reader.ids(start, n) == whole[start:start + n]).all()
    assert reader.docs["known"].tolist() == [int(i != 3) for i in range(80)]
    with pytest.raises(ValueError):
        (tmp_path / "g").write_bytes(bytes(64))
        token_files.Reader(LocalFileSystem(), str(tmp_path / "g"))


def test_encoder_equals_library():
    made, rnd = token_files.encoder(tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    pool = [" ", "  ", "\n", "\t", "a", "B1", "'s", "'LL", "é", "ß", "\x85", "\xa0", "　", "\x1c", "Ж", "1½", "<|endoftext|>", "日", "\U0001f600", "é"]
    for _ in range(400):
        text = "".join(rnd.choice([*pool, chr(rnd.randint(1, 0x5FF))]) for _ in range(rnd.randint(0, 25)))
        assert made.encode(text).tolist() == made.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_golay_code():
    rng = np.random.default_rng(1)
    codes = np.unique(np.concatenate([np.uint32(0)[None], golay.decode(rng.integers(0, 1 << 23, 60000, dtype=np.uint32))]))
    assert len(codes) == 4096  # perfect: every word decodes, to one of 2^12
    words = rng.integers(0, 1 << 23, 2000, dtype=np.uint32)
    row, keys = golay.segment_keys(words)
    assert set(np.bincount(row).tolist()) == {1, 6}
    near = words ^ np.uint32(1 << 4) ^ np.uint32(1 << 19)
    row2, keys2 = golay.segment_keys(near)
    assert all(set(keys[row == i]) & set(keys2[row2 == i]) for i in range(300))


def test_prints_within_radius_share_a_key():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for bits in (0, 1, 2, 3):
        other = np.array([p ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, bits, replace=False).astype(np.uint64)) if bits else p for p in prints], np.uint64)
        rows, keys = golay.fingerprint_keys(prints)
        rows2, keys2 = golay.fingerprint_keys(other)
        mine = collections.defaultdict(set)
        for r, k in zip(rows.tolist(), keys.tolist()):
            mine[r].add(k)
        assert {r for r, k in zip(rows2.tolist(), keys2.tolist()) if k in mine[r]} == set(range(400))


def test_simhash_in_blocks(monkeypatch):
    import xxhash

    text = ("Some Words é and\x0bmore words to hash " * 9).encode()
    words = text.lower().split()
    ones = np.zeros(64, int)
    for i in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42)
        ones += [(h >> b) & 1 for b in range(64)]
    want = sum(1 << b for b in range(64) if 2 * ones[b] > len(words) - 2)
    whole = golay.word_blocks
    assert golay.simhash(text) == want
    monkeypatch.setattr(golay, "word_blocks", lambda t: whole(t, 20))
    assert golay.simhash(text) == want
    assert golay.simhash(b"") == 0 and golay.simhash(b" One ") == xxhash.xxh64_intdigest(b"one", 42) & (2**64 - 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab"), min_size=0, max_size=160), min_size=1, max_size=4))
def test_every_window_has_one_anchor(texts):
    for _, data, offsets in ar.chunks([batch_of(texts)]):
        raw, by_window = data.tobytes(), {}
        row, h, first, n = repeats.anchors(data, offsets, block=64)
        windows = [(int(r), int(a) + k, int(v)) for r, a, m, v in zip(row, first, n, h) for k in range(m)]
        assert sorted(w[1] for w in windows) == [p for i in range(len(texts)) for p in range(offsets[i], offsets[i + 1] - 49)]
        for r, p, v in windows:
            assert offsets[r] <= p and p + 50 <= offsets[r + 1]
            assert by_window.setdefault(raw[p:p + 50], v) == v  # equal strings, equal anchors


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab"), min_size=50, max_size=58), min_size=2, max_size=6, unique=True))
def test_maximal_repeats(stretches):
    stretches = [s.encode() for s in stretches]
    own, offset, lcp, left = repeats.suffix_array(stretches)
    got = {(stretches[own[a]][offset[a]:offset[a] + n], frozenset((int(own[k]), int(offset[k])) for k in range(a, b))) for n, a, b in repeats.maximal_repeats(lcp, left)}
    where = collections.defaultdict(set)
    for i, s in enumerate(stretches):
        for a in range(len(s)):
            for b in range(a + 50, len(s) + 1):
                where[s[a:b]].add((i, a))
    want = set()
    for s, at in where.items():
        before = {stretches[i][a - 1] if a else -1 - i for i, a in at}
        after = {stretches[i][a + len(s)] if a + len(s) < len(stretches[i]) else -1 - i for i, a in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            want.add((s, frozenset(at)))
    assert got == want


def words_of(text):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def shingles_of(words):
    return collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else collections.Counter([tuple(words)])


def test_windows_against_brute_force():
    rnd = random.Random(9)
    items = [" ".join(rnd.choice("red blue green stone river cloud tree light".split()) + str(rnd.randint(0, 30)) for _ in range(n)) for n in (3, 12, 30, 40, 60)]
    items += ["", None, items[2]]
    texts = [None, "", "nothing of it here"]
    for t in items[:5]:
        w = t.split()
        for edit in range(5):
            v = list(w)
            if edit == 1:
                v.insert(len(v) // 2, "inserted")
            if edit == 2:
                del v[len(v) // 3]
            if edit == 3:
                v[-1] = "changed"
            if edit == 4:
                v = v[: len(v) // 2]
            texts.append(" ".join(["before", "it", *(x.upper() + "," for x in v), "after"] * (1 + edit % 2)))
    index = decontaminate.build_index(list(range(len(items))), items, 24)
    found = {}
    for _, data, offsets in ar.chunks([batch_of(texts)]):
        found |= {(f[0], index.ids[f[1]]): f[5] for f in decontaminate.find(data, offsets, index, 0.8)}
    want = {}
    for r, text in enumerate(texts):
        words = words_of(text or "")
        for i, item in enumerate(items):
            own = words_of(item or "")
            size = min(len(own), len(words))
            for a in range(len(words) - size + 1 if own and words else 0):
                x, y = shingles_of(words[a:a + size]), shingles_of(own)
                same = sum((x & y).values()) / sum((x | y).values())
                if same >= 0.8:
                    want[r, i] = max(same, want.get((r, i), 0))
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    assert {i for _, i in want} == {0, 1, 2, 3, 4, 7}


def test_rank_file_counts():
    from lexloom.llm.token_rollups import _counter

    count = _counter(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    first = open(tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").readline().split()[0]
    assert count("") == 0 and count(base64.b64decode(first).decode("latin-1")) == 1
