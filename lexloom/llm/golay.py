"""SimHash near-duplicates found with Golay-code keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The perfect (23,12) Golay
code maps every 23-bit word to the one codeword within three bits of it. A segment's keys
are the codewords of the segment and of its 23 one-bit neighbours: one key, or six. Two
segments that differ in at most two bits share a key, because the word half way between
them decodes to a codeword that both list. (The 18 bits are padded with zeros.)

For two fingerprints that differ in at most three bits, pigeonhole leaves two cases:

* some segment is equal. In the cycle A>B>C>A the next segment then has at most two errors,
  or it has all three and the segment before the equal one is equal too. So one of the keys
  (equal segment, Golay key of the next) is shared.
* every segment has exactly one error. Then half of each segment is equal, and one of the
  eight keys (half of A, half of B, half of C) is shared.

Fingerprints that share a key meet in one task and are verified bit by bit. A group of
fingerprints under one key gives a spanning forest of its links, not all its pairs, which
keeps the same classes. Equal fingerprints are reduced to one before any key is made.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other;
null ids are never the smallest of a class unless it has no other (then the class is null);
repeated rows get the same class; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom import session
from lexloom.llm import arrays as ar
from lexloom.llm import shingle_join
from lexloom.llm.components import components

RADIUS = 3
SEGMENTS = ((0, 23), (23, 23), (46, 18))

#: Generator polynomial of the (23,12) Golay code, a fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder modulo the generator of every 23-bit word."""
    left = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        left = np.where(left >> bit & 1, left ^ np.uint32(GENERATOR << (bit - 11)), left)
    return left


def _error_table() -> np.ndarray:
    """The one error of weight 0 to 3 for each of the 2,048 remainders."""
    one = np.uint32(1) << np.arange(23, dtype=np.uint32)
    table = np.zeros(2048, np.uint32)
    pairs = one[:, None] | one
    for errors in ((pairs[:, :, None] | one).ravel(), pairs.ravel()):  # the lighter ones last; they stay
        table[_syndrome(errors)] = errors
    table[0] = 0
    return table


_ERRORS = _error_table()


def decode(words: np.ndarray) -> np.ndarray:
    """Index (upper 12 bits of the codeword) of the codeword nearest to each 23-bit word."""
    words = words.astype(np.uint32)
    return (words ^ _ERRORS[_syndrome(words)]) >> np.uint32(11)


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) of every key of every segment, each once."""
    flips = np.concatenate([[0], np.uint32(1) << np.arange(23, dtype=np.uint32)]).astype(np.uint32)
    keys = np.sort(decode((words.astype(np.uint32)[:, None] ^ flips).ravel()).reshape(len(words), 24), axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(new)[0], keys[new]


def fingerprint_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints; the top bits of a key name its kind."""
    parts = [(prints >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
    rows, keys = [], []
    for kind, (same, near) in enumerate(((0, 1), (1, 2), (2, 0))):
        row, code = segment_keys(parts[near])
        rows.append(row)
        keys.append(np.uint64(kind << 60) | parts[same][row] << np.uint64(12) | code.astype(np.uint64))
    halves = [(p & np.uint64((1 << n // 2) - 1), p >> np.uint64(n // 2)) for p, (_, n) in zip(parts, SEGMENTS)]
    for choice in range(8):
        a, b, c = (halves[i][choice >> i & 1] for i in range(3))
        rows.append(np.arange(len(prints)))
        keys.append(np.uint64((3 + choice) << 59 | 1 << 63) | a << np.uint64(24) | b << np.uint64(12) | c)
    return np.concatenate(rows), np.concatenate(keys)


_CUT = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(text: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text of any length, in lists of bounded size."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def simhash(text: bytes, words: int = 3) -> int:
    """Bit majority over the XXH64 values (seed 42) of all word shingles of the lower-cased text."""
    ones, total, rest = np.zeros(64, np.int64), 0, []

    def add(values: list[int]) -> None:
        nonlocal total
        for i in range(0, len(values), 1 << 14):
            part = np.array(values[i:i + (1 << 14)], "<u8")
            ones[:] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(part)

    seen = 0
    for block in word_blocks(text.lower()):
        block = rest + block
        seen += len(block) - len(rest)
        line = b" ".join(block)
        ends = np.cumsum(np.fromiter(map(len, block), np.int64, len(block)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        hashed = xxhash.xxh64_intdigest
        add([hashed(line[a:b], 42) for a, b in zip(starts[: len(starts) - words + 1].tolist(), ends[words - 1:].tolist())] if len(block) >= words else [])
        rest = block[max(0, len(block) - words + 1):]
    if not total and seen:
        add([xxhash.xxh64_intdigest(b" ".join(rest), 42)])
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """The key and ``print`` (the fingerprint as a signed long) of every row."""
    ar.small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([simhash((t or "").encode(), words) for t in batch.column("t").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(got.view(np.int64))], [key, "print"])

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"`{key}` {kind}, print long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
        rows, keys = fingerprint_keys(prints)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(prints[rows].view(np.int64))], ["key", "print"])


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the fingerprints of one key as all their links would."""
    links, left = [], np.unique(prints)
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            one = reached.pop()
            near = np.bitwise_count(left ^ one) <= RADIUS
            links += [(int(one), int(x)) for x in left[near]]
            reached += list(left[near])
            left = left[~near]
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the fingerprints under each key; rows come sorted by key, and a key may span batches."""
    held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(keys)))
        two = first[size == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= RADIUS] if len(two) else two
        links = [(int(a), int(b)) for a, b in zip(prints[two], prints[two + 1])] if len(two) else []
        for at, n in zip(first[size > 2], size[size > 2]):
            links += _forest(prints[at:at + n])
        pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([held_keys, batch.column("key").to_numpy(zero_copy_only=False)])
        prints = np.concatenate([held, batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)])
        cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last key may go on
        yield from out(keys[:cut], prints[:cut])
        held_keys, held = keys[cut:], prints[cut:]
    yield from out(held_keys, held)


def print_links(prints: DataFrame) -> DataFrame:
    """(a, b) of near fingerprints: a spanning forest under every key. ``prints`` holds distinct fingerprints."""
    keyed = prints.select("print").mapInArrow(_keys, "key long, print long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long").distinct()


def print_classes(prints: DataFrame) -> DataFrame:
    """(print, class) of every fingerprint that is linked to another; class is a fingerprint too.

    ``prints`` holds distinct fingerprints.
    """
    return components(print_links(prints)).select(F.col("node").alias("print"), F.col("root").alias("class"))


def set_prints(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """The key, ``print`` (hash of the set of shingles) and ``simhash`` (fingerprint of the same shingles) of every row."""
    ar.small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in ar.chunks(batches, "t"):
            sets = np.array([shingle_join.mark_of(s) for s in shingle_join.shingle_sets(data, offsets, words)], np.uint64)
            near = np.array([simhash(data[a:b].tobytes(), words) for a, b in zip(offsets[:-1], offsets[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(sets.view(np.int64)), pa.array(near.view(np.int64))], [key, "print", "simhash"])

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"`{key}` {kind}, print long, simhash long")


def set_pairs(marks: DataFrame) -> DataFrame:
    """(a, b) of sets to compare: each with the first of its fingerprint, and the firsts of near fingerprints."""
    sets = marks.select("print", "simhash").distinct()
    firsts = session.save(sets.groupBy("simhash").agg(F.min("print").alias("lead")), "firsts")
    same = sets.join(firsts, "simhash").select(F.col("lead").alias("a"), F.col("print").alias("b"))
    links = print_links(firsts.select(F.col("simhash").alias("print")))
    a, b = (firsts.select(F.col("simhash").alias(c), F.col("lead").alias(f"lead_{c}")) for c in "ab")
    near = links.join(a, "a").join(b, "b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    return same.unionByName(near).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _classes_of(marks: DataFrame, key: str) -> DataFrame:
    """(print, component_id) of every distinct fingerprint of ``marks``."""
    firsts = marks.groupBy("print").agg(F.min(key).alias("first"))
    linked = firsts.join(print_classes(firsts), "print", "left").withColumn("class", F.coalesce("class", "print"))
    smallest = linked.groupBy("class").agg(F.min("first").alias("component_id"))
    return linked.join(smallest, "class").select("print", "class", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id (smallest key of the class) of every row."""
    marks = session.save(fingerprints(docs, key, text, words), "simhash")
    return marks.join(_classes_of(marks, key), "print").select(
        F.col(key), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of each class, with all its columns: the row of the smallest key, null last.

    Classes are those of near fingerprints or, where ``similarity`` is given, of word shingles
    with that Jaccard similarity. There the links that Golay keys find (three bits of 64) are verified
    on the whole sets, and an exact join finds what lies further apart (see ``shingle_join``).
    Where rows of a class share that key the smallest hash of key and text decides; of rows
    equal in both, one stays.
    """
    k1, k2 = fresh(docs, "k1"), fresh(docs, "k2")
    keyed = docs.withColumns({k1: F.xxhash64(key, text), k2: F.xxhash64(F.lit(7), F.col(key), F.col(text))})
    slim = keyed.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(k1).alias("k1"), F.col(k2).alias("k2")).alias("row"), F.col(text).alias("text"))
    made = fingerprints(slim, "row", "text", words) if similarity is None else set_prints(slim, "row", "text", words)
    marks = session.save(made.select("row", "row.id", *made.columns[1:]), "simhash")
    found = _classes_of(marks, "id").select("print", "class") if similarity is None else shingle_join.classes(slim, marks, "row", "text", words, similarity, set_pairs(marks))
    held = marks.join(found, "print")
    leads = held.groupBy("class").agg(F.min("row").alias("lead"))
    judged = held.join(leads, "class").select(F.col("row.k1").alias(k1), F.col("row.k2").alias(k2), (F.col("row") == F.col("lead")).alias("leads"))
    rest = keyed.join(judged.where("not leads").select(k1, k2).distinct(), [k1, k2], "left_anti")
    again = session.save(judged.where("leads").groupBy(k1, k2).count().where("count > 1").select(k1, k2), "again")
    if not again.isEmpty():
        once = rest.join(again, [k1, k2], "left_anti")
        rest = once.unionByName(rest.join(again, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(once.columns))
    return rest.select(*docs.columns)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
