"""Phrase collocation mining: Misra-Gries summaries per hash partition, then exact counts.

A phrase is a run of two to five words of one piece of text. An n-gram is known by a 64-bit hash
of its language and words; the top bits of the hash name its hash partition. Four passes over
the texts:

1. Words are counted by hash, and the mass (number of n-grams) of every hash partition is taken.
2. Every task keeps one Misra-Gries summary a hash partition, of pairs whose words are both
   frequent. A summary over capacity loses its smallest counters and as much from all others.
   Capacity exceeds the partition's mass divided by the threshold, so that what a key can lose in
   all summaries together stays below the threshold. Summaries are mergeable: tasks may put
   out several, and one task a partition merges them. A key survives when its counter and all
   that was lost reach the threshold: every frequent pair does.
3. The same for longer n-grams all of whose pairs survived.
4. N-grams that survived are counted exactly, by their words.

What survives is handed to the tasks as a bit per hash bucket, in a table of fixed size
(``FILTER_BITS``), whatever the input: buckets shared by several keys let more n-grams into the
exact count and leave none out. Scores, cuts and the removal of parts of longer phrases are joins
of the frequent n-grams.

Defined cases: a null text has no words, a null language is ``und``; repeated rows count as often
as they stand; equal scores are ordered by frequency and then by the phrase's bytes; a cut that
scores as low as another gives way to the one with fewer words in front; empty tables give
an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom import session
from lexloom.llm import arrays as ar

LONGEST, THRESHOLD, TOP, COVERED = 5, 100, 2000, 100
#: Bits of the table of survivors (2 ** 27, 16 MB), of any input; at least eight for each hash partition.
FILTER_BITS = 27
#: Leading bits of a key that a summary hands on. Keys that share them are counted as one, which can only raise a count.
KEY_BITS = 40
#: Text bytes a hash partition stands for, and the fewest and most partitions.
SLOT_BYTES, FEWEST_SLOTS, MOST_SLOTS = 1 << 24, 64, 1 << 20
#: N-grams that a task gathers before it counts them, and counters it holds before it hands them on.
GATHERED, HELD = 1 << 19, 1 << 20
#: Distinct n-grams that a task holds in the exact count before it hands them on.
COUNTED = 250_000
#: Parts of a language that are ranked side by side.
PARTS = 32

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _CUT.copy()
_GAP[[0x20, 0x09]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Chunk:
    """Words of a chunk of texts: places, keys, and whether the next word continues the piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]):
        self.data = _FOLD[data]
        self.starts, self.ends, self.rows = ar.word_spans(self.data, offsets, _GAP)
        own = np.array([ar.span_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x.encode())]))[0] for x in langs], np.uint64)
        with np.errstate(over="ignore"):
            hashed = ar.span_hashes(self.data, self.starts, self.ends)
            self.keys = ar.mix(hashed + own[self.rows] * _ODD) if len(hashed) else hashed
        pieces = np.cumsum(_CUT[self.data])
        after = self.starts[1:]
        self.joined = (self.rows[1:] == self.rows[:-1]) & (pieces[after] == pieces[self.ends[:-1] - 1]) if len(self.keys) else np.zeros(0, bool)
        self.langs = langs

    def ngrams(self, longest: int, words: np.ndarray | None = None, pairs: np.ndarray | None = None, keep=None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """n, first words and keys of n-grams of 2 words and more.

        All their words are in ``words``, all their pairs in ``pairs``, all their beginnings in ``keep``.
        """
        at, keys = np.arange(len(self.keys)), self.keys
        if words is not None:
            at, keys = at[words], keys[words]
        for n in range(2, longest + 1):
            inside = at + n - 1 < len(self.keys)
            at, keys = at[inside], keys[inside]
            on = self.joined[at + n - 2]
            if words is not None:
                on = on & words[at + n - 1]
            if pairs is not None:
                on = on & pairs[at + n - 2]
            at, keys = at[on], keys[on]
            with np.errstate(over="ignore"):
                keys = ar.mix(keys * _ODD + self.keys[at + n - 1] + np.uint64(n))
            if keep is not None:
                held = keep(keys)
                at, keys = at[held], keys[held]
            yield n, at, keys

    def pairs_in(self, words: np.ndarray, likely) -> np.ndarray:
        """Whether the pair that begins at a word survived."""
        out = np.zeros(len(self.keys), bool)
        for _, at, keys in self.ngrams(2, words):
            out[at[likely(keys)]] = True
        return out

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[at:at + n], self.ends[at:at + n])).decode()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for part, data, offsets in ar.chunks(batches, "t"):
        yield Chunk(data, offsets, part.column("l").to_pylist())


def _texts(docs: DataFrame) -> DataFrame:
    ar.small_batches(docs.sparkSession)
    return docs.select(F.coalesce("text", F.lit("")).alias("t"), F.coalesce("lang", F.lit("und")).alias("l"))


def slots_for(docs: DataFrame) -> int:
    """Number of hash partitions, a power of two, by the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_SLOTS, max(FEWEST_SLOTS, 1 << (max(1, size // SLOT_BYTES) - 1).bit_length()))


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    return (keys >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def byte_planes(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of every value, all first bytes before all second ones: those of sorted keys and small counts compress."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size:].T.tobytes()


def from_planes(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 8 - size:] = planes.T
    return out.reshape(-1).view(">u8").astype(np.uint64)


def census(docs: DataFrame, slots: int, longest: int = LONGEST) -> DataFrame:
    """Sums of every task: word counters as summaries, mass of pairs and of longer n-grams by slot, words by language."""
    types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64())

    def rows_of(*columns) -> pa.RecordBatch:
        size = max(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.array([None] * size if c is None else c, t) for c, t in zip(columns, types)], ["slot", "keys", "counts", "lost", "longer", "lang", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, totals = np.zeros((2, slots), np.int64), {}
        held, parts, rows = Summary(slots, None), [], 0

        def words() -> pa.RecordBatch:
            got = held.out()
            held.clear()
            return rows_of(*(got.column(c) for c in ("slot", "keys", "counts", "lost")), None, None, None)

        for chunk in _chunks(batches):
            for n, _, keys in chunk.ngrams(longest):
                mass[int(n > 2)] += np.bincount(slot_of(keys, slots), minlength=slots)
            for row, n in enumerate(np.bincount(chunk.rows, minlength=len(chunk.langs)).tolist()):
                totals[chunk.langs[row]] = totals.get(chunk.langs[row], 0) + n
            parts.append(chunk.keys)
            rows += len(chunk.keys)
            if rows >= GATHERED:
                held.gather(parts)
                parts, rows = [], 0
                if len(held.keys) >= HELD:
                    yield words()
        held.gather(parts)
        yield words()
        for longer in (0, 1):
            some = np.flatnonzero(mass[longer])
            yield rows_of(some, None, None, None, np.full(len(some), longer), None, mass[longer][some])
        yield rows_of(None, None, None, None, None, list(totals), list(totals.values()))

    return _texts(docs).mapInArrow(run, "slot long, keys binary, counts binary, lost long, longer long, lang string, n long")


class Summary:
    """Misra-Gries summaries of one or all hash partitions, with what each may have lost; without a capacity, plain counts."""

    def __init__(self, slots: int, capacity: np.ndarray | None):
        self.slots, self.capacity = slots, capacity
        self.clear()

    def clear(self) -> None:
        self.keys, self.counts, self.lost = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(self.slots, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add sorted or unsorted counters, then shrink every partition that is over capacity."""
        self.keys, self.counts = _merged(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if self.capacity is None or len(self.keys) <= self.capacity.min():
            return
        bounds = np.searchsorted(slot_of(self.keys, self.slots), np.arange(self.slots + 1))
        over = np.flatnonzero(np.diff(bounds) > self.capacity)
        for slot in over.tolist():
            own = self.counts[bounds[slot]:bounds[slot + 1]]
            cut = int(np.partition(own, len(own) - 1 - self.capacity[slot])[len(own) - 1 - self.capacity[slot]])
            own -= cut
            self.lost[slot] += cut
        if len(over):
            held = self.counts > 0
            self.keys, self.counts = self.keys[held], self.counts[held]

    def gather(self, parts: list[np.ndarray]) -> None:
        """Count keys and add them."""
        if parts:
            self.add(*np.unique(np.concatenate(parts), return_counts=True))

    def out(self) -> pa.RecordBatch:
        """One row a hash partition: slot, keys, counts, lost; keys without their last bits, both laid out by ``byte_planes``."""
        bounds = np.searchsorted(slot_of(self.keys, self.slots), np.arange(self.slots + 1))
        some = np.flatnonzero((np.diff(bounds) > 0) | (self.lost > 0))
        short = self.keys >> np.uint64(64 - KEY_BITS)
        packed = [[byte_planes(x[bounds[s]:bounds[s + 1]], size) for s in some.tolist()] for x, size in ((short, KEY_BITS // 8), (self.counts, 8))]
        return pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(p, pa.binary()) for p in packed], pa.array(self.lost[some])], ["slot", "keys", "counts", "lost"])


class Filter:
    """A bit for every hash bucket that holds a key."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def segment(keys: np.ndarray, slots: int, bits: int) -> bytes:
        """The bits of one hash partition."""
        size = (1 << bits) // slots
        own = np.zeros(size, bool)
        own[((keys >> np.uint64(64 - bits)) & np.uint64(size - 1)).astype(np.int64)] = True
        return np.packbits(own, bitorder="little").tobytes()

    @staticmethod
    def of(segments: DataFrame, slots: int, bits: int) -> Filter:
        """Put the segments (slot, bits) together: 2 ** bits bits in all, of any input."""
        size = (1 << bits) // slots // 8
        whole = np.zeros(size * slots, np.uint8)
        for slot, held in segments.toLocalIterator():
            whole[slot * size:(slot + 1) * size] = np.frombuffer(held, np.uint8)
        return Filter(whole)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        bucket = keys >> np.uint64(62 - len(self.bits).bit_length())
        return (self.bits[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def capacities(counts: DataFrame, slots: int, threshold: int, longer: int) -> np.ndarray:
    """Counters of every hash partition: more than its mass (of pairs or of longer n-grams) divided by the threshold."""
    got = np.zeros(slots, np.int64)
    for slot, n in counts.where(F.col("longer") == longer).groupBy("slot").agg(F.sum("n")).toLocalIterator():
        got[slot] = n
    return got // threshold + 1


def summaries(docs: DataFrame, words, capacity, slots: int, likely=None, longest: int = LONGEST) -> DataFrame:
    """(slot, keys, counts, lost) of every task: Misra-Gries summaries of pairs of frequent words.

    With ``likely`` pairs, of longer n-grams. ``words``, ``capacity`` and ``likely`` are broadcast values.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, rows = Summary(slots, capacity.value), [], 0
        for chunk in _chunks(batches):
            often = words.value(chunk.keys)
            pairs = None if likely is None else chunk.pairs_in(often, likely.value)
            for n, _, keys in chunk.ngrams(2 if likely is None else longest, often, pairs):
                if (n == 2) == (likely is None):
                    parts.append(keys)
                    rows += len(keys)
            if rows >= GATHERED:
                held.gather(parts)
                parts, rows = [], 0
                if len(held.keys) >= HELD:
                    yield held.out()
                    held.clear()
        held.gather(parts)
        yield held.out()

    return _texts(docs).mapInArrow(run, "slot long, keys binary, counts binary, lost long")


def survivors(parts: DataFrame, capacity, slots: int, threshold: int, bits: int = FILTER_BITS) -> DataFrame:
    """Merge the summaries of every hash partition: (slot, bits) of the keys that may be frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for slot, keys, counts, lost in zip(*(batch.column(c) for c in ("slot", "keys", "counts", "lost"))):
                slot = slot.as_py()
                if slot != now:
                    yield from out(now, held)
                    now, held = slot, Summary(slots, None if capacity is None else capacity.value)
                held.lost[slot] += lost.as_py()
                held.add(from_planes(keys.as_py(), KEY_BITS // 8) << np.uint64(64 - KEY_BITS), from_planes(counts.as_py(), 8).astype(np.int64))
        yield from out(now, held)

    def out(slot, held) -> Iterator[pa.RecordBatch]:
        if held is not None:
            lost = int(held.lost[slot])
            if lost >= threshold:
                raise RuntimeError(f"hash partition {slot} lost {lost} of a threshold of {threshold}")
            keys = held.keys[held.counts + lost >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([Filter.segment(keys, slots, bits)], pa.binary())], ["slot", "bits"])

    return parts.repartition("slot").sortWithinPartitions("slot").mapInArrow(run, "slot long, bits binary")


def exact(docs: DataFrame, words, likely, slots: int, threshold: int, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, n_words and f of every n-gram of 1 to ``longest`` words that is at least as frequent as the threshold.

    Tasks hand on one row a hash partition: its phrases (language, tab, words) and their counts.
    Counts of a partition are added up by phrase, so two phrases of one hash stay apart.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out() -> pa.RecordBatch:
            by: dict[int, list] = {}
            for slot, entry in zip(slot_of(np.fromiter(held, np.uint64, len(held)), slots).tolist(), held.values()):
                by.setdefault(slot, []).append(entry)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(by), pa.int64()), pa.array([[p for p, _ in e] for e in by.values()], pa.list_(pa.string())), pa.array([[n for _, n in e] for e in by.values()], pa.list_(pa.int64()))],
                ["slot", "phrases", "counts"],
            )

        for chunk in _chunks(batches):
            often = words.value(chunk.keys)
            found = [(1, np.flatnonzero(often), chunk.keys[often]), *chunk.ngrams(longest, often, keep=likely.value)]
            for n, at, keys in found:
                keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
                for key, place, count in zip(keys.tolist(), at[first].tolist(), counts.tolist()):
                    known = held.get(key)
                    if known is None:
                        held[key] = [f"{chunk.langs[chunk.rows[place]]}\t{chunk.phrase(place, n)}", count]
                    else:
                        known[1] += count
            if len(held) >= COUNTED:
                yield out()
        yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            often = [(*p.rsplit("\t", 1), n) for p, n in held.items() if n >= threshold]
            if often:
                langs, phrases, counts = zip(*often)
                sizes = pa.array([p.count(" ") + 1 for p in phrases], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), sizes, pa.array(counts, pa.int64())], ["lang", "phrase", "n_words", "f"])
            held.clear()

        for batch in batches:
            for slot, phrases, counts in zip(*(batch.column(c) for c in ("slot", "phrases", "counts"))):
                if slot.as_py() != now:
                    yield from out()
                    now = slot.as_py()
                for phrase, n in zip(phrases.as_py(), counts.as_py()):
                    held[phrase] = held.get(phrase, 0) + n
        yield from out()

    packed = _texts(docs).mapInArrow(run, "slot long, phrases array<string>, counts array<long>")
    return packed.repartition("slot").sortWithinPartitions("slot").mapInArrow(add, "lang string, phrase string, n_words int, f long")


def frequent(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Frequent n-grams (lang, phrase, n_words, f) and the words of every language (lang, n); both are written."""
    spark: SparkSession = docs.sparkSession
    slots = slots_for(docs)
    counts = session.save(census(docs, slots, longest), "census")
    send = spark.sparkContext.broadcast

    def merged(parts: DataFrame, capacity) -> Filter:
        return Filter.of(survivors(parts, capacity, slots, threshold, bits), slots, bits)

    words = send(merged(counts.where("keys is not null").select("slot", "keys", "counts", "lost"), None))
    two, more = (send(capacities(counts, slots, threshold, longer)) for longer in (0, 1))
    pairs = send(merged(summaries(docs, words, two, slots), two))
    long = merged(summaries(docs, words, more, slots, pairs, longest), more)
    likely = send(Filter(pairs.value.bits | long.bits))
    found = session.save(exact(docs, words, likely, slots, threshold, longest), "ngrams")
    totals = session.save(counts.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")), "words")
    session.discard(counts)
    for held in (words, two, more, pairs, likely):
        held.unpersist()
    return found, totals


def _parts(phrase: str, low: str, size: str) -> str:
    return f"array_join(slice({phrase}, {low}, {size}), ' ')"


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """a, l, r, n and score of every phrase, at its lowest-scoring cut."""
    phrases = found.where("n_words > 1").withColumn("w", F.split("phrase", " "))
    cut = phrases.select("lang", "phrase", "n_words", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "n_words", "a", "k", F.expr(_parts("w", "1", "k")).alias("head"), F.expr(_parts("w", "k + 1", "n_words - k")).alias("tail"))
    heads = found.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = found.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    whole = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    value = F.expr("cast(1000 * cast(a as decimal(18,0)) * cast(n as decimal(18,0)) as decimal(38,0)) div cast(cast(l as decimal(18,0)) * cast(r as decimal(18,0)) as decimal(38,0))")
    least = whole.withColumn("score", value).groupBy("lang", "phrase", "n_words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return least.select("lang", "phrase", "n_words", "a", "m.l", "m.r", "n", "m.score")


def not_inside(phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """Phrases that no longer one holds which is at least ``covered`` percent as frequent."""
    long = phrases.where("n_words > 2").select("lang", "n_words", "a", F.split("phrase", " ").alias("w"))
    size = F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("m")
    inner = long.select("lang", "n_words", "a", "w", size).select("lang", "a", "w", "m", F.explode(F.expr("sequence(1, n_words - m + 1)")).alias("low"))
    held = inner.select("lang", F.expr(_parts("w", "low", "m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return phrases.join(held, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a"))).drop("most")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, bits: int = FILTER_BITS) -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    found, totals = frequent(docs, threshold, longest, bits)
    order = F.desc("score"), F.desc("a"), F.col("phrase")
    some = Window.partitionBy("lang", "part").orderBy(*order)
    # The best of every part of a language first, so that one language is not one task's work.
    kept = not_inside(scored(found, totals), covered).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    kept = kept.withColumn("place", F.row_number().over(some)).where(F.col("place") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for ``collocations`` with its own settings.
SQL = r"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents
), words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from pieces),
totals as (select lang, sum(len(w))::bigint n from words group by 1),
sizes as (select unnest(range(1, 6))::bigint m),
places as (select lang, w, m, unnest(range(1, len(w) - m + 2)) p from words, sizes where len(w) >= m),
grams as (select lang, array_to_string(w[p:p + m - 1], ' ') phrase, m, count(*)::bigint f from places group by 1, 2, 3 having count(*) >= 100),
cuts as (
  select lang, phrase, m, f a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') head, array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') tail
  from (select *, unnest(range(1, m)) k from grams where m > 1)
), valued as (
  select c.lang, c.phrase, c.m, c.a, k, x.f l, y.f r, n, (1000::hugeint * c.a * n) // (x.f::hugeint * y.f) score
  from cuts c join grams x on x.lang = c.lang and x.phrase = c.head join grams y on y.lang = c.lang and y.phrase = c.tail join totals t on t.lang = c.lang
), least as (select * from valued qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (
  select lang, array_to_string(string_split(phrase, ' ')[p:p + s - 1], ' ') phrase, max(f) most
  from (select *, unnest(range(1, m - s + 2)) p from (select *, unnest(range(2, m)) s from grams where m > 2)) group by 1, 2
), kept as (select l.* from least l left join inner_ i on i.lang = l.lang and i.phrase = l.phrase where most is null or 100 * most < 100 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) rank from kept)
select lang, rank::bigint rank, phrase, a, l, r, n, score::bigint score from ranked where rank <= 2000
"""
