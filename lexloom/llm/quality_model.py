"""Quality classifier: n-gram indicators scaled by class log-count ratios, then a linear hinge loss.

Features are indicators of n-grams, hashed to ``BUCKETS``: byte n-grams of one to four bytes, and
n-grams of one to three word shapes (case, last character, same as the word before). An indicator
is scaled by its log-count ratio, the log of how much likelier texts of label 1 have it than texts
of label 0, and a text's features have unit length. The model is fitted by dual coordinate descent
and drawn towards its mean weight. A logistic curve, fitted on texts kept out of the descent, turns
values into scores.

Ratios are counted over all labelled texts that may be learnt from, in the tasks, as sums that are
merged by blocks of buckets. Coordinate descent runs on a sample of at most ``SAMPLE`` texts of each
label (those of lowest hash; all of them while there are fewer), gathered in one task: the sample is
bounded and so is its task. Only the weights (``BUCKETS`` numbers) go through the driver.

Defined cases: a null text is empty and gets the score of a text without features; label rows
with a null id or label are left out, as are ids whose labels disagree; a text that stands twice is
learnt from and scored twice; without labels every score is 0.5, with labels of one kind only it is
the smoothed share of label 1; empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import session
from lexloom.llm import arrays as ar

#: Most texts of one label that the model is fitted on.
SAMPLE = 4096
BUCKETS = 1 << 18
LONGEST_BYTES, LONGEST_SHAPES = 4, 3
#: Added to every count; cost of a unit of hinge loss; rounds over the sample; share of the fitted weights in the mix with their mean.
SMOOTHING, COST, ROUNDS, OWN_WEIGHT = 1.0, 1.0, 30, 0.25
#: One text in so many of the sample is kept for the curve.
CURVE_SHARE = 4
#: Buckets that are summed together, and most ids that are broadcast to pick labelled texts; beyond, the join shuffles.
BLOCK = 4096
BROADCAST_IDS = 2_000_000

_SHIFT = np.uint32(32 - (BUCKETS.bit_length() - 1))
_MULTIPLIER = np.uint32(2654435761)


def _bucket(codes: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (codes ^ (codes >> np.uint32(15))) * _MULTIPLIER + np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF)
        return ((mixed ^ (mixed >> np.uint32(13))) * _MULTIPLIER) >> _SHIFT


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A small number for every word: letter case, last character unless a letter or digit, same as the word before."""
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (upper, lower)]
    n_upper, n_lower = (s[ends] - s[starts] for s in sums)
    case = (n_upper > 0).astype(np.uint32) + 2 * (n_lower > 0) + 4 * (upper[starts] & (n_upper == 1)) + 8 * (ends - starts > 20)
    last = data[ends - 1].astype(np.uint32)
    last[(last >= 128) | upper[ends - 1] | lower[ends - 1] | ((last >= 48) & (last <= 57))] = 0
    hashed = ar.span_hashes(data, starts, ends)
    same = np.concatenate([[False], hashed[1:] == hashed[:-1]]) if len(hashed) else np.zeros(0, bool)
    return (case.astype(np.uint32) << np.uint32(8) | last) << np.uint32(1) | same


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct buckets of every text of a chunk, sorted."""
    grams = []
    with np.errstate(over="ignore"):
        codes = data.astype(np.uint32)
        for n in range(1, LONGEST_BYTES + 1):
            if n > 1:
                codes = codes[:-1] << np.uint32(8) | data[n - 1:]
            grams.append(_bucket(codes, n))
        starts, ends, rows = ar.word_spans(data, offsets)
        shapes, runs = _shapes(data, starts, ends) if len(starts) else np.zeros(0, np.uint32), []
        codes = shapes
        for n in range(1, LONGEST_SHAPES + 1):
            if n > 1:
                codes = codes[:-1] * np.uint32(0x85EBCA6B) + shapes[n - 1:]
            runs.append(_bucket(codes, 16 + n))
    words = np.searchsorted(rows, np.arange(len(offsets))).tolist()
    seen, bounds = np.zeros(BUCKETS, bool), offsets.tolist()
    for row in range(len(bounds) - 1):
        for n, got in enumerate(grams):
            seen[got[bounds[row]:max(bounds[row], bounds[row + 1] - n)]] = True
        for n, got in enumerate(runs):
            seen[got[words[row]:max(words[row], words[row + 1] - n)]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and label of the ids that may be learnt from."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other").select("doc_id", "label")


def _texts_of(docs: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """label and t of the texts of the ids, which are broadcast while there are few."""
    slim = docs.select(F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    ids = ids.withColumnRenamed("doc_id", "i")
    return slim.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "i")


def counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts of each label that have a feature (2 x BUCKETS), and texts of each label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, n = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for part, data, offsets in ar.chunks(batches, "t"):
            for label, found in zip(part.column("label").to_pylist(), features(data, offsets)):
                got[label, found] += 1
                n[label] += 1
        if n.any():
            blocks = [got[:, low:low + BLOCK].tobytes() for low in range(0, BUCKETS, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks))), pa.array(blocks, pa.binary()), pa.array([n.tobytes()] * len(blocks), pa.binary())], ["block", "held", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, held, n in zip(*(batch.column(c).to_pylist() for c in ("block", "held", "n"))):
                to = sums.setdefault(block, [np.zeros(2 * BLOCK, np.int64), np.zeros(2, np.int64)])
                to[0] += np.frombuffer(held, np.int64)
                to[1] += np.frombuffer(n, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), *[pa.array([v[k].tobytes() for v in sums.values()], pa.binary()) for k in (0, 1)]], ["block", "held", "n"])

    schema = "block long, held binary, n binary"
    rows = texts.select("label", "t").mapInArrow(run, schema).repartition("block").mapInArrow(merge, schema).collect()
    whole, n = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    for block, held, size in rows:
        whole[:, block * BLOCK:(block + 1) * BLOCK] = np.frombuffer(held, np.int64).reshape(2, BLOCK)
        n = np.frombuffer(size, np.int64)
    return whole, n


def ratios(got: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log of the share of label 1 that has a feature over that of label 0."""
    share = (got + SMOOTHING) / (n[:, None] + 2 * SMOOTHING)
    return np.log(share[1] / share[0])


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and offset of the squared hinge loss by dual coordinate descent over rows in random order."""
    w, b, alpha, rng = np.zeros(size), 0.0, np.zeros(len(rows)), np.random.default_rng(7)
    square = np.array([float(v @ v) for v in values]) + 1.0 + 1 / (2 * cost)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            slope = y[i] * (w[rows[i]] @ values[i] + b) - 1 + alpha[i] / (2 * cost[i])
            if alpha[i] == 0:
                slope = min(slope, 0.0)
            if slope:
                worst = max(worst, abs(slope))
                new = max(alpha[i] - slope / square[i], 0.0)
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[rows[i]] += step * values[i]
                b += step
        if worst < 1e-3:
            break
    return w, b


def curve(value: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through values, by Newton steps; targets are drawn in from 0 and 1."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, ab = np.stack([value, np.ones_like(value)], axis=1), np.array([1.0, 0.0])

    def loss(ab: np.ndarray) -> float:
        z = x @ ab
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 1e-6 * ab @ ab)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -500, 500)))
        slope = x.T @ (weight * (p - target)) + 2e-6 * ab
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 2e-6 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        size, before = 1.0, loss(ab)
        while size > 1e-6 and loss(ab - size * step) > before:
            size /= 2
        ab = ab - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(ab[0]), float(ab[1])


def _scaled(found: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    own = ratio[found]
    length = float(np.sqrt(own @ own))
    return own / length if length else own


def fit(texts: DataFrame, ratio, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and (offset, slope, shift), from a bounded sample in one task.

    ``texts`` has label, hash and t; ``ratio`` is a broadcast value.
    """
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in ar.chunks(batches, "t"):
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), part.column("hash"), pa.array([f.astype(np.int32).tobytes() for f in features(data, offsets)], pa.binary())], ["label", "hash", "held"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, hashes, rows = [], [], []
        for batch in batches:
            labels.append(batch.column("label").to_numpy())
            hashes.append(batch.column("hash").to_numpy())
            rows += [np.frombuffer(held.as_py(), np.int32) for held in batch.column("held")]
        if not rows:
            return
        y, by = np.where(np.concatenate(labels) > 0, 1.0, -1.0), np.concatenate(hashes)
        order = np.lexsort((y, by))
        y, by, rows = y[order], by[order], [rows[k] for k in order.tolist()]
        values = [_scaled(r, ratio.value) for r in rows]
        kept = by % CURVE_SHARE == 0
        if min((y[kept] > 0).sum(), (y[kept] < 0).sum()) < 2 or min((y[~kept] > 0).sum(), (y[~kept] < 0).sum()) < 2:
            kept[:] = True
            learnt = np.ones(len(y), bool)
        else:
            learnt = ~kept
        own = np.flatnonzero(learnt)
        cost = COST * np.where(y > 0, len(own) / 2 / max(1, (y[own] > 0).sum()), len(own) / 2 / max(1, (y[own] < 0).sum()))[own]
        w, b = descend([rows[k] for k in own], [values[k] for k in own], y[own], cost, BUCKETS)
        used = np.zeros(BUCKETS, bool)
        for k in own.tolist():
            used[rows[k]] = True
        w = OWN_WEIGHT * w + (1 - OWN_WEIGHT) * np.where(used, np.abs(w[used]).mean(), 0.0)
        value = np.array([w[r] @ v for r, v in zip(rows, values)]) + b
        weight = np.where(y > 0, n[1] / max(1, (y[kept] > 0).sum()), n[0] / max(1, (y[kept] < 0).sum()))[kept]
        slope, shift = curve(value[kept], y[kept], weight / weight.mean())
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([np.array([b, slope, shift]).tobytes()], pa.binary())], ["w", "curve"])

    sample = texts.mapInArrow(pick, "label int, hash long, held binary")
    row = sample.repartition(1).mapInArrow(run, "w binary, curve binary").first()
    return np.frombuffer(row.w), np.frombuffer(row.curve)


class Model:
    """Score of a text's features."""

    def __init__(self, ratio: np.ndarray, w: np.ndarray, offset: float, slope: float, shift: float):
        self.gain, self.square, self.offset, self.slope, self.shift = ratio * w, ratio * ratio, offset, slope, shift

    def score(self, found: np.ndarray) -> float:
        length = np.sqrt(self.square[found].sum())
        value = (self.gain[found].sum() / length if length else 0.0) + self.offset
        return float(1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -500, 500))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    ar.small_batches(spark)
    known = session.save(labelled(labels), "labels")
    n_known = known.count()
    got, n = counts(_texts_of(docs, known, n_known))
    if not n.all():
        share = float(n[1] + 1) / float(n.sum() + 2)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    ratio = ratios(got, n)
    by = known.withColumn("hash", F.abs(F.xxhash64(F.lit(11), "doc_id") % F.lit(1 << 40)))
    chosen = by.where("label = 0").orderBy("hash", "doc_id").limit(sample).union(by.where("label = 1").orderBy("hash", "doc_id").limit(sample))
    texts = _texts_of(docs, session.save(chosen, "sample"), min(n_known, 2 * sample)).select(F.col("label").cast("int").alias("label"), "hash", "t")
    held = spark.sparkContext.broadcast(ratio)
    w, (offset, slope, shift) = fit(texts, held, n)
    held.unpersist()
    session.discard(known)
    return Model(ratio, w, offset, slope, shift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    ar.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in ar.chunks(batches, "t"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([held.value.score(f) for f in features(data, offsets)], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    got = score(docs, train(docs, labels, sample))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
