"""Quality rules by repetition coverage.

Rolling hashes over word hashes give every n-gram of several lengths a 64-bit value; an
n-gram whose value comes twice or more in its text covers its words. The characters that
the copies after the first cover (each counted once) are measured against all characters
in words, for every length; the same is done for lines. The base rule also counts the
words of the first copy.

Defined cases: a null or blank text has no words and fails the base rule; ties and
repeated rows are judged each on its own; an empty table gives an empty result; columns
of any other name are ignored, or carried unchanged by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm import arrays as ar

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Largest shares of word characters in later copies of n-grams (by n) and of lines."""

    gram_shares: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    line_share: float = 0.20
    min_words: int = 10
    base_gram: int = 5
    base_percent: int = 20


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, {grams}base_failed boolean, kept boolean"


def schema_of(rules: Rules) -> str:
    return COLUMNS.format(grams="".join(f"dup_chars_{n} long, " for n in sorted(rules.gram_shares)))


def covered_words(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words lie in an n-gram found twice or more in their own text: in any copy, in a later copy."""
    grams = ar.window_hashes(words, n)
    whole = np.flatnonzero(rows[: len(grams)] == rows[n - 1:]) if len(grams) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        key = ar.mix(grams[whole] + rows[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    key = key[order]
    twin = np.zeros(len(key), bool)
    same = key[1:] == key[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    start, key = whole[order[twin]], key[twin]
    order = np.lexsort((start, key))
    start, key = start[order], key[order]
    later = np.zeros(len(key), bool)
    later[1:] = key[1:] == key[:-1]
    return covered(start, n, len(words)), covered(start[later], n, len(words))


def covered(start: np.ndarray, n: int, total: int) -> np.ndarray:
    depth = np.bincount(start, minlength=total + 1)[: total + 1] - np.bincount(start + n, minlength=total + 1)[: total + 1]
    return np.cumsum(depth[:-1]) > 0


def repeated_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier line, and the characters in their words."""
    count, chars = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    raw = data.tobytes()
    for i in range(len(count)):
        text = raw[offsets[i]:offsets[i + 1]]
        if text.count(b"\n"):
            seen: set[bytes] = set()
            for line in text.split(b"\n"):
                if line in seen:
                    count[i] += 1
                    chars[i] += sum(len(w.decode(errors="replace")) for w in line.split())
                elif line.strip():
                    seen.add(line)
    return count, chars


def measure(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, rows = ar.word_spans(data, offsets)
    words = ar.span_hashes(data, starts, ends)
    first_bytes = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    chars = first_bytes[ends] - first_bytes[starts]
    n_words, word_chars = np.bincount(rows, minlength=n), ar.per_row(chars, rows, n)
    out = {"n_words": n_words, "word_chars": word_chars}
    out["n_symbols"] = np.bincount(np.searchsorted(offsets, np.flatnonzero(SYMBOLS[data]), "right") - 1, minlength=n)
    out["n_dup_lines"], dup_line_chars = repeated_lines(data, offsets)
    any_copy, later_copy = covered_words(words, rows, rules.base_gram)
    out["n_repeat_words"] = ar.per_row(any_copy, rows, n)
    out["dup_line_chars"] = dup_line_chars
    good = dup_line_chars <= rules.line_share * word_chars
    for size in sorted(rules.gram_shares):
        inside = later_copy if size == rules.base_gram else covered_words(words, rows, size)[1]
        out[f"dup_chars_{size}"] = ar.per_row(chars * inside, rows, n)
        good &= out[f"dup_chars_{size}"] <= rules.gram_shares[size] * word_chars
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.base_percent * n_words)
    out["kept"] = good & ~out["base_failed"]
    return out


def repetition(docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, coverage and verdict of every row: the key and the columns of ``schema_of``."""
    kind = docs.schema[key].dataType.simpleString()
    ar.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in ar.chunks(batches, "t"):
            got = measure(data, offsets, rules)
            yield pa.RecordBatch.from_arrays([part.column("k"), *map(pa.array, got.values())], [key, *got])

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"`{key}` {kind}, {schema_of(rules)}")


def keep_good(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The rows that pass, with all their columns."""
    ar.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in ar.chunks(batches, text):
            yield part.filter(pa.array(measure(data, offsets, rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def sql(rules: Rules = Rules()) -> str:
    """The same rows from DuckDB: one row an n-gram, numbered among its equals in the text."""
    sizes = sorted({rules.base_gram, *rules.gram_shares})
    grams = " UNION ALL ".join(f"SELECT doc_id, {n} AS n, i AS pos, array_to_string(ws[i:i + {n} - 1], ' ') AS gram FROM w, range(1, len(ws) - {n} + 2) r(i)" for n in sizes)
    measures = "".join(f"coalesce(max(chars) FILTER (WHERE n = {n}), 0)::BIGINT AS dup_chars_{n}, " for n in sorted(rules.gram_shares))
    good = " AND ".join(f"dup_chars_{n} <= {share} * word_chars" for n, share in sorted(rules.gram_shares.items()))
    word = "'[^\\x20\\x09-\\x0D]+'"
    return f"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {word}) AS ws FROM documents),
g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, n, gram ORDER BY pos) AS nth, count(*) OVER (PARTITION BY doc_id, n, gram) AS times FROM ({grams})),
later AS (SELECT DISTINCT doc_id, n, pos + k AS p FROM g, range(0, 16) r(k) WHERE nth > 1 AND k < n),
covered AS (SELECT later.doc_id, n, sum(length(ws[p])) AS chars FROM later JOIN w USING (doc_id) GROUP BY ALL),
shares AS (SELECT doc_id, {measures}0 AS unused FROM covered GROUP BY doc_id),
base AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM g, range(0, {rules.base_gram}) r(k) WHERE times > 1 AND g.n = {rules.base_gram} GROUP BY doc_id),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nth FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)),
d AS (SELECT doc_id, count(*) AS n, sum(length(array_to_string(regexp_extract_all(line, {word}), ''))) AS chars FROM l WHERE nth > 1 AND regexp_matches(line, {word}) GROUP BY doc_id),
a AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(base.n, 0)::BIGINT AS n_repeat_words,
    coalesce(d.chars, 0)::BIGINT AS dup_line_chars, {", ".join(f"coalesce(dup_chars_{n}, 0)::BIGINT AS dup_chars_{n}" for n in sorted(rules.gram_shares))}
  FROM w LEFT JOIN d USING (doc_id) LEFT JOIN base USING (doc_id) LEFT JOIN shares USING (doc_id)
), b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.base_percent} * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND dup_line_chars <= {rules.line_share} * word_chars AND {good} AS kept FROM b
"""
