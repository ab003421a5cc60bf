"""Text functions as Column expressions.

Everything here stays inside the JVM.  Positions are code points counted from
zero, as in the occurrence table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Token shape, script classes and limits that results depend on.
TOKEN_PATTERN = r"[\p{L}\p{M}\p{Nd}]+(?:['’֊-][\p{L}\p{M}\p{Nd}]+)*"
# Every blank a Unicode text may hold, as characters and as a pattern.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
INLINE_SPACE = r"[\t\x0b\x0c\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
BLANKS = r"[\s\x1c-\x1f\x85\p{Z}&&[^\n]]"
ARMENIAN_LETTER = r"[\p{IsArmenian}&&\p{L}]"
# Letters of the Latin script whose character names do not say LATIN are left out.
LATIN_LETTER = (
    r"[\p{IsLatin}&&\p{L}&&[^\u00aa\u00ba\u02b0-\u02b8\u02e0-\u02e4\u1d2c-\u1d5c\u1d9b-\u1dbe"
    r"\u212a\u212b\u2132\u214e\u2183\u2c7d\ua770\ua7f2-\ua7f4\ua7f8\ua7f9\uab5c-\uab5f\uab69"
    r"\x{10780}-\x{107ba}]]"
)
SNIPPET_RADIUS = 25
ENTRY_MAX_LENGTH = 120
MIN_LETTERS_FOR_TEXT_LAYER = 3

SUSPICION_REASONS = {
    "latin": "dominant script is Latin",
    "mixed": "token mixes Armenian and Latin scripts",
    "digit_mixed": "token mixes digits and letters",
    "other": "dominant script is not Armenian",
}


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Projections that are merged by the optimizer would otherwise repeat the
    expression at every use, once per element when the use is inside a lambda.
    """
    return F.transform(F.array(value), body)[0]


def nfc(value: Column) -> Column:
    """SCL-1: canonical composition; plain ASCII passes through untouched."""
    composed = F.call_function(
        "reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), value, F.lit(False)
    )
    return F.when(value.rlike(r"[^\x00-\x7F]"), composed).otherwise(value)


def strip(value: Column) -> Column:
    """Trim every kind of white space, not only U+0020."""
    return F.btrim(value, F.lit(SPACES))


def clean_extracted_text(value: Column) -> Column:
    """SCL-2: tidy line ends, blanks, control characters and empty lines."""
    out = F.regexp_replace(nfc(value), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\p{C}\u00a0\u2007\u202f&&[^\n]]", " ")
    # Controls are gone by now, so the separator classes cover every blank that is left.
    out = F.regexp_replace(out, r"\p{Z}+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+$", "")


def normalize_token(value: Column) -> Column:
    """SCL-3 for arbitrary input strings."""
    return F.lower(strip(F.regexp_replace(nfc(value), INLINE_SPACE, " ")))


def normalize_token_list(values: Column) -> Column:
    """SCL-4: normalized, non-empty, first of each kept."""
    return F.array_distinct(F.filter(F.transform(values, normalize_token), lambda x: x != ""))


def rejoin_lines(text: Column, script: str = "Armenian") -> Column:
    """SCL-5: put words back together that were split by a hyphen at a line end."""
    letters = rf"\p{{Is{script}}}"
    return F.regexp_replace(
        text,
        rf"(?<![\p{{L}}\p{{Nd}}])({letters}+)-{BLANKS}*\n{BLANKS}*(?={letters})",
        "$1",
    )


def _exclusive_sums_small(lengths: Column, first: Column) -> Column:
    """[first, first+l0, first+l0+l1, ...], one longer than the input."""
    return F.aggregate(
        lengths,
        F.array(first),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
    )


def running_starts(lengths: Column, chunk: int = 64) -> Column:
    """Start position of every piece when pieces of these lengths are laid end to end.

    Two levels keep the cost near linear: totals per chunk first, then positions
    inside each chunk.
    """

    def near(pieces: Column) -> Column:
        return F.slice(_exclusive_sums_small(pieces, F.lit(0)), F.lit(1), F.size(pieces))

    def with_bases(pieces: Column) -> Column:
        last_chunk = F.floor((F.size(pieces) - 1) / chunk).cast("int")
        ids = F.sequence(F.lit(0), F.greatest(last_chunk, F.lit(0)))
        part = lambda c: F.slice(pieces, c * chunk + 1, F.lit(chunk))
        totals = F.transform(
            ids, lambda c: F.aggregate(part(c), F.lit(0), lambda acc, x: acc + x)
        )
        return bind(
            _exclusive_sums_small(totals, F.lit(0)),
            lambda bases: F.flatten(
                F.transform(
                    ids,
                    lambda c: bind(
                        part(c),
                        lambda p: F.slice(
                            _exclusive_sums_small(p, F.element_at(bases, c + 1)),
                            F.lit(1),
                            F.size(p),
                        ),
                    ),
                )
            ),
        )

    return bind(lengths, lambda p: F.when(F.size(p) <= chunk, near(p)).otherwise(with_bases(p)))


def token_list(text: Column) -> Column:
    """SCL-6, tokens only: array of tokens in text order, digits-only pieces included."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def is_word(token: Column) -> Column:
    return token.rlike(r"\p{L}")


def token_spans(text: Column) -> Column:
    """SCL-6: array of (token, char_start) for every piece of ``text``."""

    def spans(both: Column) -> Column:
        tokens, gaps = both["tokens"], both["gaps"]
        lengths = F.zip_with(
            gaps, tokens, lambda g, t: F.length(g) + F.coalesce(F.length(t), F.lit(0))
        )
        return F.zip_with(
            F.arrays_zip(tokens.alias("token"), F.slice(gaps, F.lit(1), F.size(tokens)).alias("gap")),
            F.slice(running_starts(lengths), F.lit(1), F.size(tokens)),
            lambda piece, start: F.struct(
                piece["token"].alias("token"),
                (start + F.length(piece["gap"])).alias("char_start"),
            ),
        )

    return bind(
        F.struct(token_list(text).alias("tokens"), F.split(text, TOKEN_PATTERN).alias("gaps")),
        spans,
    )


def plain_script(token: Column) -> Column:
    """Cheap answer for tokens of basic letters of one script, null for all others."""
    return F.when(token.rlike("^[ա-ևԱ-Ֆ]+$"), "armenian").when(token.rlike("^[A-Za-z]+$"), "latin")


def has_primary(token: Column) -> Column:
    return token.rlike(ARMENIAN_LETTER)


def has_latin(token: Column) -> Column:
    return token.rlike(LATIN_LETTER)


def has_digits(token: Column) -> Column:
    return token.rlike(r"\p{Nd}")


def script_type(token: Column) -> Column:
    """SCL-7: digit_mixed, then all-Armenian, all-Latin, both, anything else."""
    letters_outside = lambda cls: token.rlike(rf"[\p{{L}}&&[^{cls}]]")
    return (
        F.when(has_digits(token) & is_word(token), "digit_mixed")
        .when(has_primary(token) & ~letters_outside(ARMENIAN_LETTER), "armenian")
        .when(has_latin(token) & ~letters_outside(LATIN_LETTER), "latin")
        .when(has_primary(token) & has_latin(token), "mixed")
        .otherwise("other")
    )


def suspicion_reason(script: Column) -> Column:
    """SCL-8: why a script class is suspicious, null for the primary script."""
    pairs = [F.lit(x) for kv in SUSPICION_REASONS.items() for x in kv]
    return F.create_map(*pairs)[script]


def is_suspicious(script: Column) -> Column:
    return script != "armenian"


def _collapse(segment: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(segment, f"{SPACE}+", " "), "^ ", "")


def context_snippet(
    text: Column, start: Column, end: Column, text_length: Column, radius: int = SNIPPET_RADIUS
) -> Column:
    """SCL-9: the token with ``radius`` characters on both sides, blanks collapsed."""
    begin = F.greatest(start - radius, F.lit(0))
    stop = F.least(end + radius, text_length)
    return F.concat(
        F.when(begin > 0, "...").otherwise(""),
        _collapse(F.substring(text, begin + 1, stop - begin)),
        F.when(stop < text_length, "...").otherwise(""),
    )


def snippet_highlight(
    text: Column, start: Column, end: Column, radius: int = SNIPPET_RADIUS
) -> tuple[Column, Column]:
    """SCL-9/10: where the token sits inside the snippet built from ``text``."""
    begin = F.greatest(start - radius, F.lit(0))
    lead = F.when(begin > 0, 3).otherwise(0)
    hl_start = lead + F.length(_collapse(F.substring(text, begin + 1, start - begin)))
    hl_end = lead + F.length(
        F.rtrim(_collapse(F.substring(text, begin + 1, F.least(end, F.length(text)) - begin)))
    )
    return hl_start, hl_end


def closest_word_hit(snippet: Column, token: Column, expected: Column) -> Column:
    """SCL-10 fallback: start of the word-bounded hit nearest to ``expected``.

    Without an expectation the first hit wins; null when there is none.
    """
    width = F.length(token)
    word_char = r"^[\p{L}\p{N}_]$"

    def bounded(p: Column) -> Column:
        before = F.substring(snippet, p, F.lit(1))
        after = F.substring(snippet, p + width + 1, F.lit(1))
        return (
            (F.substring(snippet, p + 1, width) == token)
            & ((p == 0) | ~before.rlike(word_char))
            & ~after.rlike(word_char)
        )

    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(F.length(snippet) - width, F.lit(0))), bounded
    )
    nearest = F.array_min(
        F.transform(
            starts,
            lambda p: F.struct(F.abs(p - F.coalesce(expected, F.lit(-1))).alias("d"), p.alias("p")),
        )
    )["p"]
    return F.when((width > 0) & (F.length(snippet) >= width), nearest)


def stored_snippet_highlight(
    text: Column,
    start: Column,
    end: Column,
    snippet: Column,
    token: Column,
    radius: int = SNIPPET_RADIUS,
) -> Column:
    """SCL-10: struct(start, end) of the token inside a stored snippet."""
    usable = text.isNotNull() & (F.length(text) > 0) & start.isNotNull() & (end > start)
    hl_start, hl_end = snippet_highlight(text, start, end, radius)
    rebuilt = context_snippet(text, start, end, F.length(text), radius)
    word = F.when(usable, F.substring(text, start + 1, end - start)).otherwise(
        F.coalesce(token, F.lit(""))
    )
    hit = closest_word_hit(snippet, word, F.when(usable, hl_start))
    exact = F.coalesce(usable & (rebuilt == snippet), F.lit(False))
    hl = F.when(
        exact, F.struct(hl_start.alias("hl_start"), hl_end.alias("hl_end"))
    ).when(
        hit.isNotNull(), F.struct(hit.alias("hl_start"), (hit + F.length(word)).alias("hl_end"))
    )
    return F.when(F.coalesce(snippet, F.lit("")) != "", hl)


def has_text_layer(text: Column) -> Column:
    """SRC-2: at least three letters, else the page needs OCR."""
    letters = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{L}", ""))
    return letters >= MIN_LETTERS_FOR_TEXT_LAYER


def only_punctuation(value: Column) -> Column:
    return value.rlike(r"^[^\p{L}\p{N}]+$")


def looks_like_word(value: Column) -> Column:
    """SCL-12: no sentence end mark and a single blank-separated part."""
    v = strip(nfc(value))
    return (v != "") & ~v.rlike("[.!?։…]") & ~v.rlike(f"{SPACE}")


def entry_candidates(block: Column, split_separators: bool = True) -> Column:
    """SCL-11: candidate entries of one text block, in order."""

    def parts(v: Column) -> Column:
        words = F.size(F.split(v, f"{SPACE}+"))
        commas = F.length(v) - F.length(F.replace(v, F.lit(","), F.lit("")))
        splittable = v.rlike("[;|/]") | ((commas == 1) & (words <= 6))
        pieces = F.transform(F.split(v, f"{SPACE}*[;,|/]{SPACE}*"), strip)
        return F.when(splittable, pieces).otherwise(F.array(v))

    def keep(v: Column) -> Column:
        return (v != "") & (F.length(v) <= ENTRY_MAX_LENGTH) & ~only_punctuation(v)

    cleaned = strip(nfc(block))
    whole = lambda v: F.when(
        keep(v), F.filter(parts(v) if split_separators else F.array(v), keep)
    ).otherwise(F.array().cast("array<string>"))
    return bind(cleaned, whole)


def slug(value: Column) -> Column:
    """SCL-19, first half: lower-case key of a display name."""
    base = F.regexp_replace(F.regexp_replace(F.lower(strip(nfc(value))), r"(?U)\W+", "_"), "^_+|_+$", "")
    return F.when(base == "", "reference_source").otherwise(base)


def document_title(title: Column, filename: Column) -> Column:
    """SCL-22: given title, else file stem, else a placeholder."""
    given = F.nullif(strip(title), F.lit(""))
    base = F.regexp_extract(filename, r"([^/]*)$", 1)
    stem = F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    return F.coalesce(given, F.nullif(strip(stem), F.lit("")), F.lit("Untitled document"))


def ranged_progress(processed: Column, total: Column, low: Column, high: Column) -> Column:
    """SCL-23: position of a counter inside a percentage range."""
    share = F.least(F.greatest(processed / F.nullif(total, F.lit(0)), F.lit(0.0)), F.lit(1.0))
    span = F.greatest(high - low, F.lit(0))
    return F.when(total <= 0, low).otherwise(low + F.floor(span * share)).cast("int")


def content_hash(data: Column) -> Column:
    """SCL-24."""
    return F.sha2(data, 256)
