"""Pages to word occurrences (OCC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.functions import text as tx

# Long pages are cut into pieces of about this many characters, at white space only,
# so that no token is cut and substring work stays near the piece.
PIECE_PATTERN = r"(?s).{1,400}[^\s\x1c-\x1f\x85\p{Z}]*"


def occurrences(pages: DataFrame) -> DataFrame:
    """OCC-1: one row per word of every page.

    ``pages`` holds page_text that is already cleaned and rejoined.  There is no
    shuffle: pieces and tokens are exploded where the page is.  A piece carries
    the characters around it, enough for the snippets at its edges.
    """
    radius = tx.SNIPPET_RADIUS
    pieces = F.regexp_extract_all("page_text", F.lit(PIECE_PATTERN), F.lit(0))
    placed = tx.bind(
        pieces,
        lambda p: F.zip_with(
            p,
            tx.running_starts(F.transform(p, F.length)),
            lambda piece, start: F.struct(piece.alias("piece"), start.alias("piece_start")),
        ),
    )
    keep = ["owner_id", "document_id", "page_id", "page_number"]
    start, stop = F.col("piece_start"), F.col("piece_start") + F.length("piece")
    by_piece = (
        pages.select(*keep, "page_text", F.explode(placed).alias("p"))
        .select(*keep, "page_text", "p.piece", "p.piece_start")
        .select(
            *keep,
            "piece",
            "piece_start",
            F.length("page_text").alias("page_length"),
            F.least(start, F.lit(radius)).alias("lead"),
            # Blanks become single spaces one for one, so positions stay as they are.
            F.regexp_replace(
                F.concat(
                    F.substring("page_text", F.greatest(start - radius, F.lit(0)) + 1, F.least(start, F.lit(radius))),
                    F.col("piece"),
                    F.substring(F.col("page_text"), stop + 1, F.lit(radius)),
                ),
                r"[\s\x1c-\x1f\x85\p{Z}]", " ",
            ).alias("around"),
        )
    )
    spans = by_piece.select(
        *keep, "piece_start", "page_length", "lead", "around",
        F.explode(tx.token_spans(F.col("piece"))).alias("s"),
    ).where(tx.is_word(F.col("s.token")))

    token = F.col("s.token")
    local = F.col("s.char_start") + F.col("lead")
    char_start = F.col("piece_start") + F.col("s.char_start")
    char_end = char_start + F.length(token)
    near = F.substring(
        F.col("around"),
        F.greatest(local - radius, F.lit(0)) + 1,
        F.length(token) + radius + F.least(local, F.lit(radius)),
    )
    words = spans.select(
        *keep, "page_length", token.alias("token"), tx.plain_script(token).alias("plain"),
        char_start.cast("int").alias("char_start"), char_end.cast("int").alias("char_end"), near.alias("near"),
        F.substring(near, F.lit(1), F.least(local, F.lit(radius))).alias("left"),
    )
    # The word inside its snippet, stored so that no later step needs the page for it.
    hl_start = F.when(F.col("char_start") > radius, 3).otherwise(0) + F.length(_single_blanks("left"))
    return words.select(
        *keep,
        "token",
        F.lower("token").alias("normalized_token"),
        *classification(F.col("token"), F.col("plain")),
        "char_start",
        "char_end",
        F.concat(
            F.when(F.col("char_start") > radius, "...").otherwise(""),
            _single_blanks("near"),
            F.when(F.col("char_end") + radius < F.col("page_length"), "...").otherwise(""),
        ).alias("context_snippet"),
        hl_start.alias("highlight_start"),
        (hl_start + F.length("token")).alias("highlight_end"),
    )


def page_words(pages: DataFrame) -> DataFrame:
    """OCC-1 without places: one row per word of every page, for steps that count only."""
    token = F.col("token")
    words = pages.select(
        "owner_id", "document_id", "page_id", "page_number", F.explode(tx.token_list(F.col("page_text"))).alias("token")
    ).where(tx.is_word(token))
    return words.withColumn("plain", tx.plain_script(token)).withColumn("normalized_token", F.lower(token)).withColumns(
        dict(zip(["script_type", "has_digits", "has_latin", "has_armenian", "token_length"], classification(token, F.col("plain"))))
    ).drop("plain")


def _single_blanks(name: str) -> Column:
    return F.ltrim(F.when(F.contains(name, F.lit("  ")), F.regexp_replace(name, " +", " ")).otherwise(F.col(name)))


def classification(token: Column, plain: Column) -> list[Column]:
    """SCL-7 as columns; ``plain`` answers for ordinary words of one script."""
    known = plain.isNotNull()
    return [
        F.coalesce(plain, tx.script_type(token)).alias("script_type"),
        F.when(known, False).otherwise(tx.has_digits(token)).alias("has_digits"),
        F.when(known, plain == "latin").otherwise(tx.has_latin(token)).alias("has_latin"),
        F.when(known, plain == "armenian").otherwise(tx.has_primary(token)).alias("has_armenian"),
        F.length(token).alias("token_length"),
    ]


def backfill_classification(rows: DataFrame) -> DataFrame:
    """OCC-2: fill the script columns only where they are missing."""
    missing = F.col("script_type").isNull()
    fresh = {
        "script_type": tx.script_type(F.col("token")),
        "has_digits": tx.has_digits(F.col("token")),
        "has_latin": tx.has_latin(F.col("token")),
        "has_armenian": tx.has_primary(F.col("token")),
        "token_length": F.length("token"),
    }
    return rows.withColumns({c: F.when(missing, v).otherwise(F.col(c)) for c, v in fresh.items()})


def assign_lexemes(rows: DataFrame, lexeme_forms: DataFrame) -> DataFrame:
    """OCC-3: set lexeme_id on occurrences whose form belongs to a lexeme.

    One frequent form may hold a large share of the fact table. The side of forms is small
    and has a form once, so adaptive execution broadcasts it where it fits, and the fact
    rows stay where they are; else it splits the partition of the frequent form.
    """
    forms = lexeme_forms.select("owner_id", F.col("normalized_form").alias("normalized_token"), "lexeme_id")
    return rows.drop("lexeme_id").join(forms, ["owner_id", "normalized_token"], "left")


def list_occurrences(
    rows: DataFrame,
    document_id: str | None = None,
    page_number: int | None = None,
    normalized_token: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """OCC-4: a slice of one document's words, or of every document's, in reading order."""
    out = rows
    for column, value in (("document_id", document_id), ("page_number", page_number), ("normalized_token", normalized_token)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return _listed(out, ["page_number", F.asc_nulls_first("char_start")], limit, offset)


def list_pages(pages: DataFrame, document_id: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """OCC-5: a slice of one document's pages, or of every document's, in order."""
    out = pages if document_id is None else pages.where(F.col("document_id") == document_id)
    return _listed(out, ["page_number"], limit, offset)


def _listed(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(*order))
    return rows.withColumn("place", place).where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def document_forms(rows: DataFrame) -> DataFrame:
    """OCC-6: distinct forms of every document."""
    return rows.select("owner_id", "document_id", F.col("normalized_token").alias("normalized_form")).distinct()
