"""Wordlists, sentences, annotated text, mapping files and tagger output (SRC-3..14)."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from functools import reduce
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexloom.functions import text as tx
from lexloom.sources import runs as rn

PAIR = ["file", "surface_form", "normalized_form"]
PDF_TEXT_MIN_LENGTH = 40
OCR_WARNING = "Entries were recognized from page images; expect misread letters among the matches."
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Fixed value: marker of an annotated word, surface and annotation.
ANNOTATION = r"\[\[(.*?)>>>\s*(.*?)\]\]"


def entries_from_blocks(blocks: DataFrame, split_separators: bool | Column = True) -> DataFrame:
    """SCL-11 over a table of blocks (file, block): distinct (surface, normalized) pairs per file."""
    if isinstance(split_separators, bool):
        candidates = tx.entry_candidates(F.col("block"), split_separators)
    else:
        candidates = F.when(split_separators, tx.entry_candidates(F.col("block"), True)).otherwise(
            tx.entry_candidates(F.col("block"), False)
        )
    return (
        blocks.select("file", F.explode(candidates).alias("surface_form"))
        .withColumn("normalized_form", tx.normalize_token(F.col("surface_form")))
        .where(F.col("normalized_form") != "").select(*PAIR).distinct()
    )


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\\ufeff|\\r$", "").alias("block"))


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: one entry per line, separators kept."""
    return entries_from_blocks(lines_of(spark, path), False).withColumn("import_method", F.lit("txt"))


def header_name(name: str) -> str:
    import re

    return re.sub(r"[\s\-]+", "_", name.lstrip("﻿").strip().lower())


def csv_entries(rows: DataFrame) -> DataFrame:
    """SRC-4 on rows whose header is the source's own; one ``file`` column is added by the reader."""
    named = {header_name(c): c for c in rows.columns if c != "file"}
    surface, normal = named.get("surface_form"), named.get("normalized_form")
    if surface is None and normal is None:
        if len(named) != 1:
            raise ValueError("a wordlist needs a surface_form or normalized_form column")
        only = tx.strip(F.coalesce(F.col(next(iter(named.values()))), F.lit("")))
        out = rows.select("file", only.alias("surface_form"), F.lit("").alias("given")).where(tx.looks_like_word(F.col("surface_form")))
    else:
        value = lambda c: tx.strip(F.coalesce(F.col(c), F.lit(""))) if c else F.lit("")
        out = rows.select("file", value(surface).alias("surface_form"), value(normal).alias("given"))
    out = out.withColumn("surface_form", F.when(F.col("surface_form") == "", F.col("given")).otherwise(F.col("surface_form")))
    normalized = tx.normalize_token(F.when(F.col("given") != "", F.col("given")).otherwise(F.col("surface_form")))
    return (
        out.withColumn("normalized_form", normalized)
        .where((F.col("surface_form") != "") & (F.col("normalized_form") != "")).select(*PAIR).distinct()
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: every file is read under its own header; files of equal headers are read together."""
    first = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_block_start").alias("at"))
    heads = first.where("at = 0").groupBy("file").agg(F.first("value").alias("head"))
    # One row for each file's header line: a folder of wordlists, read on the driver to plan the readers.
    groups: dict[str, list[str]] = {}
    for row in heads.orderBy("file").toLocalIterator():
        groups.setdefault(row["head"].lstrip("\ufeff").rstrip("\r"), []).append(row["file"])
    if not groups:
        return spark.createDataFrame([], "file string, surface_form string, normalized_form string, import_method string")
    parts = [
        csv_entries(spark.read.csv(files, header=True, multiLine=True, escape='"').withColumn("file", F.col("_metadata.file_path")))
        for files in groups.values()
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("import_method", F.lit("csv"))


def docx_blocks(files: DataFrame) -> DataFrame:
    """SRC-5: paragraphs of word-processor files (file, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for name, content in zip(frame["file"], frame["content"]):
                with zipfile.ZipFile(BytesIO(content)) as box:
                    tree = ElementTree.fromstring(box.read("word/document.xml"))
                for paragraph in tree.iter(f"{WORD_NS}p"):
                    words = "".join(t.text or "" for t in paragraph.iter(f"{WORD_NS}t"))
                    if words.strip():
                        out.append((name, words))
            yield pd.DataFrame(out, columns=["file", "block"])

    return files.select("file", "content").mapInPandas(run, "file string, block string")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return entries_from_blocks(docx_blocks(files), True).withColumn("import_method", F.lit("docx"))


def pdf_entries(lines: DataFrame) -> DataFrame:
    """SRC-6 on tidied lines (file, page, kind, block); kind is ``text`` or ``ocr``.

    A file whose text layer holds at least forty characters uses it, any other
    file falls back to its recognized lines, with a warning.
    """
    # Length of a page's text is its lines plus the line ends between them.
    per_page = lines.groupBy("file", "page").agg(
        F.sum(F.when(F.col("kind") == "text", F.length("block") + 1).otherwise(0)).alias("size")
    )
    size = F.sum(F.greatest(F.col("size") - 1, F.lit(0)))
    usable = per_page.groupBy("file").agg((size >= PDF_TEXT_MIN_LENGTH).alias("has_text"))
    chosen = lines.join(usable, "file").where((F.col("kind") == "text") == F.col("has_text"))
    entries = entries_from_blocks(chosen, F.col("has_text"))
    return entries.join(usable, "file").select(
        *PAIR, F.when(F.col("has_text"), "pdf_text").otherwise("pdf_ocr").alias("import_method"),
        F.when(~F.col("has_text"), OCR_WARNING).alias("warning"),
    )


def read_wordlists(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-14: one reader per file suffix in any case, results side by side; other suffixes are refused."""
    root = folder.rstrip("/")
    readers = {"txt": read_txt, "csv": read_csv, "docx": read_docx}
    # Only the names are read here; one row per spelling of a suffix comes back.
    suffix = F.regexp_extract("path", r"\.([^./]+)$", 1)
    found = sorted(r.suffix for r in spark.read.format("binaryFile").load(root).select(suffix.alias("suffix")).distinct().collect())
    refused = [s for s in found if s.lower() not in readers]
    if refused or not found:
        raise ValueError(f"no reader for wordlist files of type {', '.join(refused) or '(none)'}")
    parts = [readers[s.lower()](spark, f"{root}/*.{s}") for s in found]
    return reduce(DataFrame.unionByName, parts)


# Sentences -------------------------------------------------------------------------


def sentences_of(lines: DataFrame) -> DataFrame:
    """SRC-7 on (file, block, line) in reading order: token/tag lines to numbered sentences.

    A blank line ends a sentence, document marks and lines with fewer than two
    columns are skipped. Sentences are numbered from 0 in every file.
    """
    text = tx.strip(F.col("line"))
    parts = F.size(F.split(text, f"{tx.SPACE}+"))
    kind = F.when(text == "", rn.BLANK).when(text.startswith("-DOCSTART-") | (parts < 2), rn.SKIP).otherwise(rn.WORD)
    whole = rn.whole_runs(rn.runs(lines.withColumn("line", text), kind))
    words = F.transform("line_values", lambda x: F.split(x, f"{tx.SPACE}+"))
    return whole.select("file", F.col("run").alias("sentence_no"), words.alias("w")).select(
        "file", "sentence_no", F.transform("w", lambda x: F.get(x, F.lit(0))).alias("tokens"), F.transform("w", lambda x: F.element_at(x, -1)).alias("labels")
    )


def sentences_from_lines(lines: DataFrame) -> DataFrame:
    """SRC-7 on rows (file, line_no, line)."""
    return sentences_of(rn.table_lines(lines))


def read_sentence_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7 on files of any size, read in splits."""
    return sentences_of(rn.file_lines(spark, path))


def sentence_records(records: DataFrame, label_names: list[str] | None = None) -> DataFrame:
    """SRC-8: records with differing column names; integer labels are decoded."""
    def pick(names: tuple[str, ...]) -> str:
        found = [c for c in names if c in records.columns]
        if not found:
            raise ValueError(f"records have none of {names}")
        return found[0]

    def listed(name: str) -> Column:
        kind = dict(records.dtypes)[name]
        if kind == "string":
            return F.split(tx.strip(F.col(name)), f"{tx.SPACE}+")
        if label_names and kind in ("array<int>", "array<bigint>"):
            known = F.array(*[F.lit(x) for x in label_names])
            return F.transform(name, lambda i: F.coalesce(F.when(i < len(label_names), F.get(known, i.cast("int"))), i.cast("string")))
        return F.col(name).cast("array<string>")

    return records.withColumns({
        "tokens": listed(pick(("tokens", "words", "token", "sentence"))),
        "labels": listed(pick(("ner_tags", "tags", "labels", "ner"))),
    })


def source_kind_and_split(path: Column, root: Column) -> tuple[Column, Column]:
    """SRC-9: gold or silver, and the dataset split, from a file's path under its root."""
    relative = F.lower(F.when(path.startswith(root), F.substring(path, F.length(root) + 1, F.length(path))).otherwise(path))
    stem = F.regexp_replace(F.lower(F.regexp_extract(path, r"([^/]*)$", 1)), r"(?<=.)\.[^.]*$", "")
    kind = (
        F.when(relative.rlike("gold|manual") | F.contains(stem, F.lit("test")), "gold")
        .when(relative.rlike("silver|wiki"), "silver").otherwise("silver")
    )
    split = (
        F.when(F.contains(stem, F.lit("train")), "train").when(F.contains(stem, F.lit("dev")), "dev")
        .when(F.contains(stem, F.lit("test")), "test").when(F.contains(stem, F.lit("val")), "val")
        .when(stem == "", "unknown").otherwise(stem)
    )
    return kind, split


# Annotated corpus and mapping files --------------------------------------------------


def annotated_tokens(texts: DataFrame) -> DataFrame:
    """SRC-10: (source_id, surface, lemma) of every marked word in (source_id, text)."""
    pairs = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(ANNOTATION), F.lit(1)).alias("surface"),
        F.regexp_extract_all("text", F.lit(ANNOTATION), F.lit(2)).alias("note"),
    )
    before = tx.strip(F.substring_index("p.note", "@", 1))
    first = F.get(F.split(before, f"{tx.SPACE}+"), F.lit(0))
    surface = tx.normalize_token(F.col("p.surface"))
    return texts.select("source_id", F.explode(pairs).alias("p")).select(
        "source_id", surface.alias("surface"),
        F.coalesce(F.nullif(tx.normalize_token(first), F.lit("")), surface).alias("lemma"),
    ).where((F.col("surface") != "") & (F.col("lemma") != ""))


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10 on files; the source is the file's stem."""
    text = spark.read.text(path, wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*?)(\.[^./]*)?$", 1)
    return annotated_tokens(text.select(stem.alias("source_id"), F.col("value").alias("text")))


MAPPING_KEY = ["normalized_surface_form", "normalized_dictionary_lemma", "language_profile", "source_type"]


def mapping_rows(raw: DataFrame) -> DataFrame:
    """SRC-11: rows of a mapping file with defaults; a row without form or lemma is an error."""
    def value(name: str, default: str | None = None) -> Column:
        given = F.nullif(tx.strip(F.col(name)), F.lit("")) if name in raw.columns else F.lit(None).cast("string")
        return F.coalesce(given, F.lit(default)) if default is not None else given

    surface, lemma = value("surface_form"), value("dictionary_lemma")
    form = F.coalesce(value("normalized_surface_form"), tx.normalize_token(surface))
    lemma_form = F.coalesce(value("normalized_dictionary_lemma"), tx.normalize_token(lemma))
    checked = F.when(
        F.coalesce(form, F.lit("")).eqNullSafe("") | F.coalesce(lemma_form, F.lit("")).eqNullSafe("") | surface.isNull() | lemma.isNull(),
        F.raise_error(F.lit("mapping row without surface form or dictionary lemma")),
    ).otherwise(surface)
    return raw.select(
        checked.alias("surface_form"), form.alias("normalized_surface_form"),
        lemma.alias("dictionary_lemma"), lemma_form.alias("normalized_dictionary_lemma"), value("pos").alias("pos"),
        value("language_profile", "unknown").alias("language_profile"), value("mapping_type", "").alias("mapping_type"),
        value("source_type", "").alias("source_type"), value("source_key").alias("source_key"),
        value("confidence").cast("double").alias("confidence"), value("review_status", "approved").alias("review_status"),
        value("notes").alias("notes"),
    )


def upsert_mappings(old: DataFrame, new: DataFrame) -> DataFrame:
    """SRC-11: new rows replace old ones of the same natural key."""
    return old.join(new.select(*MAPPING_KEY).distinct(), MAPPING_KEY, "left_anti").unionByName(
        new.dropDuplicates(MAPPING_KEY), allowMissingColumns=True
    )


# Tagger output -----------------------------------------------------------------------

HEADER_WORDS = ("token", "form", "word", "surface", "lemma", "pos", "upos", "feats", "morph", "morph_features")


def tagger_predictions(lines: DataFrame) -> DataFrame:
    """SRC-13 on (file, block, line) in reading order: tab-separated tagger lines to predictions.

    The first line that names columns is the header; without one, columns are
    token, lemma, part of speech and features.  Blank lines end a sequence.
    ``columns`` holds every named column that has a value.
    """
    line = F.col("line")
    usable = lines.where(~F.ltrim(line).startswith("#"))
    cells = lambda x: F.transform(F.split(x, "\t"), lambda v: F.nullif(tx.strip(v), F.lit("")))
    lowered = lambda x: F.transform(cells(x), lambda v: F.lower(F.coalesce(v, F.lit(""))))
    # The head of a file is the first line of its first split that has one.
    told = usable.where(tx.strip(line) != "").withColumn("at", F.monotonically_increasing_id())
    first = told.groupBy("file", "block").agg(F.min_by("line", "at").alias("line")).groupBy("file").agg(F.min_by("line", "block").alias("line"))
    heads = first.select("file", lowered(line).alias("names")).where(F.arrays_overlap("names", F.array(*[F.lit(x) for x in HEADER_WORDS])))
    pieces = rn.runs(usable, F.when(tx.strip(line) == "", rn.BLANK).otherwise(rn.WORD))
    rows = pieces.join(heads, "file", "left").select("file", "run", "start", "names", F.posexplode("line_values").alias("pos", "line"))
    rows = rows.withColumns({"position": (F.col("start") + F.col("pos")).cast("int"), "parts": cells(line), "headed": F.col("names").isNotNull()})
    # The header is the first line of run 0; its run counts only when other lines follow it there.
    alone = rows.where("headed and run = 0").groupBy("file").agg((F.max("position") == 0).alias("alone"))
    rows = rows.where(~(F.col("headed") & (F.col("run") == 0) & (F.col("position") == 0))).join(alone, "file", "left")
    sequence = (F.col("run") - F.coalesce(F.col("alone"), F.lit(False)).cast("int")).cast("int")
    position = F.col("position") - (F.col("headed") & (F.col("run") == 0)).cast("int")

    def named(*options: str) -> Column:
        return F.coalesce(*[F.get("parts", F.when(F.array_position("names", o) > 0, F.array_position("names", o) - 1).cast("int")) for o in options])

    def col(place: int, *options: str) -> Column:
        return F.when(F.col("names").isNull(), F.get("parts", F.lit(place))).otherwise(named(*options))

    given = F.filter(F.arrays_zip(F.col("names").alias("k"), F.col("parts").alias("v")), lambda p: p["k"].isNotNull() & (p["k"] != "") & p["v"].isNotNull())
    last = lambda kept: F.map_from_entries(F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda q: q["k"] == p["k"])))
    return rows.select(
        "file", sequence.alias("sequence"), position.alias("position"),
        F.coalesce(col(0, "token", "form", "word", "surface"), F.lit("")).alias("token_surface"),
        col(1, "lemma").alias("raw_lemma"), col(2, "pos", "upos", "xpos").alias("raw_pos"),
        col(3, "feats", "morph", "morph_features").alias("raw_features"), F.when(F.col("headed"), tx.bind(given, last)).alias("columns"),
    )


def tagger_rows(lines: DataFrame) -> DataFrame:
    """SRC-13 on rows (file, line_no, line)."""
    return tagger_predictions(rn.table_lines(lines))


def read_tagger_output(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13 on files of any size, read in splits."""
    return tagger_predictions(rn.file_lines(spark, path))


def resplit(predictions: DataFrame, tokens: DataFrame) -> DataFrame:
    """SRC-13: one flat sequence is cut like the input's sequences when it has as many tokens as they have together."""
    wanted = tokens.groupBy("file", "sequence").agg(F.count("*").alias("size"))
    # One row a sequence of a file that came back flat.
    shape = wanted.groupBy("file").agg(F.count("*").alias("n_wanted"), F.sum("size").alias("all_wanted")).join(
        predictions.groupBy("file").agg(F.max("sequence").alias("last"), F.count("*").alias("all_got")), "file"
    )
    flat = shape.where("last = 0 and n_wanted > 1 and all_wanted = all_got").select("file")
    before = Window.partitionBy("file").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    begins = wanted.join(flat, "file", "left_semi").select("file", "sequence", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("begin"))
    places = tokens.select("file", "sequence", "position").join(begins, ["file", "sequence"]).select(
        "file", F.col("sequence").alias("to_sequence"), F.col("position").alias("to_position"), (F.col("begin") + F.col("position")).cast("int").alias("position")
    )
    moved = predictions.join(places, ["file", "position"]).withColumns({"sequence": F.col("to_sequence"), "position": F.col("to_position")})
    return predictions.join(flat, "file", "left_anti").unionByName(moved.select(predictions.columns))


def align_predictions(predictions: DataFrame, tokens: DataFrame) -> DataFrame:
    """SRC-13: predictions next to the input tokens; sequences of another length are flagged.

    Both tables carry file, sequence and position.
    """
    key = ["file", "sequence"]
    predictions = resplit(predictions, tokens)
    sizes = predictions.groupBy(*key).agg(F.count("*").alias("got")).join(
        tokens.groupBy(*key).agg(F.count("*").alias("wanted")), key, "right"
    )
    problem = F.when(F.coalesce("got", F.lit(0)) != F.col("wanted"), "token_count_mismatch")
    flags = sizes.select(*key, problem.alias("problem"))
    given = [c for c in ("raw_lemma", "raw_pos", "raw_features", "columns") if c in predictions.columns]
    return tokens.join(flags, key).join(
        predictions.drop("token_surface"), [*key, "position"], "left"
    ).withColumns({c: F.when(F.col("problem").isNull(), F.col(c)) for c in given})
