"""Page text sources (SRC-1, SRC-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexloom.functions import text as tx


def read_text_documents(spark: SparkSession, path: str, owner_id: str) -> DataFrame:
    """SRC-1 for plain files: one document per file, named by its content."""
    return spark.read.text(path, wholetext=True).select(
        tx.content_hash(F.col("value").cast("binary")).alias("document_id"),
        F.lit(owner_id).alias("owner_id"),
        tx.document_title(F.lit(None).cast("string"), F.col("_metadata.file_path")).alias("title"),
        F.col("value").alias("text"),
    )


def pages_from_text(documents: DataFrame, lines_per_page: int = 20) -> DataFrame:
    """SRC-1: cut already-extracted text into numbered pages and tidy each (SCL-2).

    Pages are exploded where the document is; nothing is shuffled.
    """
    return (
        documents.select("owner_id", "document_id", F.posexplode(page_array(F.col("text"), lines_per_page)).alias("i", "page"))
        .select(
            "owner_id",
            "document_id",
            F.concat_ws(":", "document_id", F.col("i") + 1).alias("page_id"),
            (F.col("i") + 1).alias("page_number"),
            tx.clean_extracted_text(F.col("page")).alias("raw_text"),
        )
    )


def page_array(text: Column, lines_per_page: int) -> Column:
    return tx.bind(
        F.split(text, "\n"),
        lambda lines: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / lines_per_page).cast("int")),
            lambda i: F.concat_ws("\n", F.slice(lines, i * lines_per_page + 1, F.lit(lines_per_page))),
        ),
    )


def text_layer_pages(pages: DataFrame) -> DataFrame:
    """SRC-2: pages whose text can be used as it is."""
    return pages.where(tx.has_text_layer(F.col("raw_text")))


def ocr_needed_pages(pages: DataFrame) -> DataFrame:
    """SRC-2: pages that have to be recognized from their image first."""
    return pages.where(~tx.has_text_layer(F.col("raw_text")))
