"""Token counts kept as delta-maintained rollups.

A batch of changes (insert, revise, delete) is compared with the ledger of what each document
last counted. It becomes signed rows: minus the old count where there was one, plus the new
one. Their sums by source, language and tokenizer version are the batch's deltas; totals are
the sum of the deltas of all committed batches, so maintaining them never reads the corpus.

A batch writes its ledger rows and deltas to folders of its own and then its commit row, which
makes it count. A batch that is delivered again after its commit changes nothing; one that
failed before its commit is written anew in place. Batches are applied in the order of their
numbers; a number below the last commit that isn't committed is refused.

Defined cases: a null id is replaced by a hash of the text (see ``document_key``); several
changes of one document in a batch: the highest ``seq`` counts, ties by the larger count;
deleting an unknown document changes nothing; inserting a known one revises it; null source
and language are groups of their own; groups that fall to zero documents are left out; an
empty batch commits and changes nothing.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import arrays as ar
from lexloom.llm.token_files import encoder

GROUP = ("source", "lang", "tokenizer")
STATE = "source string, lang string, n_tokens long, alive boolean"


def document_key(key: str = "doc_id", text: str = "text") -> Column:
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce(text, F.lit("")), 256)))


@functools.lru_cache(4)
def _counter(path: str, pattern: str):
    """Function from a text to its number of tokens."""
    if path.endswith(".json"):
        made = encoder(path)
        return lambda text: len(made.encode(text))
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    made = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(made.encode_ordinary(text))


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], pattern: str, text: str = "text") -> DataFrame:
    """doc_key, source, lang, tokenizer, n_tokens: a row for each document and tokenizer version.

    ``tokenizers`` maps a version's name to a vocabulary file that every executor can open;
    ``pattern`` splits texts for rank files. A null text has no tokens.
    """
    ar.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("t").to_pylist()]
            for name, path in tokenizers.items():
                counts = pa.array(np.fromiter(map(_counter(path, pattern), texts), np.int64, len(texts)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_key", "source", "lang")), pa.array([name] * len(texts)), counts], ["doc_key", "source", "lang", "tokenizer", "n_tokens"])

    rows = docs.select(document_key(text=text).alias("doc_key"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "doc_key string, source string, lang string, tokenizer string, n_tokens long")


class Rollups:
    """The tables of one rollup under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._write(spark.createDataFrame([], "n_changes long"), "commits", 0)
        self._write(spark.createDataFrame([], f"doc_key string, tokenizer string, {STATE}"), "ledger", 0)
        self._write(spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long"), "deltas", 0)

    def _write(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={batch}")

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.folder}/{table}")

    def committed(self) -> DataFrame:
        """batch and n_changes; one row a commit."""
        return self._read("commits", "n_changes long")

    def ledger(self) -> DataFrame:
        """What each document counted last, by committed batches."""
        rows = self._read("ledger", f"doc_key string, tokenizer string, {STATE}").join(self.committed().select("batch"), "batch")
        return rows.groupBy("doc_key", "tokenizer").agg(F.max_by(F.struct("source", "lang", "n_tokens", "alive"), "batch").alias("old"))

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Applies a batch; False if it was committed before.

        ``changes``: op ('insert', 'revise', 'delete'), doc_key, tokenizer, source, lang,
        n_tokens, seq; a delete needs only the key, tokenizer and seq.
        """
        done, later = self.committed().agg(F.count_if(F.col("batch") == batch) > 0, F.count_if(F.col("batch") > batch) > 0).first()
        if done and batch > 0:
            return False
        if later or batch < 1:
            raise ValueError(f"batch {batch} comes after a later commit")
        state = F.struct("source", "lang", "n_tokens", (F.col("op") != "delete").alias("alive"))
        last = changes.groupBy("doc_key", "tokenizer").agg(F.max_by(state, F.struct("seq", F.coalesce("n_tokens", F.lit(-1)))).alias("new"))
        self._write(last.select("doc_key", "tokenizer", "new.*"), "ledger", batch)
        mine = self.spark.read.parquet(f"{self.folder}/ledger/batch={batch}").select("doc_key", "tokenizer", F.struct("source", "lang", "n_tokens", "alive").alias("new"))
        both = mine.join(self.ledger(), ["doc_key", "tokenizer"], "left")
        signed = both.select("tokenizer", F.inline(F.array(
            F.struct(F.lit(-1).alias("sign"), F.col("old").alias("state")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("state"))
        ))).where("state.alive")
        sums = signed.groupBy("state.source", "state.lang", "tokenizer").agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.coalesce("state.n_tokens", F.lit(0))).alias("n_tokens"))
        self._write(sums, "deltas", batch)
        self._write(mine.agg(F.count("*").alias("n_changes")), "commits", batch)
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of all committed batches."""
        deltas = self._read("deltas", "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        return deltas.join(self.committed().select("batch"), "batch").groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0")
