"""The registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import session
from lexloom.llm import licences, line_spread, phrases, repetition


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return session.tune(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


#: Most ids (16 bytes each) that a query broadcasts; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000


def _vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; the package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Start, length and checksum of every document's ids, read back from the token files."""
    from lexloom.llm.token_files import read_documents, write_tokens

    docs = table(spark, folder, "documents")
    return read_documents(write_tokens(docs, session.shared_dir(spark), _vocabulary("byte_bpe_50k.json")))


def op2_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that ten or more sources show."""
    from lexloom.llm.line_spread import without_boilerplate

    return without_boilerplate(table(spark, folder, "documents"))


def op3_token_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """Token totals after inserts of all documents, deletes of toxic ones and revisions of poor ones.

    The revised texts have their white space reduced to single blanks. Two batches are
    delivered twice.
    """
    import uuid

    import public_tokenizers

    from lexloom.llm import token_rollups as tr

    versions = {"byte_bpe_50k@1": _vocabulary("byte_bpe_50k.json"), "byte_bpe_multi_50k@1": _vocabulary("byte_bpe_multi_50k.tiktoken")}
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    store = tr.Rollups(spark, f"{session.shared_dir(spark)}/rollups-{uuid.uuid4().hex[:12]}")

    def counted(rows: DataFrame, op: str) -> DataFrame:
        return tr.count_tokens(rows, versions, public_tokenizers.PATTERN).select("*", F.lit(op).alias("op"), F.lit(0).alias("seq"))

    def labelled(rule: str) -> DataFrame:
        """Ids of labelled documents: broadcast while they are few, so that texts aren't shuffled to pick some."""
        ids = labels.where(rule).select("doc_id").distinct()
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    store.apply(1, counted(docs, "insert"))
    toxic = docs.join(labelled("toxic = 1"), "doc_id").select(tr.document_key().alias("doc_key"), F.explode(F.array(*map(F.lit, versions))).alias("tokenizer"))
    gone = toxic.select(F.lit("delete").alias("op"), "*", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("n_tokens"), F.lit(0).alias("seq"))
    store.apply(2, gone)
    poor = docs.join(labelled("quality = 0 and toxic = 0"), "doc_id").withColumn("text", F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    revised = counted(poor, "revise")
    store.apply(3, revised)
    store.apply(2, gone)
    store.apply(3, revised)
    return store.totals()


def op4_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that each document gives to a mix of all sources by weight 5, 2, 1."""
    from lexloom.llm import pareto_mix as mix

    rows = mix.one_by_one(mix.sample(table(spark, folder, "documents")))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op5_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, repetition coverage and verdict of every document."""
    return repetition.repetition(table(spark, folder, "documents"))


def op6_maximal_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the strings of 50 bytes that a smaller doc_id has too."""
    from lexloom.llm.repeats import without_repeats

    got = without_repeats(table(spark, folder, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_licence_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical digest, licence and licence notices of every document."""
    from lexloom.llm.licences import catalogue, scan

    return scan(table(spark, folder, "documents"), catalogue(spark))


def op8_simhash_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the window that is most like it."""
    from lexloom.llm.decontaminate import contaminated

    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_golay_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    from lexloom.llm.golay import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


def op10_sampled_splitters(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document, shards of nearly equal bytes."""
    from lexloom.llm.splitters import assign

    docs = table(spark, folder, "documents").select("doc_id", "text")
    got = assign(docs, carry=("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")))
    return got.select(
        "row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_nb_svm(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    from lexloom.llm.quality_model import classify

    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest repair and its digest of every conversation, after a fixed damage."""
    from lexloom.llm import turn_repair as tr

    rows = table(spark, folder, "conversations")
    placed = session.save(tr.ordered(tr.damaged(rows)), "turns")
    facts = tr.facts_of(placed)
    sums = tr.digests(placed, facts).withColumnRenamed("c", "d")
    whole = facts.join(sums, F.col("c").eqNullSafe(F.col("d")))
    ids = rows.select("conv_id").distinct()
    got = ids.join(whole, ids["conv_id"].eqNullSafe(whole["c"]), "left")
    numbers = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return got.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The best phrases of every language."""
    from lexloom.llm.phrases import collocations

    return collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files, op2_line_spread, op3_token_rollups, op4_pareto_mix, op5_repetition, op6_maximal_repeats, op7_licence_digests, op8_simhash_windows, op9_golay_simhash,
        op10_sampled_splitters, op11_nb_svm, op12_turn_repair, op13_collocations,
    )
}
ORACLES: dict[str, str] = {"op2_line_spread": line_spread.SQL, "op5_repetition": repetition.sql(), "op7_licence_digests": licences.sql(), "op13_collocations": phrases.SQL}
