"""The stages one after another, each judged on its own input."""

import collections

import corpus_pipeline
from lexloom.llm import decontaminate, pareto_mix, repetition
from test_shingle_join import leads

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.session.save(stage(spark, docs, FOLDER), f"test-{name}")
        kept[name] = collections.Counter(r.doc_id for r in docs.collect())
        if name != "sharding":
            assert docs.columns == columns
        ids = collections.Counter(r.doc_id for r in before.collect())
        if name == "quality":
            want = {r.doc_id for r in repetition.repetition(before).where("kept").collect()}
        elif name == "near_dedup":
            want = set(leads([(r.doc_id, r.text) for r in before.collect()])[0])
        elif name == "decontamination":
            hit = {r.doc_id for r in decontaminate.contaminated(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
            want = set(ids) - hit
            assert hit
        elif name == "mixing":
            got = pareto_mix.sample(before).selectExpr("id", "whole + extra AS n").where("n > 0").collect()
            assert kept[name] == {r.id: r.n for r in got}
            continue
        else:
            assert kept[name] == ids and docs.columns == [*columns, "size", "shard", "slot"]
            load = collections.Counter()
            for r in docs.collect():
                load[r.shard] += r["size"]
            assert len(load) == 16 and max(load.values()) < 1.2 * min(load.values())
            continue
        assert kept[name] == dict.fromkeys(want, 1) and set(want) < set(ids)


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
