"""The pipeline's stages on the smallest tables, against what each stage promises."""

import re

import corpus_pipeline
from noticelake.llm import neardup
from noticelake.workspace import stored

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), f"test-{name}")
        frames.append(docs)
        counts.append(docs.count())
        assert docs.columns[: len(columns)] == columns
    toxic, unique, clean, mixed, sharded = frames[1:]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    # every near-duplicate class of what the first stage kept has one survivor
    classes = {r["class_id"] for r in neardup.near_duplicates(toxic).collect()}
    assert {r["doc_id"] for r in unique.select("doc_id").collect()} == classes
    # no benchmark item is left, word for word
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [plain(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for r in clean.collect():
        assert not any(i in plain(r["text"]) for i in items)
    # copies of the mix are copies of what the third stage kept
    assert {r["doc_id"] for r in mixed.select("doc_id").collect()} <= {r["doc_id"] for r in clean.select("doc_id").collect()}
    assert mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    assert {r["shard"] for r in sharded.select("shard").collect()} == set(range(8))


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 0
