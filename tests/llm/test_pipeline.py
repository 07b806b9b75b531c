"""The pipeline's stages, each judged on its own input."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm.common import stage
from riskloom.llm.tokens import encode
from tests.llm.test_operators import brute_fingerprint

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    inputs, outputs = [], []
    for name, function in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = stage(function(spark, docs, SF), name)
        outputs.append(docs)
    assert all(o.columns == columns for o in outputs[:-1])
    good, exact, near, mixed, packed = outputs

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = inputs[0].join(labels, "doc_id").join(good.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left")
    rate = {r["quality"]: r["rate"] for r in seen.groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("rate")).collect()}
    assert rate[1] > 0.98 and rate[0] < 0.2

    texts = good.select("text").toPandas().text
    assert Counter(exact.toPandas().text) == Counter(texts.unique())

    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in exact.collect()}
    ids = sorted(fps)
    linked = {b for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2}
    assert {r["doc_id"] for r in near.collect()} >= set(ids) - linked
    assert near.count() + len(linked) == exact.count()

    taken = Counter(r["doc_id"] for r in mixed.collect())
    assert set(taken) <= {r["doc_id"] for r in near.select("doc_id").collect()} and max(taken.values()) <= 2
    tokens = sum(len(encode(r["text"])) + 1 for r in mixed.collect())
    assert packed.agg(F.sum("length")).first()[0] == tokens
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
    assert packed.select("sequence_id").distinct().count() <= -(-tokens // 1024) * 1.02 + 1


def test_run_is_the_registered_query(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
