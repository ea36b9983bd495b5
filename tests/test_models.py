"""Encoders, scoring, work lists and writers."""

import pytest
from pyspark.sql import functions as F

from lexstrata.operators import models, sampling
from lexstrata.sources import sinks


def test_encoder_and_scores(spark):
    sents = spark.createDataFrame([(1, 0, "threat of war"), (1, 1, "peace talks"), (2, 0, "threat of war")], "doc_id long, idx int, sent string")
    enc = models.HashingEncoder(64).encode(sents, "sent").cache()
    rows = enc.collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-6 for r in rows) and rows[0].embedding == rows[2].embedding
    weights = {"threat": ([float(x) for x in rows[0].embedding], -0.5)}
    scores = models.score_sentences(enc, weights)
    got = {(r.doc_id, r.idx): r.threat for r in scores.collect()}
    assert got[1, 0] == got[2, 0] == 622 and got[1, 1] < got[1, 0]
    tone = {r.doc_id: r for r in models.doc_tone(spark.range(1, 4).withColumnRenamed("id", "doc_id"), scores, ["threat"]).collect()}
    assert tone[1].nsent == 2 and tone[3].nsent == 0 and tone[3].threat is None
    changed = sents.withColumn("sent", F.when(F.col("doc_id") == 2, "new").otherwise(F.col("sent")))
    assert models.current(scores, changed).count() == 2
    taught = models.PatternTeacher({"threat": "threat|war", "peace": "peace"}).label(sents, "sent").collect()
    assert taught[0].threat == 0.75 and taught[1].peace == 0.5
    assert models.needs_refit(131, 100, 0.3) and not models.needs_refit(129, 100, 0.3)


def test_work_lists(spark):
    df = spark.createDataFrame([("a", 1, "2024-01-03"), ("a", 2, "2024-01-02"), ("b", 9, "2024-01-01"), ("a", 7, "2024-01-01")], "k string, i int, d string")
    assert [r.i for r in sampling.round_robin(df, "k", "d", "i").collect()] == [1, 9, 2, 7]
    assert [(r.after, r.missing) for r in sampling.id_gaps(df, "i", "k").collect()] == [(2, 4)]
    assert sampling.balanced(df, ["k"], 2, "i").count() == 3
    assert sampling.packet_order(df, "i").count() == 4


def test_sinks(spark, tmp_path):
    post = spark.createDataFrame([("a", 0, 1), ("b", 1, 2)], "token string, bucket int, n int")
    sinks.write_buckets(post, f"{tmp_path}/b")
    assert spark.read.json(f"{tmp_path}/b").count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_buckets(post, f"{tmp_path}/b")
    assert sinks.manifest(spark, f"{tmp_path}/b").filter("file LIKE 'part-%'").count() == 2
    docs = spark.createDataFrame([("1", "c", "s")], "id string, country string, source string")
    with pytest.raises(ValueError):
        sinks.materialize(docs, spark.createDataFrame([("2",)], "id string"), f"{tmp_path}/m")
    sinks.materialize(docs, docs, f"{tmp_path}/m")
    builds = spark.createDataFrame([("b1",), ("b2",), ("b3",), ("b4",)], "name string")
    assert [r.name for r in sinks.prune(builds, 2, "b1").collect()] == ["b2"]
