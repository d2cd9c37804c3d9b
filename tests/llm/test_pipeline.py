"""The pipeline's stages: columns stay, decisions take effect, odd rows pass through."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_reduce_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = [(None, None, None, None, None), (10**9, "", "en", None, 0), (10**9 + 1, "word " * 3, None, "s", 15)]
    now = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("score", F.lit("clash")).withColumn("n", F.lit(1))
    counts = [now.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, FOLDER)
        if name != "packing":
            assert out.columns == now.columns, name
        now = spark.createDataFrame(out.collect(), out.schema)
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 100
    assert counts[1] < counts[0] and counts[3] < counts[2]


def test_run_gives_one_row_per_surviving_document(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert len({r.doc_id for r in rows}) == len(rows) > 100


def test_near_copies_leave_one(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    docs = spark.createDataFrame([(i, text + " tail" * (i % 2), "en", "s", 1) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.minhash_near_dedup(spark, docs, FOLDER).collect()] == [0]
