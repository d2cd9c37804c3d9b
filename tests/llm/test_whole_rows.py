"""No row is lost where ids or captures repeat, and columns of any name pass the pipeline's stages."""

import random

from pyspark.sql import functions as F

from tessera.llm import near_dedup, pii, rules, topk, url_filter


def test_every_row_of_a_repeated_id_is_a_candidate(spark):
    rows = [(0, [1, 1]), (1, [0, 1]), (1, [3, 3]), (2, [2, 2]), (2, [2, 2]), (0, [-1, 0]), (0, [1, 1])]
    vectors = spark.createDataFrame(rows, "vec_id long, vec array<long>")
    found = [tuple(r) for r in topk.top_k(vectors, vectors.filter("vec_id = 0"), k=3).collect()]
    assert sorted(found) == sorted([
        (0, 1, 1, 6), (0, 2, 2, 4), (0, 3, 2, 4),  # asked with [1, 1], which stands twice
        (0, 1, 1, 0), (0, 2, 2, -2), (0, 3, 2, -2),  # asked with [-1, 0]
    ])


def test_repeated_captures_stay(spark):
    at = F.to_timestamp_ntz(F.lit("2024-01-05 00:00:00"), F.lit("yyyy-MM-dd HH:mm:ss"))
    captures = spark.createDataFrame([(1, "http://a.b.c/x"), (1, "http://a.b.c/x"), (2, None)], "page_id long, url string").withColumn("fetched_at", at)
    entries = spark.createDataFrame([("b.c", "adult", True)], "pattern string, category string, listed boolean").withColumn("since", at)
    found = sorted((r.page_id, r.blocked, r.n_active) for r in url_filter.filter_captures(captures, entries).collect())
    assert found == [(1, True, 1), (1, True, 1), (2, False, 0)]


def test_different_texts_of_one_id_stay(spark):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    a, b, c = text(), text(), text()
    rows = [(7, a), (7, b), (7, a), (9, b + " more"), (8, c), (10, c), (None, c), (11, None), (11, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    found = sorted((str(r.doc_id), r.text) for r in kept.collect() if r.doc_id != 11)
    assert found == sorted([("7", a), ("7", b), ("8", c), ("None", c)])
    assert kept.filter("doc_id = 11").count() == 1


def test_stages_pass_any_columns(spark):
    rows = [(i, "plain words " * 60, "en", "s", 1, {"a": i}, "call me", [1.5]) for i in range(30)] + [(99, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_words long, x0 map<string,int>, __doc0 string, list array<double>"
    docs = spark.createDataFrame(rows, schema)
    kept = rules.keep_sound(docs)
    assert kept.schema == docs.schema or kept.columns == docs.columns
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.filter("doc_id = 99 and text is null").count() == 1
    assert out.filter("x0['a'] = 3 and list[0] = 1.5").count() == 1
