"""Runs of words that texts share, against plain loops; texts are taken apart once."""

from __future__ import annotations

import random
import re

import pytest

from lexmill.operators import retrieval


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shared_grams(spark, n):
    rng = random.Random(n)
    some = lambda: "".join(rng.choice(["alfa", "Beta", "7", "gama2", "é", "K"]) + rng.choice([" ", ", ", "\n", "_", " "]) for _ in range(rng.randint(0, 25)))
    docs = [(i, some()) for i in range(200)] + [(200, None), (201, ""), (202, " -- "), (203, "a b c d e f g"), (204, "h a b c d e f g h")]
    asked = [(i, some()) for i in range(30)] + [(30, None), (31, ""), (32, "A b,c d e f g h"), (33, "g h a b c d e f")]
    grams = lambda text: {tuple(w[p : p + n]) for w in [re.findall("[a-z0-9]+", (text or "").lower())] for p in range(len(w) - n + 1)}
    want = {(q, d) for q, a in asked for d, b in docs if grams(a) & grams(b)}
    pairs = retrieval.shared_grams(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), "query_id", "doc_id", n)
    got = [(r.query_id, r.doc_id) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "lambda" not in pairs._jdf.queryExecution().optimizedPlan().toString()  # no interpreted step for each run of each text


def test_runs_end_with_their_text():
    import pyarrow as pa

    texts = ["a b c", "", "d e", "f g h i", "..."] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    for slice_bytes in (1, 7, 1 << 20):
        rows = [r for b in retrieval._runs(3, slice_bytes)(iter([batch.slice(0, 0), batch])) for r in b.to_pylist()]
        assert [r["id"] for r in rows] == [i for i, x in enumerate(texts) for _ in range(max(0, len(re.findall("[a-z]", x)) - 2))]
        assert len({(r["h"], r["k"]) for r in rows}) == 3


def test_texts_to_score_are_taken_apart_once(spark, tmp_path):
    spark.createDataFrame([(1, "alfa beta"), (2, ""), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(1, "alfa"), (2, None)], "query_id long, text string").write.parquet(f"{tmp_path}/asked")
    scores = retrieval.lexical_scores(spark.read.parquet(f"{tmp_path}/asked"), spark.read.parquet(f"{tmp_path}/docs"))
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "size(regexp_extract_all(" not in plan  # a test of the number of words, run before the texts are dealt
    assert [(r.query_id, r.doc_id) for r in scores.collect()] == [(1, 1)]


def test_short_texts_are_dealt_by_the_pairs_they_make(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "TASK_PAIRS", 60)
    spark.createDataFrame([(q, "a b") for q in range(6)], "query_id long, text string").write.parquet(f"{tmp_path}/asked")
    scores = retrieval.lexical_scores(spark.read.parquet(f"{tmp_path}/asked"), spark.createDataFrame([(d, "a") for d in range(400)], "doc_id long, text string"))
    assert scores.rdd.getNumPartitions() == 40 and scores.count() == 2400
