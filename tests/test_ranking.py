"""Greedy diversity has no SQL: against a plain loop."""

from __future__ import annotations

import random

from lexmill.operators import ranking


def _plain(rows, k, weight, cap):
    rows = sorted(rows, key=lambda r: (-r[2], r[1]))[: max(2 * k, 100)]
    sets = {r[1]: set(r[3].lower().split()) for r in rows}
    low, high = min(r[2] for r in rows), max(r[2] for r in rows)
    chosen = []
    while len(chosen) < k:
        free = [r for r in rows if r not in chosen and sum(c[4] == r[4] for c in chosen) < cap]
        if not free:
            break
        near = lambda r: max((len(sets[r[1]] & sets[c[1]]) / len(sets[r[1]] | sets[c[1]]) for c in chosen), default=0.0)
        value = lambda r: weight * ((r[2] - low) / (high - low) if high > low else 1.0) + (1 - weight) * (1 - near(r))
        chosen.append(max(free, key=lambda r: (value(r), -rows.index(r))))
    return [c[1] for c in chosen]


def test_diversified(spark):
    rng = random.Random(5)
    rows = [(q, q * 100 + i, rng.randrange(64) / 64, " ".join(rng.choice("abcdefgh") for _ in range(6)), rng.choice("xyz")) for q in (1, 2, 3) for i in range(20)]
    rows.append((4, 400, 0.5, "a b", "x"))
    df = spark.createDataFrame(rows, "query_id long, doc_id long, score double, text string, document string")
    found = ranking.diversified(df, 8, 0.75, 3).orderBy("query_id", "place").collect()
    for q in (1, 2, 3, 4):
        assert [r.doc_id for r in found if r.query_id == q] == _plain([x for x in rows if x[0] == q], 8, 0.75, 3)
    assert ranking.diversified(df.limit(0), 8).count() == 0


def test_newer_documents_lower_a_score(spark):
    from pyspark.sql import functions as F

    from lexmill.operators import ranking

    rows = spark.createDataFrame([(1, "current", 0, False, False), (2, "current", 1, False, False), (3, "current", 1, True, False), (4, "revoked", 1, False, False), (5, "historical", 1, True, False), (6, "revoked", 0, False, True)], "k int, status string, n_newer int, newer_ranked boolean, replaces boolean")
    assert {r.k: r.s for r in rows.select("k", ranking.relationship_score(F.lit(1.0)).alias("s")).collect()} == {1: 1.0, 2: 0.85, 3: 0.85, 4: 0.7, 5: 0.6, 6: 1.05}


def test_coverage_counts_all_claims(spark):
    from lexmill.operators import claims

    answers = spark.createDataFrame([(1, "upah dibayar tepat waktu"), (2, ""), (3, "cuti tahunan"), (4, None)], "k int, answer string")
    said = spark.createDataFrame([(1, "upah minimum"), (1, "waktu kerja"), (2, "upah")], "k int, claim string")
    got = {r.k: r.coverage for r in claims.coverage(answers, said, ["k"]).collect()}
    assert got[2] == got[3] == got[4] == 0.0 and 0 < got[1] < 1


def test_nearest_over_shards_and_groups(spark):
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from lexmill.operators import retrieval, vectors

    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(120)] + [(200, None), (201, [0.0] * 4), (202, [1.0, 2.0]), (203, [None, 1.0, 0.0, 0.0]), (None, [1.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)
    asked = table.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    found = vectors.nearest(asked, table, "query_id", "vec_id", "v", 7, group=4, shard=25)
    got = {}
    for r in retrieval.top_k(found, F.round("score", 9), "vec_id", 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    full = {i: np.array([x or 0.0 for x in v]) for i, v in rows if i is not None and v is not None and len(v) == 4}
    for q, v in full.items():
        if q % 10 == 0:
            near = sorted(((round(float(v @ u) / (np.linalg.norm(v) * np.linalg.norm(u)), 9) if np.linalg.norm(v) and np.linalg.norm(u) else 0.0, i) for i, u in full.items()), key=lambda x: (-x[0], x[1]))[:7]
            assert [(n, i) for n, i, _ in sorted(got[q])] == [(n + 1, i) for n, (_, i) in enumerate(near)]
    assert vectors.nearest(asked.limit(0), table, "query_id", "vec_id", "v", 3).count() == 0


def test_scores_are_summed_in_parts_that_grow_with_the_texts(spark, tmp_path, monkeypatch):
    import math
    import re
    from collections import Counter

    from pyspark.sql import functions as F

    from lexmill.operators import retrieval

    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices("alfa beta gama delta dan".split(), k=rng.randint(0, 30)))) for i in range(300)] + [(300, None)]
    asked = [(1, "alfa alfa dan"), (2, "gama"), (3, "omega")]
    monkeypatch.setattr(retrieval, "TASK_BYTES", 500)
    spark.createDataFrame(asked, "query_id long, text string").write.parquet(f"{tmp_path}/asked")  # of known size, as tables are
    scores = retrieval.lexical_scores(spark.read.parquet(f"{tmp_path}/asked"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert scores.rdd.getNumPartitions() == -(-sum(len(x or "") for _, x in docs) // 500)
    want = {}
    for q, question in asked:
        for d, text in docs:
            tf = Counter(re.findall(r"[a-z0-9_]+", text or ""))
            total = sum(1 + math.log1p(tf[w]) for w in question.split() if w in tf)
            if total:
                want[q, d] = total / math.sqrt(len(tf))
    got = {(r.query_id, r.doc_id): r.score for r in scores.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # the ranks that measures need, and the scale, without sorting or gathering a query's documents
    rounded = scores.selectExpr("query_id", "doc_id", "round(score, 9) as score")
    truth = spark.createDataFrame([(q, d) for q, d in want if d % 37 == 5] + [(3, 1)], "query_id long, doc_id long")
    some = retrieval.relevant_ranks(rounded, truth, 5)
    every = retrieval.ranked(rounded, "score", "doc_id", "rank")
    measured = lambda r: sorted(map(tuple, retrieval.ranking_metrics(r, truth).collect()))
    assert measured(some) == measured(every)
    scaled = retrieval.min_max(scores, "score", "scaled")
    assert "Window" not in scaled._jdf.queryExecution().toString()
    assert {r.query_id: (r.low, r.high) for r in scaled.groupBy("query_id").agg(F.min("scaled").alias("low"), F.max("scaled").alias("high")).collect()} == {1: (0.0, 1.0), 2: (0.0, 1.0)}
