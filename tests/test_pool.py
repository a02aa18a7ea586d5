"""The pool of ranked documents that many queries share: what meets a shuffle on its way."""

from __future__ import annotations

import re

from lexmill.plans import ranking
from lexmill.plans.registry import Tables


def _above(plan: str, scan: str) -> list[str]:
    """The nodes above the first line that matches, from it upwards."""
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if re.search(scan, line))
    place, found = re.search(r"\w|\*", lines[at]).start(), []
    for line in reversed(lines[:at]):
        start = re.search(r"\w|\*", line)
        if start and start.start() < place:
            place = start.start()
            found.append(line)
    return found


def test_texts_that_no_query_ranks_are_not_shuffled(spark, monkeypatch):
    plans, stored = {}, ranking.stored

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(ranking, "stored", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "128k")  # less than the smallest documents
    try:
        pool = ranking._pool(Tables(spark, "/root/testdata/sf0.001"))
        assert pool.count() == pool.select("query_id", "doc_id").distinct().count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    nodes = _above(plans["pool"], r"FileScan parquet \[doc_id#\d+L?,text#")
    shuffled = next((i for i, node in enumerate(nodes) if "Exchange" in node), len(nodes))
    assert any("LeftSemi" in node for node in nodes[:shuffled]), plans["pool"]


def test_relevant_pairs_are_marked_where_scores_are_made(spark, tmp_path):
    import random

    from lexmill.operators import retrieval

    rng = random.Random(7)
    docs = [(i, " ".join(rng.choices(["alfa", "beta", "gama"], k=rng.randint(0, 9)))) for i in range(900)]
    asked = [(1, "alfa"), (2, "gama beta"), (3, "omega")]
    truth = sorted({(rng.randint(1, 3), rng.randrange(2000)) for _ in range(3000)})
    spark.createDataFrame(asked, "query_id long, text string").write.parquet(f"{tmp_path}/asked")
    spark.createDataFrame(truth, "query_id long, doc_id long").write.parquet(f"{tmp_path}/truth")
    scores = retrieval.lexical_scores(spark.read.parquet(f"{tmp_path}/asked"), spark.createDataFrame(docs, "doc_id long, text string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "6k")  # more than the questions, less than the truth
    try:
        marked = retrieval.marked(scores, spark.read.parquet(f"{tmp_path}/truth"))
        got = {(r.query_id, r.doc_id): r.relevant for r in marked.collect()}
        plan = marked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    words = {d: set(text.split()) for d, text in docs}
    assert got == {(q, d): (q, d) in set(truth) for q, text in asked for d in words if words[d] & set(text.split())}
    assert "SortMergeJoin" in plan and "LeftOuter" in plan
    joined = plan[plan.index("LeftOuter") :]
    assert "REPARTITION_BY_NUM" in joined[joined.index("Exchange") :].split("\n")[0], plan  # the first shuffle below is that of the texts


def test_terms_meet_where_the_texts_lie_below_any_broadcast_limit(spark, tmp_path, monkeypatch):
    from lexmill.operators import retrieval

    docs = spark.createDataFrame([(i, f"alfa w{i % 50}") for i in range(300)], "doc_id long, text string")
    spark.createDataFrame([(1, "alfa w7"), (2, "w7 w8 w8")], "query_id long, text string").write.parquet(f"{tmp_path}/asked")
    asked = spark.read.parquet(f"{tmp_path}/asked")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = retrieval.lexical_scores(asked, docs)
        plan = scores._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(tuple, scores.collect()))
        monkeypatch.setattr(retrieval, "SENT_TERMS", 0)
        many = sorted(map(tuple, retrieval.lexical_scores(asked, docs).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    assert [r[:2] for r in rows] == [r[:2] for r in many] and len(rows) == 312
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(rows, many, strict=True))
