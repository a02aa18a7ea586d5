"""Nearest neighbours: repeated ids, ties, odd vectors, the SQL on the tables, and recall of wider factors."""

import random

import duckdb
import numpy as np
import pytest

from lexmill.llm import ann, queries, sql

FOLDER = "/root/testdata/sf0.001"


def plain(rows, every, k):
    """By the contract: each id's best vector against each of the query's, in double precision."""
    valid = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    best = {}
    for q, u in valid:
        if q % every == 0:
            for i, v in valid:
                if i != q and len(u) == len(v):
                    s = float(ann.cosine(u[None], v[None])[0])
                    best[q, i] = max(s, best.get((q, i), -2))
    out = {}
    for (q, i), s in best.items():
        out.setdefault(q, []).append((-s, i))
    return {q: [i for _, i in sorted(v)[:k]] for q, v in out.items()}


def found(table, **more):
    got = {}
    for r in ann.nearest_to_every(table, **more).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    return {q: [i for _, i in sorted(v)] for q, v in got.items()}


@pytest.mark.parametrize("repeats", ["equal", "different", "both", "none"])
def test_repeated_ids_leave_room_for_others(spark, repeats):
    rng = random.Random(9)
    vector = lambda near=0.0: [near + rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, vector()) for i in range(40)]
    close = rows[0][1]
    if repeats in ("equal", "both"):
        rows += [(1001, [x + 0.01 for x in close])] * 8 + [(0, close)] * 7
    if repeats in ("different", "both"):
        rows += [(1003, [x + rng.gauss(0, 0.02) for x in close]) for _ in range(30)] + [(0, vector()) for _ in range(3)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0] * 7), (2004, [None] + [1.0] * 7), (2005, [float("nan")] + [1.0] * 7), (None, close)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = found(table, every=5)
    assert got == plain(rows, 5, 5)
    assert all(len(v) == 5 and len(set(v)) == 5 for v in got.values())


def test_ties_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (7, [2.0, 0.0]), (3, [0.5, 0.0]), (5, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(table) == {0: [3, 7, 5]}
    assert found(table.filter("vec_id = 0")) == {} and found(table.limit(0)) == {}
    many = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)] * 3, "vec_id long, embedding array<double>").repartition(5)
    assert found(many, every=100) == {0: [1, 2, 3, 4, 5], 100: [0, 1, 2, 3, 4], 200: [0, 1, 2, 3, 4]}


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    want = sorted(con.execute(sql.NEAREST).fetchall())
    got = sorted(tuple(r) for r in queries.op8_nearest(spark, FOLDER).select("query_id", "rank", "vec_id", "score").collect())
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(got, want, strict=True))


def test_wider_factors_keep_most(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.3).tolist()) for i in range(6000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    exact = found(table)
    for factor in (1.0, 1.5):
        near = found(table, factor=factor)
        recall = sum(len(set(exact[q]) & set(near[q])) for q in exact) / (5 * len(exact))
        assert recall >= (1.0 if factor == 1.0 else 0.9), factor
