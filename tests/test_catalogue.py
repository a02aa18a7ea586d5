"""Each query of the catalogue against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from lexmill.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted(columns), sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, db, name):
    got = catalogue.queries()[name](spark, FOLDER)
    want = db.execute(catalogue.oracle_sql()[name])
    columns, names = rows([d[0] for d in want.description], want.fetchall())
    mine, values = rows(got.columns, [tuple(r) for r in got.collect()])
    assert mine == columns
    assert len(values) == len(names)
    for a, b in zip(values, names, strict=True):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 1e-4) for x, y in zip(a, b, strict=True)), (a, b)


def test_budget_stops_at_the_first_misfit(spark):
    from pyspark.sql import functions as F

    from lexmill.operators.ordering import while_budget_lasts

    df = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 1), (2, 1, 1)], "k int, o int, c int")
    kept = while_budget_lasts(df, ["k"], [F.col("o")], F.col("c"), 10).collect()
    assert sorted((r.k, r.o) for r in kept) == [(1, 1), (2, 1)]


def test_calendar_follows_the_events(spark, tmp_path):
    from pyspark.sql import functions as F

    moved = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts") + F.expr("INTERVAL 400 DAYS"))
    moved.write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{FOLDER}/region.parquet").write.parquet(f"{tmp_path}/region.parquet")
    got = catalogue.queries()["jn_full_dict_merge"](spark, str(tmp_path)).collect()
    assert sum(r.requests for r in got) == moved.count()
    assert (min(r.day for r in got), max(r.day for r in got)) == ("2025-02-02", "2025-03-08")


def test_threshold_one_refuses_all(spark, tmp_path):
    spark.createDataFrame([(1, 100), (2, 400)], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [tuple(r) for r in catalogue.queries()["e_threshold"](spark, str(tmp_path)).collect()] == [(1.0, 1.0)]


def test_near_vectors_are_no_duplicates(spark, tmp_path):
    spark.createDataFrame([(1, [0.501, 0.25]), (2, [0.502, 0.25]), (3, [0.5010000001, 0.25])], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [(r.first_id, r.copies) for r in catalogue.queries()["st_dup_vectors"](spark, str(tmp_path)).collect()] == [(1, 2)]
