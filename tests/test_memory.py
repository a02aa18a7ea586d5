"""Remembered requests, turns and summaries: literals, and streams with restarts against tables."""

import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import memory
from lexmill.operators import turns
from lexmill.streaming import keyed


def test_redaction(spark):
    cases = {"tulis ke a.b@c.co.id ya": ("tulis ke [REDACTED_EMAIL] ya", 1), "NIK 1234567890123456": ("NIK [REDACTED_ID]", 1), "hp 0812-3456-7890": ("hp [REDACTED_PHONE]", 1), "api key: abcdefgh12 dan token=zzzzzzzzz": ("api key [REDACTED_SECRET] dan token [REDACTED_SECRET]", 2), "pasal 15": ("pasal 15", 0), None: (None, 0)}
    for text, want in cases.items():
        got = spark.createDataFrame([(text,)], "x string").select(memory.redacted_memory(F.col("x")).alias("y")).first().y
        assert tuple(got) == want


def test_remembered_context(spark):
    turn = lambda q, t, d: (q, t, d, [], ["Judul"], "m1")
    schema = "q string, t array<struct<question:string,topics:array<string>,document_ids:array<string>,articles:array<string>,titles:array<string>,source:string>>"
    cases = [
        ("bagaimana dengan dendanya", [turn("apa itu thr", ["thr"], ["D1"])], "apa itu thr Judul"), ("dendanya", [turn("x", [], [])], None), ("bagaimana dengan thr", [turn("x", [], [])], None), ("bagaimana dengan itu", [], None),
        ("yang itu", [turn("a", ["thr"], ["D1"]), turn("b", ["phk"], ["D2"])], None), ("yang itu", [turn("a", ["thr"], ["D2"]), turn("b", ["phk"], ["D2"])], "b Judul"), ("yang itu", [turn("b", ["phk"], ["D2"])], "b Judul"),
    ]
    for q, t, want in cases:
        got = spark.createDataFrame([(q, t)], schema).select(memory.remembered_context(F.col("q"), F.col("t")).alias("y")).first().y
        assert (got and got.text) == want, q


def test_turn_pairs_and_history(spark):
    said = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "system", "x"), (1, 4, "assistant", "B"), (1, 5, "assistant", "C"), (1, 6, "user", "mail a@b.co"), (1, 7, "assistant", "D"), (1, 8, "user", None), (1, 9, "assistant", "E"), (1, 10, "user", " f "), (1, 11, "assistant", "F"), (2, 0, "assistant", "G"), (2, 1, "user", "h"), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    rows = spark.createDataFrame(said, "k int, n int, role string, text string").repartition(3)
    pairs = turns.turn_pairs(rows, "k", "n")
    assert {(r.k, r.question_at, r.answer_at, r.question, r.answer) for r in pairs.collect()} == {(1, 2, 4, "b", "B"), (1, 6, 7, "mail a@b.co", "D"), (1, 8, 9, "", "E"), (1, 10, 11, " f ", "F")}
    assert [(r.place, r.question, r.answer) for r in turns.history(pairs, "k").orderBy("place").collect()] == [(1, "b", "B"), (2, "f", "F")]
    assert [(r.place, r.answer) for r in turns.history(pairs, "k", 1).collect()] == [(1, "F")]
    assert [r.answer for r in turns.history(pairs, "k", cited=F.col("answer") != "F").collect()] == ["B"]


def _turns(spark):
    rows = [(1, n, f"m{n}", f"tanya {n} tentang thr", [("D1", "Pasal 1", "T"), ("D1", "", None), ("D2", "Pasal 2", "T2"), ("D3", "", ""), ("D4", "", "")] if n != 5 else []) for n in range(12)] + [(2, 0, "m", "q" * 500, None), (3, 0, "m", "q" * 500, [("D", "A", "T")])]
    said = spark.createDataFrame(rows, "k int, n int, m string, q string, c array<struct<document_id:string,article:string,title:string>>")
    return said.select("k", "n", turns.summary_turn(F.col("q"), F.col("m"), F.col("c")).alias("turn"))


def test_summaries(spark):
    got = {r.k: r.turns for r in turns.summaries(_turns(spark), "k", "n").collect()}
    assert set(got) == {1, 3} and [x.source for x in got[1]] == ["m3", "m4", "m6", "m7", "m8", "m9", "m10", "m11"]
    assert (got[1][0].document_ids, got[1][0].articles, got[1][0].titles, got[1][0].topics) == (["D1", "D2", "D3"], ["Pasal 1", "Pasal 2"], ["T", "T2"], ["thr"])
    assert len(got[3][0].question) == 240
    line = turns.summaries(_turns(spark), "k", "n").select("k", turns.older_line(F.col("turns")).alias("x"))
    assert {r.k: r.x for r in line.collect()} == {1: "; ".join(f"tanya {n} tentang thr (T, T2)" for n in (6, 7, 8, 9)), 3: None}


REQUESTS = [("u", "key-00001", "2024-01-01 00:00:00", "a"), ("u", "key-00001", "2024-01-02 00:00:00", "b"), ("u", "key-00001", "2024-01-02 00:00:01", "c"), ("v", "key-00001", "2024-01-01 12:00:00", "d"), ("v", "key-00002", "2024-01-01 00:00:00", None), ("v", "key-00002", "2024-01-01 01:00:00", "e"), ("v", "key-00002", "2024-01-01 02:00:00", "f"), ("v", "short", "2024-01-01 00:00:00", "g"), ("v", None, "2024-01-01 00:00:00", "h"), (None, "key-00003", "2024-01-01 00:00:00", "i"), ("v", "key-00003", None, "j")]


def _requests(spark):
    return spark.createDataFrame(REQUESTS, "who string, k string, at string, x string").withColumn("at", F.to_timestamp("at"))


def test_replays(spark):
    got = sorted(((r.identity, r.request_key, str(r["at"]), r.disposition, r.response) for r in keyed.replayed(_requests(spark).repartition(4), "who", "k", "at", "x").collect()), key=repr)
    assert [(a, b, d, e) for a, b, _, d, e in got] == [("u", "key-00001", "fresh", "a"), ("u", "key-00001", "replayed", "a"), ("u", "key-00001", "fresh", "c"), ("v", "key-00001", "fresh", "d"), ("v", "key-00002", "fresh", None), ("v", "key-00002", "fresh", "e"), ("v", "key-00002", "replayed", "e"), ("v", "short", "rejected", None), ("v", None, "rejected", None)]


def _streamed(spark, tmp_path, parts, schema, stream, mode, kept=None):
    """Rows of a stream that is stopped after each file and started again from its checkpoint."""
    out = []
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        write = query.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        if mode == "append":
            write = write.format("parquet").start(f"{tmp_path}/out")
        else:
            write = write.foreachBatch(lambda df, n: out.extend(df.collect())).start()
        write.awaitTermination()
        assert write.exception() is None, i
    return spark.read.parquet(f"{tmp_path}/out").collect() if mode == "append" else out


def test_replays_outlive_restarts(spark, tmp_path):
    rows = [(f"u{i % 3}", f"request-{i % 4}", f"2024-01-{1 + i // 12:02d} {i % 12:02d}:30:00", None if i % 5 == 0 else f"r{i}") for i in range(60)]
    table = spark.createDataFrame(rows, "who string, k string, at string, x string").withColumn("at", F.to_timestamp("at"))
    run = lambda f: lambda df: f(df, "who", "k", "at", "x", hours=30)
    parts = [table.filter(f"day(at) between {a} and {b}") for a, b in ((1, 1), (2, 3), (4, 5))]
    got = _streamed(spark, tmp_path, parts, table.schema, run(keyed.replayed_stream), "append")
    want = run(keyed.replayed)(table).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    assert {r.disposition for r in want} == {"fresh", "replayed"}


@pytest.fixture
def said(spark):
    return spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")


def test_questions_wait_over_restarts(spark, tmp_path, said):
    parts = [said.filter("turn <= 0"), said.filter("turn in (1, 2)"), said.filter("turn > 2")]
    got = _streamed(spark, tmp_path, parts, said.schema, lambda df: keyed.turn_pairs_stream(df, "conv_id", "turn"), "append")
    want = turns.turn_pairs(said, "conv_id", "turn").collect()
    assert sorted((int(r.key), *tuple(r)[1:]) for r in got) == sorted(map(tuple, want)) and want


def test_summaries_go_on_after_restarts(spark, tmp_path):
    table = _turns(spark).cache()
    parts = [table.filter("n <= 3"), table.filter("n between 4 and 8"), table.filter("n > 8")]
    got = _streamed(spark, tmp_path, parts, table.schema, lambda df: keyed.summaries_stream(df, "k", "n"), "update")
    last = {}
    for r in got:
        if r.key not in last or r.upto >= last[r.key].upto:
            last[r.key] = r
    want = {str(r.k): json.loads(r.x) for r in turns.summaries(table, "k", "n").select("k", F.to_json("turns").alias("x")).collect()}
    assert {k: json.loads(r.turns) for k, r in last.items()} == want and last["1"].upto == 11
