"""What the statutes' queries move and hold, and that results don't depend on how rows come in batches."""

import random

import pytest

from lexmill.operators import chunking
from lexmill.operators import segments as seg
from lexmill.plans import statutes, structure
from lexmill.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"
LINES = ["BAB I", "Bagian Kesatu", "Paragraf 1", "Pasal 1", "Pasal 2", "(1) isi satu", "(2)", "a. butir", "isi", "", "LAMPIRAN", "Menimbang bahwa", "MEMUTUSKAN"]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture
def pages(spark):
    rng = random.Random(9)
    rows = [(d, p, "\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 9)))) for d in range(40) for p in range(rng.randint(1, 5))]
    return spark.createDataFrame([*rows, (98, 1, "BAB I\n\nBAB II"), (99, 1, None)], "document_id long, page long, text string").repartition(3)


def test_chunks_are_shuffled_once(spark):
    """Pages meet by order and by statute, segments by statute; nothing else is shuffled (F4)."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert shuffles(statutes.pages(Tables(spark, FOLDER))) == 3
        assert shuffles(structure.tx_retrieval_text(Tables(spark, FOLDER))) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_documents_in_small_batches(spark, pages):
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = rows(seg.segments(pages))
    assert len(want) > 100 and any(r[10] == "unstructured" for r in want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert rows(seg.segments(pages)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    from pyspark.sql import functions as F

    one = rows(chunking.chunked(seg.segments(pages), F.lit("t"), F.lit(1), 6, 8, 2, 4))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert rows(chunking.chunked(seg.segments(pages), F.lit("t"), F.lit(1), 6, 8, 2, 4)) == one
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_gates_shuffle_no_lines(spark):
    """Marks need no other line, and chunks meet removed lines by statute: no line of a chunk or page is a row of a shuffle (F3)."""
    from lexmill.plans import release

    assert shuffles(seg.article_marks(statutes.pages(Tables(spark, FOLDER)).limit(5))) <= 4
    plan = release.tx_gates_clean(Tables(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "explode(array_distinct(split(" not in plan and "arrays_overlap" in plan


def test_the_tree_needs_few_windows(spark, pages):
    """What is in force is found in batches of whole documents, of any size, and lines are never shuffled to find it (F1, F2)."""
    from lexmill.operators import legal_tree

    plan = legal_tree._placed(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 1 and plan.count("Exchange hashpartitioning") == 1
    rows = lambda: sorted(map(tuple, legal_tree._placed(pages).drop("path").collect()), key=repr)
    want = rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert rows() == want and len(want) > 200
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nodes_alone(spark, pages):
    """Findings need where parts stand, and no text, amendment or repeat (F2)."""
    from pyspark.sql import functions as F

    from lexmill.operators import legal_tree

    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    nodes = legal_tree.tree_nodes(pages)
    want = legal_tree.legal_tree(pages, text="none").select(*nodes.columns)
    assert rows(nodes) == rows(want) and nodes.filter(F.col("place") > 1).count() > 100
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "md5" not in plan
