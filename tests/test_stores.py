"""Filters, artifacts, builds, vectors, conflicts and trees: literal cases and failure paths."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lexmill.functions import filters
from lexmill.operators import conflicts, trees
from lexmill.sources import artifacts, builds, vector_store

# filters


def test_filter_documents():
    assert filters.filter_document() is None
    assert filters.filter_document(year=0, topics=[], published_only=False) is None
    assert filters.filter_document(article="Pasal 1", published_only=True, effective_on="2024-01-01", topics=("a",)) == {"article": {"$eq": "Pasal 1"}, "publication_status": {"$eq": "published"}, "effective_date": {"$lte": "2024-01-01"}, "topics_chunk": {"$in": ["a"]}}
    with pytest.raises(ValueError, match="colour"):
        filters.filter_document(colour="red")


ROWS = [(1, "a", 2000, ["x", "y"], True), (2, None, 2010, [], False), (3, "c", None, None, None)]


@pytest.mark.parametrize(
    ("document", "overlap", "want"),
    [
        (None, False, {1, 2, 3}), ({}, False, {1, 2, 3}), ({"s": "a"}, False, {1}), ({"s": None}, False, {2}), ({"s": {"$eq": None}}, False, {2}), ({"s": {"$in": ["a", None]}}, False, {1, 2}), ({"s": {"$in": []}}, False, set()),
        ({"n": {"$gte": 2000}}, False, {1, 2}), ({"n": {"$gte": 2001, "$lte": 2010}}, False, {2}), ({"n": "2000"}, False, set()), ({"n": 2000.0}, False, {1}), ({"n": {"$ne": 1}}, False, {1, 2, 3}), ({"s": "a", "n": 2010}, False, set()),
        ({"l": {"$in": ["x"]}}, False, set()), ({"l": {"$in": [["x", "y"], "x"]}}, False, {1}), ({"l": {"$in": ["x", 5]}}, True, {1}), ({"l": {"$eq": []}}, False, {2}), ({"b": True}, False, {1}), ({"b": {"$in": [False, None]}}, False, {2, 3}),
        ({"other": "x"}, False, set()), ({"other": None}, False, {1, 2, 3}), ({"other": {"$lte": 3}}, False, set()), ({"other": {"$in": [None]}}, False, {1, 2, 3}),
    ],
)
def test_filters(spark, document, overlap, want):
    rows = spark.createDataFrame(ROWS, "k int, s string, n int, l array<string>, b boolean")
    assert {r.k for r in filters.matching(rows, document, overlap).collect()} == want
    assert {r.k for r in filters.matched(rows, {"f": document or {}}, "k", overlap).collect()} == want


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    spark.createDataFrame(ROWS, "k int, s string, n int, l array<string>, b boolean").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    filters.matching(rows, {"s": {"$in": ["a", "c"]}, "n": {"$gte": 1990}}).select("k").explain("formatted")
    said = capsys.readouterr().out
    pushed = next(x for x in said.splitlines() if "PushedFilters" in x)
    assert "In(s, [a,c])" in pushed and "GreaterThanOrEqual(n,1990)" in pushed and "ReadSchema: struct<k:int,s:string,n:int>" in said
    with pytest.raises(ValueError, match="n: \\$gte 'x' on int"):
        filters.matching(rows, {"n": {"$gte": "x"}})


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("bagaimana penjelasan pasal 15 pp 35 tahun 2021?", {"article": "Pasal 15", "year": 2021, "regulation_type": "PP", "number": 35, "segment_kinds": ["explanation"]}),
        ("apakah pekerja pkwt memperoleh kompensasi?", {}), ("aturan thr yang masih berlaku?", {"freshness_states": ["fresh"]}), ("aturan thr yang terkini?", {"freshness_states": ["fresh"]}), ("berlaku sejak 2019", {}),
        ("pasal 88a uu cipta kerja", {"article": "Pasal 88A", "year": 2023, "regulation_type": "UU", "number": 6}), ("permenaker nomor 5 dicabut", {"legal_status": "revoked"}), ("permenaker no. 5 dicabut", {"regulation_type": "Permenaker", "number": 5, "legal_status": "revoked"}), (None, {}),
    ],
)
def test_asked_filters(spark, question, want):
    got = spark.createDataFrame([(question,)], "q string").select(filters.asked_filters(F.col("q")).alias("f")).first().f.asDict()
    assert {k: v for k, v in got.items() if v is not None} == want


@pytest.mark.parametrize(
    ("topics", "context", "documents", "want"),
    [([], [], ["UU-6-2023-47c5b9a4"], ("UU", 6, 2023)), (["thr"], ["pkwt"], ["UU-6-2023"], None), (["thr"], ["thr", "phk"], ["pp-35-2021-x", "PP-35-2021", "other"], ("PP", 35, 2021)), ([], [], ["UU-6-2023", "PP-35-2021"], None), ([], [], None, None), (None, None, ["UU-6-20231"], None)],
)
def test_inherited_filters(spark, topics, context, documents, want):
    rows = spark.createDataFrame([("berapa besarnya pasal 3", topics, context, documents)], "q string, t array<string>, c array<string>, d array<string>")
    got = rows.select(filters.inherited_filters(filters.asked_filters(F.col("q")), F.col("t"), F.col("c"), F.col("d")).alias("f")).first().f
    assert (got.article, (got.regulation_type, got.number, got.year) if got.regulation_type else None) == ("Pasal 3", want)


# artifacts


def _file(root, path, value, when):
    place = root / path
    place.parent.mkdir(parents=True, exist_ok=True)
    place.write_text(json.dumps(value))
    os.utime(place, (when, when))


def _chunk(k, document, **more):
    return {"chunk_id": k, "document_id": document, "text": f"text {k}", "page_start": 1, "page_end": 1, "token_count": 2} | more


def test_artifacts(spark, tmp_path):
    root = tmp_path / "store"
    _file(root, "documents/A/v1/builds/old/processed/chunks.json", [_chunk("a1", "A")], 1_000)
    _file(root, "documents/A/v1/builds/late/processed/chunks.json", [_chunk("a2", "A", retrieval_text="r", topics=["t"]), _chunk("a3", "A", retrieval_text="")], 3_000)
    _file(root, "documents/A/v1/builds/late/processed/embeddings.json", [{"chunk_id": "a2", "embedding_model": "m", "embedding": [1.0, 2.0]}], 3_000)
    _file(root, "documents/A/v1/builds/late/metadata/document.json", {"title": "T", "publication_status": "draft", "legal_review_status": "pending"}, 3_000)
    _file(root, "documents/A/v2/processed/chunks.json", [_chunk("a4", "A", build_id="own")], 2_000)
    _file(root, "documents/B/v10/processed/chunks.json", [_chunk("b1", "B")], 2_000)
    _file(root, "documents/B/vX/processed/chunks.json", [_chunk("b2", "B")], 9_000)
    _file(root, "documents/B/v10/other/chunks.json", [_chunk("b3", "B")], 9_000)
    path = f"file://{root}"
    got = {r.chunk_id: r for r in artifacts.read_artifacts(spark, path).collect()}
    assert set(got) == {"a2", "a3", "b1"}
    a2, a3, b1 = got["a2"], got["a3"], got["b1"]
    assert (a2.retrieval_text, a2.build_id, a2.topics, a2.embedding, a2.metadata.title, a2.publication_status, a2.verification_status, a2.document_version) == ("r", "late", ["t"], [1.0, 2.0], "T", "draft", "pending", 1)
    assert (a3.retrieval_text, a3.embedding, a3.topics, a3.legal_status) == ("text a3", None, [], "needs_verification")
    assert (b1.build_id, b1.document_version, b1.publication_status, b1.verification_status, b1.char_end) == (None, 10, "published", "verified", 0)
    assert {r.document_id: r.chunks for r in artifacts.artifact_counts(spark, path).collect()} == {"A": 3, "B": 1}
    versions = spark.createDataFrame([("A", 2)], "document_id string, version int")
    assert [(r.chunk_id, r.build_id) for r in artifacts.read_artifacts(spark, path, versions).collect()] == [("a4", "own")]
    named = spark.createDataFrame([("A-v1", "old")], "version_id string, build_id string")
    assert {r.chunk_id for r in artifacts.read_artifacts(spark, path, builds=named).collect()} == {"a4", "b1"}
    assert {r.chunk_id for r in artifacts.read_artifacts(spark, path, spark.createDataFrame([("A", 1)], versions.schema), named).collect()} == {"a1"}


# builds


def _build(spark, name="B1", document="D", sha="s", status="completed", manifest="{}", texts=("eins", "zwei"), revision="r", config="c", version="D-v1"):
    own = spark.createDataFrame([(name, document, version, sha, config, "m", status, manifest)], builds.BUILD)
    chunks = spark.createDataFrame([(name, i, f"{name}-{i}", document, x, None) for i, x in enumerate(texts)], "build_id string, place long, chunk_id string, document_id string, text string, retrieval_text string")
    vectors = chunks.select("build_id", "chunk_id", F.array(F.lit(3.0), F.lit(4.0)).alias("embedding"), F.lit("m").alias("model"), F.lit(revision).alias("revision"))
    return own, chunks, vectors


def _files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_a_finished_build_is_verified_and_not_written(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    run = lambda *x: {r.build_id: r.disposition for r in builds.persist_builds(spark, root, *x).collect()}
    assert run(*_build(spark)) == {"B1": "stored"}
    before = _files(tmp_path / "r")
    assert run(*_build(spark)) == {"B1": "reused"}
    assert _files(tmp_path / "r") == before
    assert [(r.chunk_index, r.text, r.retrieval_text) for r in builds.read_chunks(spark, root).orderBy("chunk_index").collect()] == [(0, "eins", "eins"), (1, "zwei", "zwei")]
    assert {(r.dimensions, r.vector_norm) for r in builds.read_embeddings(spark, root).collect()} == {(2, 5.0)}
    for change, conflict in (({"texts": ("eins", "drei")}, "chunk materialization"), ({"texts": ("zwei", "eins")}, "chunk materialization"), ({"texts": ("eins",)}, "chunk materialization"), ({"revision": "r2"}, "embedding materialization"), ({"manifest": "{1}"}, "artifact manifest"), ({"status": "failed"}, "terminal status"), ({"config": "c2"}, "pipeline configuration"), ({"sha": "s2"}, "version identity")):
        with pytest.raises(builds.BuildConflict, match=conflict):
            run(*_build(spark, **change))
    assert _files(tmp_path / "r") == before
    assert run(*_build(spark, "B2", "E", "s9", version="E-v1")) == {"B2": "stored"}
    assert before.items() <= _files(tmp_path / "r").items() and builds.read_chunks(spark, root).count() == 4


def test_what_must_not_be_stored(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    own, chunks, vectors = _build(spark)
    for bad, conflict in (((own, chunks.unionByName(chunks), vectors), "repeated chunk ids"), ((own, chunks.withColumn("document_id", F.lit("X")), vectors), "another document"), ((own, chunks, vectors.limit(1)), "embedding membership"), ((own.unionByName(_build(spark, "B3", "Z", "s", version="Z-v1")[0]), chunks, vectors), "source of another document")):
        with pytest.raises(builds.BuildConflict, match=conflict):
            builds.persist_builds(spark, root, *bad)
    assert not (tmp_path / "r").exists()


def test_a_crash_before_the_last_step_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/r"
    write = builds._write

    def fails(rows, path):
        if path.endswith("/builds"):
            raise OSError("lost")
        write(rows, path)

    monkeypatch.setattr(builds, "_write", fails)
    with pytest.raises(OSError, match="lost"):
        builds.persist_builds(spark, root, *_build(spark))
    assert builds.read_chunks(spark, root).count() == 0
    monkeypatch.setattr(builds, "_write", write)
    got = builds.persist_builds(spark, root, *_build(spark, texts=("neu",))).collect()
    assert got[0].disposition == "stored" and [r.text for r in builds.read_chunks(spark, root).collect()] == ["neu"]


def test_an_unfinished_build_is_replaced(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    builds.persist_builds(spark, root, *_build(spark, status="failed"))
    got = builds.persist_builds(spark, root, *_build(spark, texts=("neu",))).collect()
    assert got[0].disposition == "stored" and [r.text for r in builds.read_chunks(spark, root).collect()] == ["neu"]


# vectors


def test_verified_batches(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "id long, values array<double>")
    assert vector_store.write_verified(rows, root, "n", "1") == vector_store.WriteReport(20, 5, 1.0, False)
    with pytest.raises(ValueError, match="exists"):
        vector_store.write_verified(rows, root, "n", "1")
    turned = lambda p: spark.read.parquet(p).withColumn("values", F.when(F.col("id") == 3, F.array(F.lit(-1.0), F.lit(0.0))).otherwise(F.col("values")))
    for read in (turned, lambda p: spark.read.parquet(p).filter("id <> 2"), lambda p: spark.read.parquet(p).filter("id <> 17"), lambda p: spark.read.parquet(p).unionByName(spark.read.parquet(p))):
        assert vector_store.write_verified(rows, root, "n", "2", read=read) == vector_store.WriteReport(20, 0, 0.0, True)
    assert vector_store.read_vectors(spark, root, "n").count() == 20
    assert vector_store.write_verified(rows.limit(0), root, "n", "empty").upserted == 0
    with pytest.raises(ValueError, match="repeated or null ids: 1"):
        vector_store.write_verified(rows.filter("id = 1").unionByName(rows.filter("id = 1")), root, "n", "4")
    assert vector_store.write_verified(rows.filter("id = 1").withColumn("values", F.array(F.lit(9.0), F.lit(9.0))), root, "n", "5", sample=None).verified == 1
    assert {r.id: r["values"] for r in vector_store.read_vectors(spark, root, "n").collect()}[1] == [9.0, 9.0]


def test_deletion_needs_a_word_and_a_copy(spark, tmp_path):
    root = f"file://{tmp_path}"
    vector_store.write_verified(spark.range(7).select("id", F.array(F.lit(1.0)).alias("values")), root, "n", "1")
    assert vector_store.clear_namespace(spark, root, "n") == vector_store.Clearance("n", 7, (0, 1, 2, 3, 4), False)
    with pytest.raises(ValueError, match="path"):
        vector_store.clear_namespace(spark, root, "n", confirm=True)
    assert vector_store.clear_namespace(spark, root, "n", f"{root}/ids", confirm=True).confirmed
    assert spark.read.parquet(f"{root}/ids").count() == 7
    assert vector_store.clear_namespace(spark, root, "n") == vector_store.Clearance("n", 0, (), False)


def test_metadata_fits(spark):
    cases = [("a" * 10, "b" * 10, "c" * 10, []), ("a" * 900, "b" * 10, "c" * 10, ["parent_text"]), ("a" * 900, "b" * 900, "c" * 10, ["parent_text", "text"]), (None, "b" * 120, "c" * 900, ["text", "quote"]), ("a", "b" * 90, "c" * 99, []), (None, None, None, [])]
    rows = spark.createDataFrame([(i, (a, b, c)) for i, (a, b, c, _) in enumerate(cases)], "k int, m struct<parent_text:string,text:string,quote:string>")
    got = {r.k: r for r in vector_store.fit_metadata(rows, "m", 250).collect()}
    assert [got[i].shed for i in range(len(cases))] == [x[3] for x in cases]
    assert (len(got[2].m.text), got[2].m.quote, len(got[3].m.text), len(got[3].m.quote)) == (112, "c" * 10, 60, 112)
    assert got[0].m.parent_text == "a" * 10 and got[1].m.parent_text is None


# conflicts


def test_conflicts_by_rule(spark):
    day = lambda n: None if n is None else f"2024-01-{n:02d}"
    rows = [
        ("A", 0, "x", "verified", "low", 1), ("A", 1, "y", "none", "high", 9), ("A", 2, "z", "verified", "high", 1), ("A", 3, "q", "verified", "high", 2), ("A", 4, "r", "verified", "high", 2), ("A", 5, "s", "verified", "off", 9),
        ("B", 0, "x", "none", "low", None), ("B", 1, "x", "verified", "high", 9), ("B", 2, "y", "none", "low", 1), ("B", 3, "w", "none", "low", None), ("C", 0, "x", None, None, None), (None, 0, "x", None, None, None),
    ]
    records = spark.createDataFrame([(a, b, c, d, e, day(f)) for a, b, c, d, e, f in rows], "document_id string, place long, sha256 string, verification_status string, source_id string, last_verified_at string").repartition(3)
    sources = spark.createDataFrame([("low", 0.2, True), ("high", 0.9, True), ("off", 1.0, False)], "source_id string, trust double, enabled boolean")
    kept, audit = conflicts.merged_records(records, sources)
    assert {r.document_id: r.place for r in kept.collect()} == {"A": 3, "B": 2, "C": 0}
    assert {(r.document_id, r.place): (r.kept_place, r.lost_place, r.rule) for r in audit.collect()} == {
        ("A", 1): (0, 1, "verified_status"), ("A", 2): (2, 0, "source_trust"), ("A", 3): (3, 2, "newer_verification"), ("A", 4): (3, 4, "stability"), ("A", 5): (3, 5, "source_trust"), ("B", 2): (2, 0, "newer_verification"), ("B", 3): (2, 3, "stability"),
    }


def test_ties_of_place_and_content_do_not_follow_the_rows_order(spark):
    rows = [("d", 1, "a", "verified", "s", "2024-03-01"), ("d", 1, "a", "unverified", "s", None), ("d", 1, "a", "unverified", "s", "2024-01-01"), ("d", 2, "b", "unverified", "s", "2024-02-01")]
    sources = spark.createDataFrame([("s", 0.5, True)], "source_id string, trust double, enabled boolean")
    for given in (rows, rows[::-1], [rows[2], rows[0], rows[3], rows[1]]):
        records = spark.createDataFrame(given, "document_id string, place long, sha256 string, verification_status string, source_id string, last_verified_at string").coalesce(1)
        got = sorted(tuple(r)[1:] for r in conflicts.folded_records(records, sources).collect() if r.place == 2)
        assert got == [(2, 2, 1, "newer_verification")]  # of the tied ones the unverified record without a date comes first and stays
        assert conflicts.merged_records(records, sources)[0].collect()[0].place == 2


def test_a_fold_goes_on_from_batch_to_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        records = spark.range(1000).select(F.lit("A").alias("document_id"), F.col("id").alias("place"), F.col("id").cast("string").alias("sha256"), F.lit("verified").alias("verification_status"), F.lit("s").alias("source_id"), F.date_add(F.lit("2020-01-01").cast("date"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0).cast("int")).alias("last_verified_at"))
        kept, audit = conflicts.merged_records(records, spark.createDataFrame([("s", 1.0, True)], "source_id string, trust double, enabled boolean"))
        assert [tuple(r) for r in kept.collect()] == [("A", 990)] and audit.filter("rule = 'newer_verification'").count() == 99
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# trees


def test_chains_and_ancestors(spark):
    up = {1: None, 2: 1, 3: 2, 4: 3, 5: 99, 6: 5, 7: 8, 8: 9, 9: 7, 10: 7, 11: 11, 12: 4}
    nodes = spark.createDataFrame([*up.items(), (None, 1), (2, 1)], "node long, parent long").repartition(3)
    got = {r.node: (r.root, r.depth, r.state) for r in trees.chains(nodes).collect()}
    assert got == {1: (1, 0, "rooted"), 2: (1, 1, "rooted"), 3: (1, 2, "rooted"), 4: (1, 3, "rooted"), 5: (5, 0, "orphan"), 6: (5, 1, "orphan"), 12: (1, 4, "rooted")} | dict.fromkeys((7, 8, 9, 10, 11), (None, None, "cycle"))
    pairs = {(r.node, r.ancestor, r.distance) for r in trees.ancestors(nodes).collect()}
    assert pairs == {(2, 1, 1), (3, 2, 1), (3, 1, 2), (4, 3, 1), (4, 2, 2), (4, 1, 3), (6, 5, 1), (12, 4, 1), (12, 3, 2), (12, 2, 3), (12, 1, 4)}
    assert trees.chains(nodes.limit(0)).count() == trees.ancestors(nodes.limit(0)).count() == 0


def test_hierarchy_findings(spark):
    rows = [("root", None, "document", 0, 1, 9), ("p1", "root", "pasal", 1, 1, 2), ("a1", "p1", "ayat", 2, 2, 3), ("a2", "root", "ayat", 3, 2, 2), ("b1", "p1", "bab", 4, 1, 1), ("x", "gone", "pasal", 5, 1, 1), ("u", "v", "bab", 6, 1, 1), ("v", "u", "bagian", 7, 1, 1), ("d", "root", "document", 8, 1, 1), ("p1", "root", "pasal", 9, 1, 2)]
    sections = spark.createDataFrame([("D", *x) for x in rows], "document_id string, node_id string, parent string, type string, place int, page_start int, page_end int")
    pages = spark.createDataFrame([("D", k) for k in (1, 2, 3)], "document_id string, page int")
    assert {(r.node_id, r.code) for r in trees.hierarchy_findings(sections, pages).collect()} == {
        ("root", "unknown_page"), ("a1", "outside_pages"), ("a2", "orphan_ayat"), ("b1", "level"), ("b1", "parent_after"), ("a1", "parent_after"), ("x", "missing_parent"), ("u", "cycle"), ("v", "cycle"), ("u", "parent_after"), ("u", "level"), ("d", "parented_document"), ("p1", "repeated_node"),
    }


def test_spans(spark):
    marks = [(1, 1, True, "a"), (1, 2, True, "b"), (1, 3, False, ""), (1, 4, True, "c"), (1, 5, True, "d"), (1, 6, False, ""), (1, 7, False, ""), (1, 8, False, ""), (1, 9, False, ""), (1, 10, True, "e"), (2, 1, False, ""), (2, 2, True, "f")]
    rows = spark.createDataFrame(marks, "t int, i int, o boolean, name string")
    assert {(r.t, r.name): (r.span, r.parent, r.level, r.begin, r.end) for r in trees.spans(rows, "t", "i", "o", "name").collect()} == {(1, "a"): (1, None, 1, 1, 8), (1, "b"): (2, 1, 2, 2, 3), (1, "c"): (3, 1, 2, 4, 7), (1, "d"): (4, 3, 3, 5, 6), (1, "e"): (5, None, 1, 10, None), (2, "f"): (1, None, 1, 2, None)}
