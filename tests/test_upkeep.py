"""Quality and margins of pages, kept results, releases and provenance: each rule with a case of its own."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import quality
from lexmill.operators import consistency, margins
from lexmill.sources import page_cache

PLAIN = "Pekerja berhak atas upah yang layak sesuai dengan ketentuan peraturan. " * 3


@pytest.mark.parametrize(
    ("text", "score", "flags"),
    [
        (None, 0.0, ["insufficient_text", "empty_page"]), (" \n" * 30, 0.0, ["empty_page"]), (PLAIN, 1.0, []), ("Pasal 1 berlaku.", 0.6, ["insufficient_text"]),
        ("ab\ncd\n" * 30, 0.6, ["missing_word_spaces"]), (PLAIN + "�" * 10, 0.95, ["replacement_glyphs"]), ("!?;: " * 40, 0.65, ["low_alphanumeric_ratio"]), ("abc\x01" * 60, None, ["control_or_unreadable_characters"]),
    ],
)
def test_quality(spark, text, score, flags):
    got = spark.createDataFrame([(text,)], "x string").select(quality.page_quality(F.col("x")).alias("q")).first().q
    assert got.flags == flags and (score is None or abs(got.score - score) < 0.06)


def test_kinds(spark):
    rows = spark.createDataFrame([(PLAIN, False), ("x", True), ("x", False), (None, None)], "x string, i boolean").select(quality.page_kind(F.col("x"), F.col("i")).alias("k"), quality.page_quality(F.col("x"))["score"].alias("s"))
    assert [tuple(r) for r in rows.select("k", quality.needs_reading(F.col("k"), F.col("s"))).collect()] == [("text", False), ("scanned", True), ("empty", False), ("empty", False)]


def test_margins(spark):
    body = [f"isi {c} satu\nisi {c} dua\nisi {c} tiga\nisi {c} empat" for c in "abcde"]
    pages = [("D", i + 1, f"Lembar {i + 1}\n\nPasal {i}\n{b}\nPasal 9\nJudul\n- {i + 1} -") for i, b in enumerate(body)] + [("E", 1, "Lembar 1\nisi"), ("E", 2, "Lembar 2\nisi"), ("F", 1, None)]
    clean, gone = margins.margin_lines(spark.createDataFrame(pages, "document_id string, page int, text string").repartition(3))
    got = {(r.document_id, r.page): r.text for r in clean.collect()}
    assert got[("D", 2)] == "Pasal 1\n" + body[1] + "\nPasal 9" and got[("E", 1)] == "Lembar 1\nisi" and got[("F", 1)] == ""
    assert {(r.page, r.place, r.line, r.reason) for r in gone.filter("page = 3").collect()} == {(3, 0, "Lembar 3", "repeated_margin"), (3, 7, "Judul", "repeated_margin"), (3, 8, "- 3 -", "known_pattern")}
    assert margins.margin_lines(spark.createDataFrame([], "document_id string, page int, text string"))[0].count() == 0


def test_only_new_work_is_done(spark, tmp_path):
    path, seen = f"file://{tmp_path}/cache", []

    def compute(todo):
        seen.append(sorted(r.sha for r in todo.collect()))
        return todo.filter("x <> 'none'").select("sha", F.explode(F.array(F.lit(1), F.lit(2))).alias("page"), "x")

    rows = lambda *x: spark.createDataFrame(list(x), "sha string, x string")
    got, report = page_cache.cached(rows(("a", "1"), ("b", "2"), ("b", "2"), ("n", "none"), (None, "3")), path, ("sha",), compute)
    assert report == page_cache.CacheReport(3, 0, 3) and got.count() == 4
    got, report = page_cache.cached(rows(("b", "changed"), ("c", "3"), ("n", "none")), path, ("sha",), compute)
    assert report == page_cache.CacheReport(3, 2, 1) and {(r.sha, r.x) for r in got.collect()} == {("b", "2"), ("c", "3")}
    got, report = page_cache.cached(rows(("a", "1")), path, ("sha",), compute)
    assert report == page_cache.CacheReport(1, 1, 0) and seen == [["a", "b", "n"], ["c"]]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet")}
    page_cache.cached(rows(("a", "1"), ("c", "9")), path, ("sha",), compute)
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet")}


def test_a_crash_leaves_no_half_results(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    work = spark.createDataFrame([("a", 1)], "sha string, x int")
    page_cache.cached(work, path, ("sha",), lambda todo: todo)
    # rows of an attempt that never got to its last step
    spark.createDataFrame([("b", 7, "lost")], "sha string, x int, _attempt string").write.mode("append").parquet(f"{path}/rows")
    got, report = page_cache.cached(work.unionByName(spark.createDataFrame([("b", 2)], work.schema)), path, ("sha",), lambda todo: todo)
    assert report.computed == 1 and {(r.sha, r.x) for r in got.collect()} == {("a", 1), ("b", 2)}


def test_repair_list(spark):
    pages = spark.createDataFrame([("D", 1, 0.9, []), ("D", 2, 0.5, []), ("D", 3, 0.9, ["replacement_glyphs"]), ("D", 4, 0.9, [])], "document_id string, page int, s double, f array<string>")
    asked = spark.createDataFrame([("D", 4), ("D", 2)], "document_id string, page int")
    assert {r.page for r in page_cache.repair_list(pages, F.col("s"), F.col("f"), asked).collect()} == {2, 3, 4}
    with pytest.raises(Exception, match="page 9 of D is outside"):
        page_cache.repair_list(pages, F.col("s"), F.col("f"), asked.unionByName(spark.createDataFrame([("D", 9)], asked.schema))).collect()


def _release(spark, **change):
    made = {
        "eligible": ([("A", 1, "A-v1"), ("B", 2, "B-v2")], "document_id string, version int, version_id string"), "release": ([("A", 1), ("B", 2)], "document_id string, version int"), "builds": ([("A-v1",), ("B-v2",)], "version_id string"), "historical": ([("A-v0",)], "version_id string"),
        "versions": ([("A-v0", "published", "verified", "verified", "completed", "https://x")], "version_id string, publication_status string, source_verification_status string, legal_review_status string, ingestion_status string, url string"), "relations": ([("A", "B", "amends")], "source string, target string, kind string"),
    }
    frames = {k: spark.createDataFrame(change.get(k, rows), schema) for k, (rows, schema) in made.items()}
    known = spark.createDataFrame([("A", "B", "amends")], made["relations"][1]).agg(consistency.relation_hash().alias("hash"))
    found = consistency.release_findings(**frames, relations_hash=known, official=F.col("url").startswith("https://"))
    return {(r.finding, r.name) for r in found.collect()}


def test_a_release_is_consistent_or_says_why(spark):
    assert _release(spark) == set()
    assert _release(spark, release=[("A", 1)]) == {("not_released", "B")}
    assert _release(spark, release=[("A", 1), ("B", 2), ("C", 1)]) == {("not_eligible", "C")}
    assert _release(spark, release=[("A", 1), ("B", 3)]) == {("other_version", "B")}
    assert _release(spark, builds=[("A-v1",)]) == {("build_missing", "B-v2")}
    assert _release(spark, versions=[]) == {("historical_missing", "A-v0")}
    fit = ("A-v0", "published", "verified", "verified", "completed", "https://x")
    for i, bad in ((1, "draft"), (2, None), (3, "pending"), (4, "failed"), (5, "http://x"), (5, None)):
        assert _release(spark, versions=[(*fit[:i], bad, *fit[i + 1 :])]) == {("historical_unfit", "A-v0")}
    assert {x for x, _ in _release(spark, relations=[("A", "B", "repeals")])} == {"relations_changed"}
    assert {x for x, _ in _release(spark, relations=[])} == {"relations_changed"}


def _chunk(spark, change=lambda df: df):
    document = F.struct(F.lit("D").alias("document_id"), *[F.lit(x).alias(x) for x in ("document_type", "document_number", "year", "document_title", "regulation_status")], F.sha2(F.lit("f"), 256).alias("file_hash"), F.lit("u").alias("source_url"), F.lit("").alias("source_file"))
    base = spark.createDataFrame([("D", "D", 0, "c0", 1, 2, " isi\r\nbaris ", None, ["A"]), ("D", "D", 1, "c1", 2, 2, "isi", "c0", ["A"])], "document_id string, owner string, place int, chunk_id string, page_start int, page_end int, content string, parent_chunk_id string, section_path array<string>").withColumn("content_hash", consistency.content_hash(F.col("content")))
    meta = F.struct(
        F.lit(consistency.SCHEMA_VERSION).alias("schema_version"), document.alias("document"), F.struct("page_start", "page_end", "section_path").alias("structure"), F.struct("chunk_id", F.col("place").alias("chunk_index"), "content_hash", "parent_chunk_id", F.lit(None).cast("string").alias("metadata_hash")).alias("chunk"),
        F.struct(*[F.lit("1").alias(x) for x in consistency.MAKERS], F.lit("2024-01-01T00:00:00+07:00").alias("created_at"), F.lit("2024-01-01T00:00:00.5+07:00").alias("updated_at")).alias("ingestion"),
    )
    rows = change(base.withColumn("metadata", meta))
    hashed = rows.withColumn("metadata", F.col("metadata").withField("chunk", F.col("metadata.chunk").withField("metadata_hash", F.coalesce("metadata.chunk.metadata_hash", consistency.metadata_hash(F.col("metadata"))))))
    pages = spark.createDataFrame([("D", 1), ("D", 2)], "document_id string, page int")
    return {(r.chunk_id, r.place): r.issues for r in consistency.provenance_issues(hashed, pages).collect()}


def _at(field, value, row="c1"):
    """Sets a field of the row's metadata (group.name), or a column."""

    def change(df):
        keep = F.when(F.col("chunk_id") == row, F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value))
        if "." not in field:
            return df.withColumn(field, keep.otherwise(F.col(field)))
        group, name = field.split(".")
        m = F.col("metadata")
        return df.withColumn("metadata", m.withField(group, m[group].withField(name, keep.otherwise(m[group][name]))))

    return change


def test_content_hash_sees_the_text_alone(spark):
    assert _chunk(spark) == {}
    one = spark.createDataFrame([("a\r\nb \r",), (" a\nb",)], "x string").select(consistency.content_hash(F.col("x"))).distinct().count()
    assert one == 1


@pytest.mark.parametrize(
    ("field", "value", "issues"),
    [
        ("document_id", "X", ["document_id"]), ("page_start", 3, ["unknown_page", "page_order", "metadata_page_start"]), ("page_end", 9, ["unknown_page", "metadata_page_end"]), ("content", "lain", ["content_hash"]), ("content_hash", "0", ["content_hash", "metadata_content_hash"]),
        ("parent_chunk_id", "c9", ["unknown_parent", "metadata_parent"]), ("section_path", ["B"], ["metadata_section_path"]), ("place", 5, ["chunk_index"]), ("document.document_id", "X", ["metadata_document_id"]), ("document.year", "", ["missing_year"]), ("document.document_title", None, ["missing_document_title"]),
        ("document.source_url", "", ["source_missing"]), ("document.file_hash", "f" * 63, ["file_hash"]), ("chunk.chunk_id", "x", ["metadata_chunk_id"]), ("chunk.metadata_hash", "x", ["metadata_hash"]), ("structure.page_end", 1, ["metadata_page_end"]), ("ingestion.parser_version", "", ["missing_parser_version"]),
        ("ingestion.created_at", "2024-01-01 00:00", ["created_at_form"]), ("ingestion.updated_at", "2024-13-01T00:00:00Z", ["updated_at_form"]), ("ingestion.updated_at", "2023-12-31T16:59:59Z", ["updated_before_created"]),
    ],
)
def test_provenance(spark, field, value, issues):
    (found,) = _chunk(spark, _at(field, value)).values()
    assert found == issues


def test_provenance_of_odd_chunks(spark):
    other = lambda df: df.withColumn("metadata", F.col("metadata").withField("schema_version", F.when(F.col("chunk_id") == "c1", "v0").otherwise(consistency.SCHEMA_VERSION)))
    assert _chunk(spark, other) == {("c1", 1): ["schema_version"]}
    assert _chunk(spark, _at("metadata", None)) == {("c1", 1): ["schema_version"]}
    twice = _chunk(spark, lambda df: df.withColumn("chunk_id", F.lit("c0")))
    assert {k: v[0] for k, v in twice.items()} == {("c0", 0): "repeated_chunk_id", ("c0", 1): "repeated_chunk_id"}
