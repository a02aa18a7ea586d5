"""Records that may be taken in, headings, neighbours and the gates of chunks on literal cases."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import headings
from lexmill.operators import ranking, records, release


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "want"),
    [("Pasal 5", True), (" BAB II \n KETENTUAN UMUM. ", True), ("Bagian Kesatu Umum", True), ("Pasal 5 Pekerja berhak atas upah", False), ("Pasal 5 " + "kata " * 12, False), ("Isi pasal", False), ("Pasal", False), ("", False), (None, False)],
)
def test_headings(spark, text, want):
    assert one(spark, text, headings.heading_only) is want


def test_compact(spark):
    assert one(spark, " a  b\nc ", headings.compact) == "a b c" and one(spark, None, headings.compact) is None
    sentence = "Kalimat pertama yang cukup panjang untuk dipotong. "
    assert one(spark, sentence * 10, headings.compact) == (sentence * 5).strip() + "..."
    assert one(spark, "Ya. " + "x" * 400, headings.compact) == "Ya. " + "x" * 253 + "..."


def test_chunk_reasons(spark):
    import hashlib

    good = hashlib.sha256(b"isi").hexdigest()
    rows = [(1, "a", "isi", good), (2, "a", "isi", None), (3, " ", "isi", None), (4, None, "isi", None), (5, "b", " \n", None), (6, "b", "isi", ""), (7, "b", "isi", "bad"), (8, "c", "isi", "bad"), (9, "d", None, None)]
    made = records.chunk_reasons(spark.createDataFrame(rows, "n int, chunk_id string, content string, content_hash string").repartition(3), "n")
    assert {r.n: r.reason for r in made.collect()} == {1: None, 2: "duplicate_id", 3: "empty_id", 4: "empty_id", 5: "empty_text", 6: None, 7: "duplicate_id", 8: "content_hash_mismatch", 9: "empty_text"}


def test_file_verdicts(spark):
    rows = [("a.pdf", b"%PDF-1.4", 9, False, 2, 50), ("a.PDF", b"%PDF-", 9, None, 2, 39), ("a.txt", b"%PDF-", 9, False, 2, 50), (None, b"%PDF-", 9, False, 2, 50), ("a.pdf", b"%PD", 3, False, 2, 50), ("a.pdf", None, 0, False, 2, 50), ("a.pdf", b"%PDF-", 0, False, 2, 50), ("a.pdf", b"%PDF-", 9, True, 0, 0), ("a.pdf", b"%PDF-", 9, False, 0, 0), ("a.pdf", b"%PDF-", 9, False, None, None)]
    made = spark.createDataFrame(rows, "name string, head binary, size int, e boolean, pages int, n int").select(records.file_verdict(*map(F.col, ("name", "head", "size", "e", "pages", "n"))).alias("v"))
    assert [tuple(r.v) for r in made.collect()] == [(True, None), (True, "no_embedded_text"), (False, "not_a_pdf"), (False, "not_a_pdf"), (False, "bad_magic"), (False, "bad_magic"), (False, "empty_file"), (False, "encrypted"), (False, "no_pages"), (False, "no_pages")]


def test_servable_versions(spark):
    fit = ("published", "verified", "verified", "completed", "active", "https://a.go.id/x", True)
    bad = [*((*fit[:i], None, *fit[i + 1 :]) for i in range(7)), (*fit[:4], "revoked", *fit[5:]), (*fit[:5], "https://go.id.evil.com", True), (*fit[:5], "https://evil.com/https://go.id", True), (*fit[:6], False)]
    rows = spark.createDataFrame([fit, *bad], "publication_status string, source_verification_status string, legal_review_status string, ingestion_status string, legal_status string, source_url string, is_current boolean")
    kept, counts = records.servable(rows)
    assert [tuple(r) for r in kept.collect()] == [fit] and tuple(counts.first()) == (12, 11)


def test_neighbours(spark):
    passages = [("p0", "D", 0, "A", "isi"), ("p1", "D", 1, "A", "isi"), ("p2", "D", 2, "A", "Pasal 5"), ("p3", "D", 3, "B", "isi"), ("p4", "D", 4, "B", "isi"), ("p5", "D", 5, "B", "isi"), ("p6", "D", 6, None, "isi"), ("p7", "D", 7, None, "isi"), ("q0", "E", 0, "A", "isi")]
    table = spark.createDataFrame(passages, "passage_id string, document_id string, place int, article string, text string")
    ranked = spark.createDataFrame([(1, "p4", 1, 0.8), (1, "p1", 2, 0.5), (1, "p6", 3, 0.4), (1, "q0", 4, 0.2), (2, "p3", 1, 1.0)], "query_id int, passage_id string, rank int, score double")
    got = {(r.query_id, r.passage_id): (r.score, r.added) for r in ranking.expanded(ranked, table).collect()}
    assert {k: v for k, v in got.items() if v[1]} == {(1, "p3"): (0.68, True), (1, "p5"): (0.68, True), (1, "p0"): (0.425, True), (2, "p4"): (0.85, True)} and len(got) == 9
    assert ranking.expanded(ranked, table, most=1).filter("added and query_id = 1").first().passage_id == "p3"


def test_gates_of_chunks(spark):
    chunk = lambda d, i, a, x: (d, f"{d}{i}", a, x)
    rows = [chunk("ok", 0, "Pasal 1", "isi satu yang berlaku"), chunk("ok", 1, "Pasal 2", "isi dua"), chunk("gap", 0, "Pasal 1", "isi"), chunk("gap", 1, "Pasal 3", "lain"), chunk("twice", 0, "Pasal 1", "Isi  sama"), chunk("twice", 1, "Pasal 1", "isi sama"), chunk("long", 0, "Pasal 1", "kata " * 60), chunk("none", 0, None, "isi"), chunk("lost", 0, "Pasal 1", "isi\nLembar 2"), chunk("lost", 1, None, "Pasal 2")]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id string, article string, text string")
    detected = chunks.select("document_id", "article").unionByName(spark.createDataFrame([("lost", "Pasal 2")], "document_id string, article string"))
    unresolved = spark.createDataFrame([("lost", 4)], "document_id string, page int")
    margins = spark.createDataFrame([("lost", "Lembar 2"), ("ok", "Lembar 2")], "document_id string, line string")
    got = {r.document_id: (r.status, r.articles, r.missing, r.unchunked, r.repeated, r.overlong, r.unresolved, r.headings, r.margin_noise) for r in release.cleaning_report(chunks, detected, unresolved, margins, 50).collect()}
    assert got == {
        "ok": ("passed", 2, 0, 0, 0, 0, 0, 0, 0), "gap": ("review_required", 2, 1, 0, 0, 0, 0, 0, 0), "twice": ("review_required", 1, 0, 0, 1, 0, 0, 0, 0), "long": ("review_required", 1, 0, 0, 0, 1, 0, 0, 0),
        "none": ("review_required", 0, 0, 0, 0, 0, 0, 0, 0), "lost": ("review_required", 2, 0, 1, 0, 0, 1, 1, 1),
    }
