"""Segments of statutes on literal pages."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import segments as seg


def rows(spark, *texts, name="D"):
    pages = spark.createDataFrame([(name, k + 1, x) for k, x in enumerate(texts)], "document_id string, page long, text string").repartition(2)
    return seg.segments(pages).orderBy("place").collect()


def test_an_inline_heading_opens_a_segment(spark):
    got = rows(spark, "Isi ketentuan umum.\nAturan penutup. Pasal 6 Isi pasal enam.")
    assert [(r.segment_id, r.article, r.kind, r.provenance, r.text) for r in got] == [("D-seg-00001", None, "preamble", "none", "Isi ketentuan umum."), ("D-seg-00002", "Pasal 6", "substantive", "inline", "Isi pasal enam")]


def test_kinds_follow_the_openers(spark):
    got = rows(spark, "Menimbang bahwa perlu aturan.\nPasal 185 huruf b\n(1) isi\nMEMUTUSKAN\nPasal 1\nIsi pasal satu.\nLAMPIRAN\nDaftar tabel.\nPasal 2\nisi\nPENJELASAN\nBagian Kesatu\nParagraf 2\nisi")
    assert [(r.kind, r.chapter, r.section, r.article, r.text) for r in got] == [
        ("considerans", None, None, None, "Menimbang bahwa perlu aturan.\nPasal 185 huruf b\n(1) isi"), ("resolution", None, None, None, "MEMUTUSKAN"), ("substantive", None, None, "Pasal 1", "Isi pasal satu."),
        ("appendix", "LAMPIRAN", None, None, "LAMPIRAN\nDaftar tabel."), ("appendix", "LAMPIRAN", None, "Pasal 2", "isi"), ("explanation", "PENJELASAN", None, None, "PENJELASAN"), ("explanation", "PENJELASAN", "Bagian Kesatu / Paragraf 2", None, "isi"),
    ]


def test_blank_lines_and_pages(spark):
    got = rows(spark, "Pasal 1\nAyat satu.\n\n \nAyat dua.\n", "\nlanjut\n\nBAB II\n\nPasal 2", "\n\n(1)\nIsi\na. butir\nb. butir lain", None, "")
    assert [(r.chapter, r.article, r.paragraph, r.page_start, r.page_end, r.text) for r in got] == [
        (None, "Pasal 1", None, 1, 2, "Ayat satu.\n\nAyat dua.\n\nlanjut"), ("BAB II", "Pasal 2", "Ayat (1)", 3, 3, "Isi"),
        ("BAB II", "Pasal 2", "Ayat (1), Huruf a", 3, 3, "butir"), ("BAB II", "Pasal 2", "Ayat (1), Huruf b", 3, 3, "butir lain"),
    ]


def test_contents_are_dropped_and_reported(spark):
    text = "Isi pasal empat.\nPasal6\nPasa17\nPasa18\nBABIII\nPasa19\nIsi penting."
    got = rows(spark, text)
    assert [(r.chapter, r.article, r.provenance) for r in got] == [(None, None, "none"), ("BAB III", "Pasal 9", "normalized")]
    report = seg.segment_report(spark.createDataFrame([("D", 1, text)], "document_id string, page long, text string"))
    assert {r.kind: r.lines for r in report.collect()} == {"toc": 3, "chapter": 1, "article": 1}
    assert [r.article for r in rows(spark, "Isi sebelumnya.\nPasal 9", "(1) Isi ayat pertama.")] == [None, "Pasal 9"]


def test_text_without_content_is_kept_by_page(spark):
    assert [(r.segment_id, r.kind, r.page_end, r.text) for r in rows(spark, "BAB I\n", "  ", "Paragraf 1")] == [("D-page-00001", "unstructured", 1, "BAB I\n"), ("D-page-00003", "unstructured", 3, "Paragraf 1")]
    assert rows(spark, "   ", None) == []
    assert rows(spark) == []


def test_issues(spark):
    long = "Isi ketentuan yang cukup panjang untuk lolos batas minimum."
    each = [("a", 1, "Pasal 9", "Ayat (1)", long), ("b", 2, "Pasal 9", "Ayat (1)", long), ("c", 3, "Pasal 9", "Ayat (3)", long), ("d", 4, "Pasal 4Tahun", None, long), ("e", 5, "Pasal 9", None, "x"), ("f", 6, "Pasal 8", "Ayat (2)", long), ("g", 7, "Pasal 8", "Ayat (1)", long), ("h", 8, "Pasal 7", "Ayat (1)", long), ("i", 9, "Pasal 7", "Ayat (2)", long)]
    found = spark.createDataFrame([("D", *x, "substantive") for x in each], "document_id string, segment_id string, place long, article string, paragraph string, text string, kind string")
    assert {(r.segment_id, r.code) for r in seg.segment_issues(found).collect()} == {("a", "ayat_duplicate"), ("a", "ayat_gap"), ("d", "bad_article_label"), ("e", "too_short"), ("f", "ayat_gap")}
    assert seg.segment_issues(found.withColumn("kind", F.lit("appendix"))).filter("code = 'too_short'").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_segments_like_a_plain_loop(spark, seed):
    import random

    rng = random.Random(seed)
    marks = {"BAB I": "chapter", "BAB II": "chapter", "Bagian Kesatu": "section", "Paragraf 3": "subsection", "Pasal 4": "article", "Pasal 5 isi lima": "article", "(1)": "paragraph", "(2) isi dua": "paragraph", "a. butir": "letter", "LAMPIRAN": "appendix", "PENJELASAN": "explanation", "Menimbang hal": "considerans", "MEMUTUSKAN": "resolution"}
    texts = ["\n".join(rng.choice([*marks, "isi", "isi lagi", "", ""]) for _ in range(rng.randrange(0, 30))) for _ in range(8)]
    lines = [(k + 1, x) for k, text in enumerate(texts) for x in text.splitlines()]
    bare = lambda x: marks.get(x) in ("article", "chapter", "section", "subsection") and x != "Pasal 5 isi lima"
    open_, out, rank = {}, [], ("opener", "chapter", "section", "subsection", "article", "paragraph", "letter")
    kind, held = "preamble", []

    def close():
        said = [x for x in held if x[1]]
        if said:
            body = []
            for _, x in held:
                if x or (body and body[-1]):
                    body.append(x)
            pages = [p for i, (p, x) in enumerate(held) if x or any(y for _, y in held[:i]) and held[i - 1][1]]
            where = " / ".join(open_[x] for x in ("section", "subsection") if x in open_) or None
            par = open_.get("paragraph") and open_["paragraph"] + (f", Huruf {open_['letter']}" if "letter" in open_ else "")
            out.append((open_.get("chapter"), where, open_.get("article"), par, said[0][0], pages[-1], "\n".join(body).strip(), kind))
        held.clear()

    for i, (page, x) in enumerate(lines):
        mark = marks.get(x)
        follow = next((y for _, y in lines[i + 1 :] if y), "")
        if mark == "article" and bare(x) and bare(follow):
            continue
        refused = mark in ("article", "paragraph", "letter") and kind == "considerans" or mark == "paragraph" and "article" not in open_ or mark == "letter" and not {"article", "paragraph"} <= set(open_)
        if mark is None or refused:
            held.append((page, x))
            continue
        close()
        opener = mark in ("appendix", "explanation", "considerans", "resolution")
        for lower in rank[rank.index("opener" if opener else mark) :]:
            if lower not in ("chapter", "article") or lower == mark or opener and lower == "article":
                open_.pop(lower, None)
        if opener:
            kind = mark
            if mark in ("appendix", "explanation"):
                open_["chapter"] = x
            held.append((page, x))
        else:
            open_[mark] = {"article": x[:7], "paragraph": "Ayat " + x[:3], "letter": "a"}.get(mark, x)
            if mark == "article" and kind in ("preamble", "resolution"):
                kind = "substantive"
            rest = {"Pasal 5 isi lima": "isi lima", "(2) isi dua": "isi dua", "a. butir": "butir"}.get(x)
            if rest:
                held.append((page, rest))
    close()
    assert [(r.chapter, r.section, r.article, r.paragraph, r.page_start, r.page_end, r.text, r.kind) for r in rows(spark, *texts)] == out


def test_segments_and_their_sql_on_statutes_without_items(spark, tmp_path):
    import duckdb

    from lexmill.plans import catalogue

    orders = [(1, 7, "O", "1-URGENT"), (2, 7, "F", "2-HIGH"), (3, 8, "O", "1-URGENT"), (4, 9, "O", "4-LOW"), (5, 9, "O", "4-LOW")]  # statute 7 has marks alone
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    items = [(3, n, 6, "R") for n in range(1, 4)] + [(4, n, 6, "R") for n in range(1, 1200)] + [(5, 1, 4, "R"), (5, 2, 7, "R"), (5, 3, 4, "R")]  # and statute 9 a page of more than 1,000 lines
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    for name in ("orders", "lineitem"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = db.execute(catalogue.oracle_sql()["tx_segment"])
    names = [d[0] for d in want.description]
    got = catalogue.queries()["tx_segment"](spark, str(tmp_path)).select(*names).collect()
    assert {tuple(r) for r in got} == set(want.fetchall())
    assert sorted(r.segment_id for r in got if r.kind == "unstructured") == ["7-page-00001", "7-page-00002"]


def test_segments_and_chunks_are_made_once(spark):
    """What reads them again reads stored rows (F20)."""
    from lexmill.operators import segments as seg
    from lexmill.plans import release
    from lexmill.plans.registry import Tables

    pages = spark.createDataFrame([(1, 1, "Pasal 1\n(1) isi satu\nPasal 2\nisi dua"), (2, 1, "tanpa tanda")], "document_id long, page long, text string")
    found = seg.segments(pages)
    assert any("segments-" in f for f in found.inputFiles())
    assert sorted((r.document_id, r.place, r.article, r.text) for r in found.collect()) == [(1, 1, "Pasal 1", "isi satu"), (1, 2, "Pasal 2", "isi dua"), (2, 1, None, "tanpa tanda")]
    read = release.tx_gates_clean(Tables(spark, "/root/testdata/sf0.001")).inputFiles()
    assert any("chunks-" in f for f in read) and not any("lineitem" in f for f in read)
