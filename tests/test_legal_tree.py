"""The tree of statutes on literal documents, all read in one pass, and against a plain loop over stacks."""

import random

import pytest

from lexmill.operators import legal_tree

DOCUMENTS = {
    "preamble": ["PERATURAN PEMERINTAH REPUBLIK INDONESIA\nMenimbang: bahwa perlindungan pekerja diperlukan;\nMengingat: Pasal 5 Undang-Undang Dasar;\nMEMUTUSKAN:\nMenetapkan: PERATURAN PEMERINTAH TENTANG PKWT.\nBAB I\nKETENTUAN UMUM\nPasal 1\n(1) Pekerja adalah setiap orang yang bekerja.\n(2) Pengusaha wajib memenuhi hak pekerja."],
    "levels": ["BAB II\nHUBUNGAN KERJA\nBagian Kesatu\nUmum\nParagraf 1\nPerjanjian Kerja\nPasal 5\n(1) Perjanjian kerja dibuat secara tertulis."],
    "pages": ["", "Pasal 15\n(1) Pengusaha wajib memberikan", "uang kompensasi kepada pekerja.\n(2) Ketentuan lebih lanjut berlaku."],
    "references": ["Pasal 8\n(1) Informasi sebagaimana dimaksud dalam", "ayat\n(1), diperoleh dari semua pihak terkait.\nPasal 8 ...\n(2) Data wajib diperbarui."],
    "cited": ["Pasal 12\nKetentuan berlaku.\nPasal 12 sampai dengan Pasal 25 diatur dengan Peraturan Menteri.\nPasal 13\nsebagaimana dimaksud dalam\nPasal 4\nberlaku.\nsesuai ayat\n(3)\nselesai."],
    "explanation": ["BAB I\nKETENTUAN UMUM\nPasal 1\nKetentuan normatif.\nPENJEI.ASAN\nPasal 1\nCukup jelas."],
    "annex": ["LAMPIRAN I\nPedoman K3\n(1) Pelaporan insiden.\n(2) Pelaporan bahaya.\nLampiran\nyang merupakan bagian"],
    "roles": ["BAB IV\nKETENTUAN PERALIHAN\nPasal 30\nKetentuan lama tetap berlaku.\nKETENTUAN PENUTUP\nPasal 31\nBerlaku."],
    "malformed": ["BAB I\nPasal 1\nKetentuan pertama.\nPasal ???\nTeks rusak."],
    "empty": ["", ""],
    "verbs": ["Pasal 41\n(1) Pemerintah\nmenetapkan\nkebijakan.\nbagian/unit yang menangani K3.\n(2) Masyarakat mengawasi."],
    "amended": ["Pasal 10\nBeberapa ketentuan dalam Undang-Undang Nomor 1 diubah:\nPasal 1\nPekerja berhak atas upah.\nPasal 1 1\nBeberapa ketentuan dalam Undang-Undang Nomor 2 diubah:\nPasal 1\nPengusaha wajib membayar upah.\n2. Ketentuan Pasal 5 diubah:\nPasal 5\nIsi.\nPasal 6\nIsi.\nPasal 7\nIsi."],
    "items": ["Bagian Kesatu\nPerubahan\n1. Ketentuan Pasal 1 diubah sehingga berbunyi sebagai berikut:\nPasal 1\nKetentuan pertama.\n2. Ketentuan Pasal 1 diubah sehingga berbunyi sebagai berikut:\nPasal 1\nKetentuan kedua."],
    "omnibus": ["PENJELASAN\nPasal 17\nAngka 1\nPasal 1\nCukup jelas.\nPasal 18\nAngka 1\nPasal 1\nCukup jelas."],
    "catchword": ["Pasal 1\nPekerja berhak atas upah.\nPasal 2", "REPUBLIK INDONESIA\nPasal 2\n(1) Upah dibayarkan."],
    "margin": ["BAB VIII\nPEMBAYARAN UPAH\n| Pasal 53,\n(1) Upah dibayar."],
    "repeated": ["PENJELASAN\nPasal 80\nCukup jelas.\nPasal 81\nCukup jelas.\nPasal 80\nCukup  JELAS.\nPasal 81\nCukup jelas."],
    "late": ["Teks awal.\nlagi.\nBAB I Judul Sendiri\nisi bab.\nBAB II\nJudul\nyang Panjang\nKetentuan Umum\nisi."],
}


@pytest.fixture(scope="module")
def trees(spark):
    rows = [(d, i + 1, x) for d, texts in DOCUMENTS.items() for i, x in enumerate(texts)] + [("null", 1, None)]
    pages = spark.createDataFrame(rows, "document_id string, page int, text string").repartition(4)
    out = {}
    for r in legal_tree.legal_tree(pages, spark.createDataFrame([("levels", "Judul")], "document_id string, title string")).collect():
        out.setdefault(r.document_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.place) for k, v in out.items()}


def shape(rows):
    """(type, identifier, the parent's identifier) of all parts but the document."""
    name = {r.node_id: r.identifier for r in rows}
    return [(r.type, r.identifier, name[r.parent] if name[r.parent] != rows[0].identifier else None) for r in rows[1:]]


def test_preamble_and_decision(trees):
    rows = trees["preamble"]
    assert shape(rows) == [("unstructured", "Unstructured 1", None), ("menimbang", "Menimbang", None), ("mengingat", "Mengingat", None), ("memutuskan", "Memutuskan", None), ("menetapkan", "Menetapkan", "Memutuskan"), ("bab", "BAB I", None), ("pasal", "Pasal 1", "BAB I"), ("ayat", "Ayat (1)", "Pasal 1"), ("ayat", "Ayat (2)", "Pasal 1")]
    assert (rows[6].title, rows[6].role) == ("KETENTUAN UMUM", "ketentuan_umum")
    assert rows[4].text == "MEMUTUSKAN:\nMenetapkan: PERATURAN PEMERINTAH TENTANG PKWT."
    assert rows[0].text == DOCUMENTS["preamble"][0] and rows[7].text.startswith("Pasal 1\n(1) Pekerja") and [r.node_id for r in rows] == [f"preamble:legal:{i:05d}" for i in range(10)]


def test_levels_and_titles(trees):
    rows = trees["levels"]
    assert shape(rows) == [("bab", "BAB II", None), ("bagian", "Bagian Kesatu", "BAB II"), ("paragraf", "Paragraf 1", "Bagian Kesatu"), ("pasal", "Pasal 5", "Paragraf 1"), ("ayat", "Ayat (1)", "Pasal 5")]
    assert [r.title for r in rows] == ["Judul", "HUBUNGAN KERJA", "Umum", "Perjanjian Kerja", None, None]
    late = trees["late"]
    assert [(r.type, r.title, r.role) for r in late[1:]] == [("unstructured", None, None), ("bab", "Judul Sendiri", None), ("bab", "Judul yang Panjang Ketentuan Umum", "ketentuan_umum")]
    assert trees["roles"][1].role == "ketentuan_peralihan" and shape(trees["roles"])[2:] == [("ketentuan_penutup", "KETENTUAN PENUTUP", "BAB IV"), ("pasal", "Pasal 31", "BAB IV")]


def test_spans(trees):
    rows = trees["pages"]
    assert [(r.identifier, r.page_start, r.page_end) for r in rows] == [("pages", 1, 3), ("Pasal 15", 2, 3), ("Ayat (1)", 2, 3), ("Ayat (2)", 3, 3)]
    assert rows[2].text == "(1) Pengusaha wajib memberikan\nuang kompensasi kepada pekerja."
    assert [(r.type, r.text, r.page_start, r.page_end) for r in trees["empty"]] == [("document", "", 1, 2)]
    assert [(r.type, r.text) for r in trees["null"]] == [("document", "")]


def test_references_open_nothing(trees):
    assert [x[1] for x in shape(trees["references"])] == ["Pasal 8", "Ayat (1)", "Ayat (2)"]
    assert "ayat\n(1), diperoleh" in trees["references"][2].text and "..." not in trees["references"][0].text
    assert [x[1] for x in shape(trees["cited"])] == ["Pasal 12", "Pasal 13"] and trees["cited"][2].text.endswith("dalam\nPasal 4\nberlaku.\nsesuai ayat\n(3)\nselesai.")
    assert shape(trees["verbs"]) == [("pasal", "Pasal 41", None), ("ayat", "Ayat (1)", "Pasal 41"), ("ayat", "Ayat (2)", "Pasal 41")]
    assert [x[:2] for x in shape(trees["catchword"]) if x[0] != "unstructured"] == [("pasal", "Pasal 1"), ("pasal", "Pasal 2"), ("ayat", "Ayat (1)")]
    assert shape(trees["margin"])[1:] == [("pasal", "Pasal 53", "BAB VIII"), ("ayat", "Ayat (1)", "Pasal 53")]


def test_scopes(trees):
    assert shape(trees["explanation"])[2:] == [("penjelasan", "Penjelasan", None), ("pasal", "Pasal 1", "Penjelasan")]
    assert trees["explanation"][3].text == "PENJEI.ASAN\nPasal 1\nCukup jelas."
    assert shape(trees["annex"]) == [("lampiran", "Lampiran", None), ("list_item", "1", "Lampiran"), ("list_item", "2", "Lampiran")]
    assert trees["annex"][3].text == "(2) Pelaporan bahaya.\nLampiran\nyang merupakan bagian"
    assert shape(trees["malformed"]) == [("bab", "BAB I", None), ("pasal", "Pasal 1", "BAB I"), ("unstructured", "Unstructured 1", "BAB I")]
    assert trees["malformed"][3].text == "Pasal ???\nTeks rusak." and "???" not in trees["malformed"][2].text


def test_amendment_scopes(trees):
    scope = lambda d: [(r.identifier, r.amendment_scope and r.amendment_scope.removeprefix(f"{d}:legal:")) for r in trees[d] if r.type == "pasal"]
    assert scope("amended") == [("Pasal 10", "00001"), ("Pasal 1", "00001"), ("Pasal 11", "00003"), ("Pasal 1", "00004"), ("Pasal 5", "00004"), ("Pasal 6", "00000:amendment-item:9"), ("Pasal 7", "00000:amendment-item:9")]
    assert scope("items") == [("Pasal 1", "00002"), ("Pasal 1", "00001:amendment-item:6")]
    assert scope("omnibus") == [("Pasal 17", "00002"), ("Pasal 1", "00002"), ("Pasal 18", "00004"), ("Pasal 1", "00004")]


def test_repeated_pairs(trees):
    assert [(r.identifier, r.source_duplicate_of) for r in trees["repeated"][2:]] == [("Pasal 80", None), ("Pasal 81", None), ("Pasal 80", "repeated:legal:00002"), ("Pasal 81", "repeated:legal:00003")]
    assert not any(r.source_duplicate_of for d, rows in trees.items() if d != "repeated" for r in rows)


def test_like_a_plain_loop(spark):
    rng = random.Random(4)
    level = {"bab": 1, "bagian": 2, "paragraf": 3, "pasal": 4, "ayat": 5}
    kinds = {"BAB I": "bab", "BAB IV Judul": "bab", "Bagian Kedua": "bagian", "Paragraf 2": "paragraf", "Pasal 7": "pasal", "Pasal 9": "pasal", "(1)": "ayat", "(2) isi dua.": "ayat"}
    texts = [["\n".join(rng.choice([*kinds, "isi kecil.", "Judul Besar", ""]) for _ in range(rng.randrange(40))) for _ in range(3)] for _ in range(12)]
    got = {}
    for r in legal_tree.legal_tree(spark.createDataFrame([(str(d), i, x) for d, doc in enumerate(texts) for i, x in enumerate(doc)], "document_id string, page int, text string")).collect():
        got.setdefault(r.document_id, []).append(r)
    for d, doc in enumerate(texts):
        lines = [(i, x) for i, text in enumerate(doc) for x in text.split("\n") if x]
        parts, stack, waits = [["document", None, None, []]], [0], None
        for at, (page, x) in enumerate(lines):
            kind = kinds.get(x)
            following = lines[at + 1 : at + 10]
            if kind == "pasal" and sum(p == page for p, _ in following) <= 2 and (page + 1, x) in following:
                continue
            if kind:
                while len(stack) > 1 and (parts[stack[-1]][0] == "unstructured" or level[parts[stack[-1]][0]] >= level[kind]):
                    stack.pop()
                parts.append([kind, stack[-1], "Judul" if x == "BAB IV Judul" else None, []])
                stack.append(len(parts) - 1)
                waits = stack[-1] if kind in ("bab", "bagian", "paragraf") and x != "BAB IV Judul" else None
            elif x == "Judul Besar" and waits is not None:
                parts[waits][2] = " ".join(filter(None, (parts[waits][2], x)))
            else:
                waits = None
                if len(parts) == 1:
                    parts.append(["unstructured", 0, None, []])
                    stack.append(1)
            for k in stack:
                parts[k][3].append(x)
        rows = sorted(got[str(d)], key=lambda r: r.place)
        assert [(r.type, r.parent and int(r.parent[-5:]), r.title, r.text) for r in rows] == [(a, b, c, "\n".join(e)) for a, b, c, e in parts]


def test_what_is_kept_of_texts(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([("a", 1, "BAB I\nKETENTUAN UMUM\nPasal 1\nisi\n(1) satu"), ("a", 2, "Pasal 1\nisi\nPasal 2\n(1) dua"), ("b", 1, ""), ("c", 1, "teks")], "document_id string, page int, text string")
    whole = legal_tree.legal_tree(pages)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(legal_tree.legal_tree(pages, text="sha256")) == rows(whole.withColumn("text", F.sha2("text", 256)))
    none = legal_tree.legal_tree(pages, text="none")
    assert none.columns == [c for c in whole.columns if c != "text"] and rows(none) == rows(whole.drop("text"))
