"""Fill-in-the-middle, the filter audit and token counts against plain versions, SQL and the library."""

import random
import re
import string
from hashlib import sha256
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import filter_audit, queries, sql, token_counts
from lexmill.llm.fill_in_middle import UnitIndex, fill_in_middle, restored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, form string, mask int, digest string, part string, good int, n_tokens long"
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    letters = string.ascii_letters + " \n\t.,#$%&*|0123456789éßİΣ中𝄞́'"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 400))) for _ in range(80)]
    texts += [" ".join(rng.choice(["alpha", "Beta", "GAMMA"]) for _ in range(250)), " ".join(f"w{i}" for i in range(400))]
    texts += ["x" * 5000, "中" * 700, " ".join(f"Word{i % 977}" for i in range(20_000)), "", None, " \n ", "a<P>b", "<S>", "text <M>", texts[0], texts[0], "ONE"]
    return [(i, x, "en", ("a", "b", None, "")[i % 4], len(x or ""), 5, "f", 3, "d", "p", 1, 9) for i, x in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    odd = [(None, "nobody's text", *corpus[0][2:]), (None, None, *corpus[0][2:]), corpus[3], (3, "another text of three", *corpus[3][2:])]
    return spark.createDataFrame([*corpus, *odd], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sql_rows(text, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, pa.Table.from_pylist([r.asDict() for r in frame.collect()], schema=frame.limit(0).toArrow().schema))
    found = con.execute(text)
    return [d[0] for d in found.description], sorted(map(tuple, found.fetchall()), key=repr)


def middle_of(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("every", [1, 3, 256])
def test_fill_in_middle(docs, empty, every):
    made = fill_in_middle(docs, keep=("doc_id", "text", "lang"), every=every).withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    assert len(made) == docs.count()
    for r in made:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == middle_of(r.doc_id, r.text)
        assert r.again == (r.text or "")
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fill_in_middle(empty).count() == 0
    with pytest.raises(ValueError, match="form, n"):
        fill_in_middle(docs, keep=("doc_id", "n", "form"))


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1 << 20])
def test_checkpoints_find_every_cut(block):
    texts = ["", "ab c", "é𝄞a", "", "zzzzzzzzzzzzzzzzzzzzzzzz1", "中", "a" * 40 + " b" * 40]
    raw = [x.encode() for x in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    index = UnitIndex(np.frombuffer(b"".join(raw), np.uint8), offsets, every=5, block=block)
    for row, text in enumerate(texts):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        assert index.n[row] == len(units)
        for cut in range(len(units)):
            place, point = index.find(np.array([row]), np.array([cut]))
            head = "".join(units[:cut])
            assert (place[0], point[0]) == (len(head.encode()), len(head))


def test_fill_in_middle_against_sql(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    mine = queries.op11_fill_in_middle(spark, str(tmp_path))
    names, want = sql_rows(sql.ORACLES["op11_fill_in_middle"], documents=docs)
    assert names == mine.columns
    assert sorted(map(tuple, mine.collect()), key=repr) == want


def plain_audit(rows, labels):
    """(part, order, step) -> measures, row by row."""
    first = {}
    for d, text, source in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1 and d is not None} for k in (0, 1))
    judged = []
    for d, text, source in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and d > first[text]}
        judged.append((source or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in judged}:
        own = [x[1:] for x in judged if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for i, x in enumerate(order):
                earlier = set(order[:i])
                removed = [y for y in own if x in y[0] and not y[0] & earlier]
                shapley[x] += len(removed)
                out[part, order, i + 1] = [sum(not y[0] & (earlier | {x}) for y in own), len(removed), sum(x in y[0] and bool(y[0] & earlier) for y in own), sum(y[0] == {x} for y in own), sum(y[1] for y in removed), sum(y[2] for y in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark, docs, empty, tmp_path):
    labels = [(i, i % 3 % 2, int(i % 5 == 0)) for i in range(0, 90, 2)] + [(4, 1, 1), (4, 0, 0), (6, None, None), (None, 1, 1), (10_000, 1, 1)]
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    made = filter_audit.filter_audit(docs, said)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in made.collect()}
    assert got == plain_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], labels)
    assert len(got) == 3 * 600 and all(any(v[k] for v in got.values()) for k in range(7))
    _, want = sql_rows(sql.ORACLES["op12_filter_audit"], documents=docs, labels=said)
    assert sorted(map(tuple, made.collect()), key=repr) == want
    assert filter_audit.filter_audit(empty, said).count() == 0
    none = filter_audit.filter_audit(docs, said.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.sum("removed")).first()
    assert none[0] == none[1] == 0 < none[2]


def test_audit_of_any_filters(spark):
    masks = spark.createDataFrame([("p", 0, None, None), ("p", 1, True, None), ("p", 3, True, True)], "part string, mask int, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.interaction_audit(masks, "XY").collect()}
    assert got == {("XY", 1): (1, 2, 0, 1, 2, 1, 3), ("XY", 2): (1, 0, 1, 0, 0, 0, 1), ("YX", 1): (2, 1, 0, 0, 1, 1, 1), ("YX", 2): (1, 1, 1, 1, 1, 0, 3)}
    with pytest.raises(ValueError):
        filter_audit.interaction_audit(masks, "ABCDEFG")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))


def test_token_counts(docs, empty):
    made = token_counts.token_counts(docs, queries.vocabulary("word_bpe_49k.json"), 300, keep=("doc_id", "text", "n")).collect()
    lib = library()
    assert len(made) == docs.count()
    for r in made:
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 300)
    assert {r.over_limit for r in made} == {True, False}
    assert token_counts.token_counts(empty, queries.vocabulary("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError, match="n_tokens"):
        token_counts.token_counts(docs, queries.vocabulary("word_bpe_49k.json"), keep=("doc_id", "n_tokens"))


def test_counts_of_odd_texts_are_the_librarys():
    rng = random.Random(11)
    lib, own = library(), token_counts.TokenCounter(queries.vocabulary("word_bpe_49k.json"))
    alphabet = [*string.ascii_letters * 4, *" \n\t'!?.,-_0123456789<|>", "'s", "'LL", "é", "é", "ß", "İ", "Σ", "中", "𝄞", "️", "\x00", "\x1c", "\x85", "\xa0", " ", "<|endoftext|>", "<|startoftext|>", "ǅ", "٣", "हि"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120))) for _ in range(800)]
    texts += ["a" * n for n in (1, 2, 3, 255, 256, 257, 4001)] + ["ab" * 700, "".join(rng.choice("etaoin") for _ in range(6000)), "x" * 300 + " " + "é" * 300, "<|endoftext|>" * 5, "a<|endoftext|>b'<|startoftext|>S"]
    got = own.count(pa.array(texts))
    want = [len(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False)]
    assert [(t, n) for t, n, w in zip(texts, got, want, strict=True) if n != w] == []
    assert own.count(pa.array(texts[::-1])).tolist() == want[::-1]


def test_new_queries_against_sql_on_the_tables(spark):
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for f in (queries.op11_fill_in_middle, queries.op12_filter_audit):
        made = f(spark, FOLDER)
        want = con.execute(sql.ORACLES[f.__name__])
        assert [d[0] for d in want.description] == made.columns
        assert sorted(map(tuple, made.collect()), key=repr) == sorted(want.fetchall(), key=repr)
    lib = library()
    want = {d: len(lib.encode(t or "", add_special_tokens=False).ids) for d, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}
    assert {r.doc_id: r.n_tokens for r in queries.op13_token_counts(spark, FOLDER).collect()} == want
