"""The training-data operators on small tables: brute force, round trips, and nulls, ties, repeated rows and empty tables."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import ann, language_id, line_dedup, mixing, packing, progressive_jpeg, queries, substring_dedup, token_files, tokens, toxicity
from lexmill.llm.jaccard_join import jaccard_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept_text string, taken long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(60)]
    line = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    shared = line(30)
    texts = ["\n".join(line(rng.randrange(1, 25)) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    texts += [texts[0], texts[1] + " more", texts[2].replace("w1 ", "w2 ", 1), shared, "x " + shared, shared + "\n" + shared, line(5000)]
    texts += ["", None, "   \n \t ", "one", "ONE", "é ü　ß", "a   b  c \n d", "%%% $$$ 123"]
    return [(i, x, ("en", "de")[i % 2] if i % 7 else None, ("a", "b", None)[i % 3], len(x or ""), 0.5, "k", 1) for i, x in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, corpus, empty):
    near = lambda a, b: a == b or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1) or (abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(max(len(a), len(b)))))
    seen, want = [], {}
    for d, text, *_ in corpus:
        lines = text.split("\n") if text is not None else []
        kept = []
        for x in lines:
            w = words_of(x)
            if not any(w == y or (min(len(w), len(y)) >= 6 and near(w, y)) for y in seen):
                kept.append(x)
            if w:
                seen.append(w)
        want[d] = (len(lines), len(lines) - len(kept), "\n".join(kept) if text is not None else None)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.line_dedup(docs).collect()} == want
    assert any(v[1] for v in want.values())
    assert line_dedup.line_dedup(empty).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_repeated_rows_are_no_witnesses_of_each_other(spark, parts):
    import corpus_pipeline

    once, twice = "a line of six words here", "b line of six other words now"
    texts = [(1, once), (1, once), (2, twice + "\n" + once), (2, twice + "\n" + once), (3, twice + "\n" + twice)]
    rows = spark.createDataFrame([(i, x, "en", "a", len(x)) for i, x in texts], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).repartition(parts)
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.line_dedup(rows).collect()) == [(1, 1, 0, once)] * 2 + [(2, 2, 1, twice)] * 2 + [(3, 2, 2, "")]
    assert sorted((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.lines(spark, rows, "").collect()) == [(1, once, len(once))] * 2 + [(2, twice, len(twice))] * 2


def test_chance_witness_hides_no_true_one(spark):
    chance, line = "w299 w955 w739 w951 w318 w22", "w503 w416 w739 w185 w312 w253"  # the top 36 bits of their keys are equal
    rows = spark.createDataFrame([(1, chance), (2, line), (3, line)], "doc_id long, text string").repartitionByRange(3, "doc_id")
    assert {r.doc_id: r.n_removed for r in line_dedup.line_dedup(rows).collect()} == {1: 0, 2: 0, 3: 1}


def test_pipeline_removes_exact_copies_of_short_lines(spark, docs, corpus):
    import corpus_pipeline

    menu = [(2000 + i, x, "en", "a", len(x), 0.5, "k", 1) for i, x in enumerate(["Home\nv1 v2 v3 v4 v5 v6", " Home \nv1 v2 v3 v4 v5\n\nAbout us", "About us", "About them\nHome\nv1 v2 v3 v4 v5", "home"])]
    corpus, docs = corpus + menu, docs.unionByName(spark.createDataFrame(menu, SCHEMA))
    near = lambda a, b: a == b or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1) or (abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(max(len(a), len(b)))))
    short, long, want = set(), [], {}
    for d, text, *_ in corpus:
        kept = []
        for x in text.split("\n") if text is not None else []:
            w = words_of(x)
            if not w or (tuple(w) not in short if len(w) < 6 else not any(near(w, y) for y in long)):
                kept.append(x)
            if len(w) < 6:
                short.add(tuple(w))
            else:
                long.append(w)
        left = "\n".join(kept) if text is not None else None
        if left == text or words_of(left):
            want[d] = left
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()} == want
    assert (want[2001], want[2003], 2002 in want) == ("v1 v2 v3 v4 v5\n\nAbout us", "About them", False)


def test_substring_dedup(docs, corpus, empty):
    first, all_words = {}, {d: words_of(x) for d, x, *_ in corpus}
    for d in sorted(all_words):
        for i in range(len(all_words[d]) - 12):
            first.setdefault(tuple(all_words[d][i : i + 13]), d)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs).collect()}
    for d, w in all_words.items():
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        assert got[d] == (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("few", [8, 1])
def test_jaccard_components(docs, corpus, empty, few, monkeypatch):
    monkeypatch.setattr("lexmill.llm.jaccard_join.FEW", few)  # with 1, all keys left open meet in blocks
    monkeypatch.setattr("lexmill.llm.jaccard_join.BLOCK", 8 * few)
    base = [f"v{i}" for i in range(80)]
    near = [(1000 + i, " ".join(w if (k * 7 + i * 3) % 61 else f"z{i}" for k, w in enumerate(base)), "en", "a", 1, 0.5, "k", 1) for i in range(24)]
    corpus, docs = corpus + near, docs.unionByName(docs.sparkSession.createDataFrame(near, SCHEMA))
    sets = {}
    for d, x, *_ in corpus:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()} == {d: (len(s), find(d)) for d, s in sets.items()}
    assert jaccard_components(empty).count() == 0


def test_encoder_equals_the_library():
    rng = random.Random(1)
    parts = ["a", "é", "Ġ", " ", "  ", "\n", "\t", ",", ".", "'s", "1", "23", " ", "　", "foo", "Bar", "<|endoftext|>", "😀", "_", "\x0b", "\x1c", "   ", " \n "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)] + [None, ""]
    e = tokens.Encoder(queries.vocabulary())
    ids, first = e.encode(pa.array(texts))
    for i, x in enumerate(e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[first[i] : first[i + 1]].tolist() == x.ids


def expected_ids(corpus, end):
    e = tokens.Encoder(queries.vocabulary())
    return {d: e.tokenizer.encode(x or "", add_special_tokens=False).ids + [end] for d, x, *_ in corpus}


def test_token_files(docs, corpus, empty):
    got = {r.doc_id: r for r in token_files.token_file_digests(docs, queries.vocabulary()).collect()}
    start = 0
    for d, ids in sorted(expected_ids(corpus, 0).items()):
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.token_file_digests(empty, queries.vocabulary()).count() == 0


def test_rows_of_one_id_are_ordered_by_their_tokens(spark):
    texts = [(7, "we saw the cat"), (7, "we saw the dog"), (7, "we saw the sun"), (9, None), (None, "x")]
    found = [sorted(map(tuple, token_files.token_file_digests(spark.createDataFrame(t, "doc_id long, text string").coalesce(1), queries.vocabulary()).filter("doc_id is not null").select("doc_id", "start", "n_tokens", "ids_crc32").collect())) for t in (texts, texts[2::-1] + texts[3:])]
    assert found[0] == found[1] and len(found[0]) == 4


def test_variable_length_coding():
    values = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    assert (token_files.unpack(*token_files.pack(values), len(values)) == values).all()
    assert not len(token_files.unpack(*token_files.pack(values[:0]), 0))


def test_packing(docs, corpus, empty):
    rows = packing.best_fit_packing(packing.document_pieces(docs, queries.vocabulary())).collect()
    ids = expected_ids(corpus, 2)
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    by_sequence = {}
    for r in rows:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= -(-sum(map(len, ids.values())) // 1024) + 1
    assert packing.best_fit_packing(packing.document_pieces(empty, queries.vocabulary())).count() == 0


def test_mixing(docs, corpus, empty):
    rows = mixing.mix_sources(mixing.measured(docs)).collect()
    assert len(rows) == len(corpus)
    size = {d: len(words_of(x)) for d, x, *_ in corpus}
    source = {d: s for d, _, _, s, *_ in corpus}
    total = {}
    for d, n in size.items():
        total[source[d]] = total.get(source[d], 0) + n
    order = sorted(total, key=lambda s: (s is None, s))
    weight = dict(zip(order, [5, 2, 1], strict=False))
    goal, open_ = {}, list(order)
    left = 1.5 * sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * total[s]]
        if not above:
            goal |= share
            break
        for s in above:
            goal[s] = 2 * total[s]
            left -= goal[s]
            open_.remove(s)
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == total[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert r.taken in (0, r["size"], 2 * r["size"])
    for s in order:
        assert abs(sum(r.taken for r in rows if r.source == s) - goal[s]) <= max(size.values())
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_sources(mixing.measured(docs)).collect()))
    assert mixing.mix_sources(mixing.measured(empty)).count() == 0


def test_images(docs, corpus, empty):
    got = {r.doc_id: r for r in progressive_jpeg.media_digests(docs).collect()}
    for d, x, *_ in corpus:
        raw = (x or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert progressive_jpeg.media_digests(empty).count() == 0


def test_decoded_media(spark):
    media = progressive_jpeg.encode_payload(bytes(range(64)) * 9)
    rows = spark.createDataFrame([(1, bytearray(media)), (2, None), (3, bytearray()), (None, bytearray(media))], "doc_id long, media binary")
    picture = progressive_jpeg.rgb(progressive_jpeg.decode_coefficients(media))
    whole, none = (*picture.shape[:2], picture.tobytes()), (None, None, None)
    got = {r.media_id: (r.height, r.width, r.rgb and bytes(r.rgb)) for r in progressive_jpeg.decode_media(rows).collect()}
    assert got == {1: whole, 2: none, 3: none, None: whole}
    assert progressive_jpeg.decode_media(rows.limit(0)).count() == 0


def test_both_ways_of_reading_scans_agree():
    payload = np.random.default_rng(1).integers(0, 256, 64 * 9, dtype=np.uint8).tobytes()
    media = progressive_jpeg.encode_payload(payload)
    fast, slow = progressive_jpeg.decode_coefficients(media), progressive_jpeg.decode_coefficients(media, by_symbol=True)
    assert all((a.coefficients == b.coefficients).all() for a, b in zip(fast.components, slow.components, strict=True))
    assert progressive_jpeg.payload_of(slow) == payload
    assert progressive_jpeg.rgb(fast).shape == (fast.height, fast.width, 3)


def test_nearest(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(700, 8))
    m[300:360] = m[10]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (950, [0.0] * 8), (1000, [float("nan")] * 8), (1050, [1.0, None] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_to_every(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert sorted(got) == list(range(0, 700, 50))
    for q, found in got.items():
        score = np.round(unit @ unit[q], 12)
        want = sorted((-s, i) for i, s in enumerate(score) if i != q)[:5]
        assert [found[k][0] for k in range(1, 6)] == [i for _, i in want]
    assert ann.nearest_to_every(df.limit(0)).count() == 0


def test_language(docs, corpus, empty, spark):
    rows = language_id.identified(docs).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        text = corpus[r.doc_id][1]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= r.score <= 1
    assert language_id.identified(empty).count() == 0
    clear = spark.createDataFrame([(i, ("der die und nicht ", "the and of is ")[i % 2] * 5, ("de", "en")[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    assert all(r.lang_pred == ("de", "en")[r.doc_id % 2] for r in language_id.identified(clear).collect())


def test_toxicity(spark, docs, empty):
    texts = [(i, ("you idiot and moron " if i % 4 == 0 else "a kind and calm word ") * 3 + f"w{i % 9}") for i in range(200)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    for r in toxicity.toxicity(rows, labels).collect():
        assert r.predicted == int(r.doc_id % 4 == 0) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert toxicity.toxicity(docs, labels.limit(0)).filter(F.col("score").between(0, 1)).count() == docs.count()
    assert toxicity.toxicity(empty, labels).count() == 0


def test_a_document_with_different_labels_is_toxic(spark):
    rows = spark.createDataFrame([(i, ("you idiot and moron " if i % 2 else "a kind and calm word ") * 3) for i in range(60)], "doc_id long, text string")
    labels = [(i, int(i % 2)) for i in range(60)]
    found = []
    for more in ([(i, 0) for i in range(1, 60, 2)], []):
        for order in (1, -1):
            frame = spark.createDataFrame((labels + more)[::order], "doc_id long, toxic int").coalesce(1)
            found.append(sorted((r.doc_id, round(r.score, 9)) for r in toxicity.toxicity(rows, frame).collect()))
    assert all(x == found[0] for x in found)
