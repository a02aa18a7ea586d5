"""Substring dedup: long word sequences that an earlier document already holds are removed.

Every run of `window` words is an edge of a De Bruijn graph (from its first window-1 words to its last). Equal edges meet in
a hash bucket, where each repeated edge gets the coordinate of its first document. Back at their documents, edges that follow
each other both there and at the source compact into paths (document, place, source document, source place, length); each
distinct source path is digested once from the source's text, joined to the paths that claim it, and compared with the words
themselves before any word goes. No graph is built: nodes, degrees and compaction by joins are replaced by this merging of
consecutive hits within a document, as only the first document of each edge decides what goes.

Memory: a bucket holds the edges of about 6 MB of text; a task sends one entry per edge and first document, so an edge that a
third of all rows share sends no more entries than there are tasks (and places within those documents).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import bucket_of, cut, planes, unplanes
from .tables import buckets_for, stored, text_bytes
from .words import buffers, grams, slices, word_bounds, word_hashes

PACKED = "kind int, bucket int, a binary, b binary, c binary, d binary"
PACKED_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in "abcd"]])
PATHS = "doc_id long, place long, n long, source_id long, source_place long"
LOW48 = np.uint64((1 << 48) - 1)


def _hits(n_buckets: int, doc: np.ndarray, place: np.ndarray, source: np.ndarray, source_place: np.ndarray) -> list[tuple]:
    """Edges with an earlier copy, packed by the bucket of their document."""
    order, bounds = cut(doc % n_buckets)
    doc, place, source, source_place = doc[order], place[order], source[order], source_place[order]
    return [(1, int(doc[i] % n_buckets), planes(doc[i:j]), planes(place[i:j]), planes(source[i:j]), planes(source_place[i:j])) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def _first_and_later(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in ascending id order: the rows by key, for each the first row of its key, and whether its id is larger than there."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.zeros(0, bool)
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(ranked) else order
    return order, head, ids[order] > ids[head]


def _edges(window: int, n_buckets: int, most: int = 1_500_000):
    def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, ids, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        if np.any(ids[1:] < ids[:-1]):
            order = np.argsort(ids, kind="stable")
            keys, ids, place = keys[order], ids[order], place[order]
        order, head, later = _first_and_later(keys, ids)
        at, source = order[later], head[later]
        rows = _hits(n_buckets, ids[at], place[at], ids[source], place[source])
        rest = np.sort(order[~later])
        keys, ids, place = keys[rest], ids[rest], place[rest]
        order, bounds = cut(bucket_of(keys, n_buckets))
        keys, ids, place = keys[order], ids[order], place[order]
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            rows.append((0, int(bucket_of(keys[i : i + 1], n_buckets)[0]), planes(keys[i:j] & LOW48), planes(np.diff(ids[i:j], prepend=0)), planes(place[i:j]), None))
        for k in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 64], strict=True), PACKED_ARROW.types, strict=True)], schema=PACKED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                piece, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = word_bounds(piece, own)
                keys, row, place = grams(word_hashes(piece, starts, ends), first, window)
                parts.append((keys, ids[i + row], place))
                held += len(keys)
                if held >= most:
                    yield from flush(parts)
                    parts, held = [], 0
        if held:
            yield from flush(parts)

    return run


def _meet(n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        if not table.num_rows or table["kind"][0].as_py() == 1:
            return table
        a, b, c = (table[x].to_pylist() for x in "abc")
        keys, ids, place = np.concatenate([unplanes(x) for x in a]), np.concatenate([np.cumsum(unplanes(x)) for x in b]), np.concatenate([unplanes(x) for x in c])
        order = np.argsort(ids, kind="stable")
        keys, ids, place = keys[order], ids[order], place[order]
        order, head, later = _first_and_later(keys, ids)
        at, source = order[later], head[later]
        rows = _hits(n_buckets, ids[at], place[at], ids[source], place[source])
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, PACKED_ARROW.types, strict=True)], schema=PACKED_ARROW)

    return run


def _compact(table: pa.Table) -> pa.Table:
    """Edges that follow each other in the document and at the source become one path."""
    doc, place, source, source_place = (np.concatenate([unplanes(x) for x in table[c].to_pylist()]) for c in "abcd")
    order = np.lexsort((source_place, source, place, doc))
    doc, place, source, source_place = doc[order], place[order], source[order], source_place[order]
    once = np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])]
    doc, place, source, source_place = doc[once], place[once], source[once], source_place[once]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1) | (source[1:] != source[:-1]) | (source_place[1:] != source_place[:-1] + 1)])
    return pa.table({"doc_id": doc[new], "place": place[new], "n": np.diff(np.r_[new, len(doc)]), "source_id": source[new], "source_place": source_place[new]})


def _digest(words: list[bytes], place: int, n: int, window: int) -> bytes:
    return md5(b" ".join(words[place : place + n + window - 1]), usedforsecurity=False).digest()


def _source_digests(window: int):
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        want: dict[int, list] = {}
        for s, p, n in zip(*(asked[c].to_pylist() for c in ("source_id", "source_place", "n")), strict=True):
            want.setdefault(s, []).append((p, n))
        out = []
        for d, text in zip(docs["doc_id"].to_pylist(), docs["text"].cast(pa.binary()).to_pylist(), strict=True):
            if d in want:
                words = (text or b"").split()
                out += [(d, p, n, _digest(words, p, n, window)) for p, n in want[d] if p + n + window - 1 <= len(words)]
        columns = zip(*set(out), strict=True) if out else [[]] * 4
        return pa.table(dict(zip(("source_id", "source_place", "n", "digest"), (pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)), strict=True)))

    return run


def _remove(window: int):
    def run(docs: pa.Table, paths: pa.Table) -> pa.Table:
        have: dict[int, list] = {}
        for d, p, n, digest in zip(*(paths[c].to_pylist() for c in ("doc_id", "place", "n", "digest")), strict=True):
            have.setdefault(d, []).append((p, n, digest))
        total, removed, kept = [], [], []
        for d, text in zip(docs["doc_id"].to_pylist(), docs["text"].cast(pa.binary()).to_pylist(), strict=True):
            words = (text or b"").split()  # splits at exactly 0x20 and 0x09-0x0D
            total.append(len(words))
            if d in have:
                keep = np.ones(len(words), bool)
                for p, n, digest in have[d]:
                    if _digest(words, p, n, window) == digest:
                        keep[p : p + n + window - 1] = False
                words = list(compress(words, keep.tolist()))
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        return pa.table({"doc_id": docs["doc_id"], "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return run


def repeated_paths(docs: DataFrame, window: int, n_buckets: int) -> DataFrame:
    """Paths of `docs` (doc_id, text): where a document repeats a run of n windows that a smaller doc_id has."""
    packed = docs.select("doc_id", "text").mapInArrow(_edges(window, n_buckets), PACKED)
    hits = packed.groupBy("kind", "bucket").applyInArrow(_meet(n_buckets), PACKED)
    return hits.select("bucket", "a", "b", "c", "d").groupBy("bucket").applyInArrow(_compact, PATHS)


def substring_dedup(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 13) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window of `window` words that covers it also starts in a row with a smaller id; windows are judged on
    the input. Null texts have no words. Rows without an id lose nothing and serve as no source. Repeated rows of one id are
    equal, not earlier, and each is returned. An empty table gives an empty result. Other columns are not read.
    """
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    n_buckets = buckets_for(text_bytes(docs, "text")) | 1
    paths = stored(repeated_paths(docs, window, n_buckets), "paths")
    by_bucket = docs.select(F.coalesce(F.pmod("doc_id", F.lit(n_buckets)), F.lit(0)).cast("int").alias("bucket"), "doc_id", "text").groupBy("bucket")
    asked = paths.select("source_id", "source_place", "n").distinct().withColumn("bucket", F.pmod("source_id", F.lit(n_buckets)).cast("int"))
    digests = by_bucket.cogroup(asked.groupBy("bucket")).applyInArrow(_source_digests(window), "source_id long, source_place long, n long, digest binary")
    checked = paths.join(digests, ["source_id", "source_place", "n"]).select(F.pmod("doc_id", F.lit(n_buckets)).cast("int").alias("bucket"), "doc_id", "place", "n", "digest")
    return by_bucket.cogroup(checked.groupBy("bucket")).applyInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_text string")
