"""Line dedup: a line goes if an earlier line holds the same words, or, from six words on, the same but for one.

Each line emits its word sequence and all variants with one word deleted as hashed keys. Equal keys meet in a hash bucket:
the full sequences of two lines (equal lines), variants with the same place deleted (one word replaced) or a full sequence and a
variant (one word more or less). Each meeting names an earlier line as witness, whose variant is digested from its text and
compared with the removed line's own before anything goes, so a chance meeting of hashes removes nothing. Keys travel with all
their 64 bits: a key has one witness, and one met by chance would hide the true ones behind it.

A chunk of rows sends one entry per key and deleted place, so a line that a third of all rows hold sends no more entries than
there are chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .packed import cut, planes, unplanes
from .slots import has_slot, slots_of
from .tables import buckets_for, dealt_join, stored, text_bytes
from .words import U64, buffers, give_back, mix, rows_of, slices, word_bounds, word_hashes

PACKED = "kind int, bucket int, a binary, b binary, c binary, d binary, e binary, f binary"
PACKED_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *[(x, pa.binary()) for x in "abcdef"]])
CLAIMS = "doc_id long, line long, place long, source_id long, source_line long, source_place long"
BASE, COUNT, SHORT = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xD6E8FEB86659FD93)
_small, _large = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _squeezed(values: np.ndarray) -> bytes:
    return _small.compress(planes(values))


def _opened(blob: bytes) -> np.ndarray:
    return unplanes(_large.decompress(blob))


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, PACKED_ARROW.types, strict=True)], schema=PACKED_ARROW)


def _claims(n_buckets: int, claims: list[np.ndarray]) -> list[tuple]:
    """Claims (doc, line, place, source, source line, source place), packed by the bucket of their document."""
    order, bounds = cut(claims[0] % n_buckets)
    claims = [x[order] for x in claims]
    return [(1, int(claims[0][i] % n_buckets), *(_squeezed(x[i:j]) for x in claims)) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def _earlier(ids: np.ndarray, line: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the lines at a come before those at b."""
    return (ids[a] < ids[b]) | ((ids[a] == ids[b]) & (line[a] < line[b]))


def line_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word hashes; for each line that has words its first word (one more than lines), row and number in the row."""
    starts, ends, first = word_bounds(data, offsets)
    breaks = np.r_[0, np.cumsum(data == 10)]
    row = rows_of(first)
    line = breaks[starts] - breaks[offsets[row]]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (line[1:] != line[:-1])]) if len(row) else np.zeros(0, np.int64)
    return word_hashes(data, starts, ends), np.r_[new, len(row)], row[new], line[new]


def variant_keys(hashes: np.ndarray, bounds: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the lines asked: keys, line and deleted place (0: none, then from 1) of the full sequence and each variant."""
    size = np.diff(bounds)
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], size)
    power = np.cumprod(np.r_[U64(1), np.full(int(size.max(initial=0)), BASE)])
    before = np.r_[U64(0), np.cumsum(hashes * power[place])]
    after = np.r_[U64(0), np.cumsum(hashes * power[np.maximum(place - 1, 0)])]
    n = size[lines]
    full = before[bounds[lines + 1]] - before[bounds[lines]] + n.astype(np.uint64) * COUNT
    of = np.repeat(np.arange(len(lines)), n)
    word = np.repeat(bounds[lines] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    begin, end = bounds[lines][of], bounds[lines + 1][of]
    less = before[word] - before[begin] + after[end] - after[word + 1] + (n[of] - 1).astype(np.uint64) * COUNT
    return mix(np.r_[full, less]), np.r_[np.arange(len(lines)), of], np.r_[np.zeros(len(lines), np.int64), word - begin + 1]


def _described(n_buckets: int, least_words: int, exact_words: int, most: int = 1_200_000):
    def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, ids, line, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.argsort(keys)
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        own = order[np.r_[False, same] | np.r_[same, False] if len(keys) else np.zeros(0, bool)]
        own = own[np.lexsort((line[own], ids[own], place[own], keys[own]))]
        head = np.r_[True, (keys[own][1:] != keys[own][:-1]) | (place[own][1:] != place[own][:-1])] if len(own) else np.zeros(0, bool)
        first = own[np.flatnonzero(head)][np.cumsum(head) - 1] if len(own) else own
        # an entry of the same id and line is no earlier line but a repeated row's: it claims nothing and goes on to its bucket
        later = ~head & _earlier(ids, line, first, own)
        rows = _claims(n_buckets, [x for at in (own[later], first[later]) for x in (ids[at], line[at], place[at])])
        gone = np.zeros(len(keys), bool)
        gone[own[later]] = True
        order = order[~gone[order]]
        ranked = keys[order]
        bounds = np.searchsorted(((ranked >> U64(32)) * U64(n_buckets)) >> U64(32), np.arange(n_buckets + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[k] : bounds[k + 1]]
            docs, doc = np.unique(ids[own], return_inverse=True)
            rows.append((0, int(k), _squeezed(np.diff(keys[own].view(np.int64), prepend=0)), _squeezed(doc), _squeezed(line[own]), _squeezed(place[own]), _squeezed(np.diff(docs, prepend=0)), None))
            if len(rows) >= 64:
                yield from _rows(rows).to_batches()
                rows = []
        if rows:
            yield from _rows(rows).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                hashes, bounds, row, line = line_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size = np.diff(bounds)
                lines, short = np.flatnonzero(size >= least_words), np.flatnonzero((size >= exact_words) & (size < least_words))
                if len(lines):
                    # of equal lines of one document only the first has variants: whatever they show, it shows
                    keys, of, place = variant_keys(hashes, bounds, lines)
                    parts.append((keys, ids[i + row[lines[of]]], line[lines[of]].astype(np.int32), place.astype(np.int32)))
                    held += len(keys)
                if len(short):
                    keys = variant_keys(hashes, bounds, short)[0][: len(short)] ^ SHORT  # meets no variant of a longer line
                    parts.append((keys, ids[i + row[short]], line[short].astype(np.int32), np.zeros(len(short), np.int32)))
                    held += len(keys)
                if held >= most:
                    yield from flush(parts)
                    parts, held = [], 0
        if held:
            yield from flush(parts)
        give_back()

    return run


def _met(n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        if not table.num_rows or table["kind"][0].as_py() == 1:
            return table
        keys, ids, line, place = [], [], [], []
        for a, b, c, d, e in zip(*(table[x].to_pylist() for x in "abcde"), strict=True):
            keys.append(np.cumsum(_opened(a)))
            ids.append(np.cumsum(_opened(e))[_opened(b)])
            line.append(_opened(c).astype(np.int32))
            place.append(_opened(d).astype(np.int32))
        keys, ids, line, place = map(np.concatenate, (keys, ids, line, place))
        order = np.argsort(keys)
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        own = order[np.r_[False, same] | np.r_[same, False]]
        own = own[np.lexsort((place[own], line[own], ids[own], keys[own]))]
        keys, ids, line, place = keys[own], ids[own], line[own], place[own]
        rows = []

        def claim(later: np.ndarray, witness: np.ndarray) -> None:
            keep = _earlier(ids, line, witness, later)
            later, witness = later[keep], witness[keep]
            rows.extend(_claims(n_buckets, [x for at in (later, witness) for x in (ids[at], line[at], place[at])]))

        if len(own):
            # the same place deleted, or nothing: against the earliest of them
            by_place = np.lexsort((np.arange(len(own)), place, keys))
            head = np.r_[True, (keys[by_place][1:] != keys[by_place][:-1]) | (place[by_place][1:] != place[by_place][:-1])]
            claim(by_place, by_place[np.flatnonzero(head)][np.cumsum(head) - 1])
            # full sequences against the earliest variant of their key, and the other way round
            group = np.cumsum(np.r_[True, keys[1:] != keys[:-1]]) - 1
            for full in (True, False):
                mine, other = np.flatnonzero((place == 0) == full), np.flatnonzero((place == 0) != full)
                if len(mine) and len(other):
                    known, at = np.unique(group[other], return_index=True)
                    earliest = np.full(group[-1] + 1, -1)
                    earliest[known] = other[at]
                    mine = mine[earliest[group[mine]] >= 0]
                    claim(mine, earliest[group[mine]])
        give_back()
        return _rows(rows)

    return run


def _reduced(table: pa.Table) -> pa.Table:
    """Of a document bucket: a line with an equal earlier line keeps that witness alone; the others keep each they have."""
    columns = [np.concatenate([_opened(x) for x in table[c].to_pylist()]) for c in "abcdef"]
    doc, line, place, source, source_line, source_place = columns
    order = np.lexsort((source_place, source_line, source, place, place + source_place > 0, line, doc))
    doc, line, place, source, source_line, source_place = (x[order] for x in columns)
    new_line = np.r_[True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])]
    new = new_line | np.r_[True, (place[1:] != place[:-1]) | (source[1:] != source[:-1]) | (source_line[1:] != source_line[:-1]) | (source_place[1:] != source_place[:-1])]
    exact = (place == 0) & (source_place == 0)
    has_exact = exact[np.flatnonzero(new_line)][np.cumsum(new_line) - 1]
    keep = np.flatnonzero(np.where(has_exact, new_line, new))
    return pa.table([pa.array(x[keep]) for x in (doc, line, place, source, source_line, source_place)], names=[x.split()[0] for x in CLAIMS.split(", ")])


def _digest(line: bytes, place: int) -> bytes:
    words = line.split()  # splits at exactly 0x20 and 0x09-0x0D
    if place:
        del words[place - 1]
    return md5(b" ".join(words), usedforsecurity=False).digest()


def _source_digests(docs: pa.Table, asked: pa.Table) -> pa.Table:
    want: dict[int, list] = {}
    for s, n, p in zip(*(asked[c].to_pylist() for c in ("source_id", "source_line", "source_place")), strict=True):
        want.setdefault(s, []).append((n, p))
    out = set()
    for d, text in zip(docs["doc_id"].to_pylist(), docs["text"].cast(pa.binary()).to_pylist(), strict=True):
        if d in want:
            lines = (text or b"").split(b"\n")
            out.update((d, n, p, _digest(lines[n], p)) for n, p in want[d] if n < len(lines))
    columns = zip(*out, strict=True) if out else [[]] * 4
    return pa.table(dict(zip(("source_id", "source_line", "source_place", "digest"), (pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)), strict=True)))


def _removed(docs: pa.Table, claims: pa.Table) -> pa.Table:
    have: dict[int, dict[int, list]] = {}
    for d, n, p, digest in zip(*(claims[c].to_pylist() for c in ("doc_id", "line", "place", "digest")), strict=True):
        have.setdefault(d, {}).setdefault(n, []).append((p, digest))
    total, gone, kept = [], [], []
    for d, text in zip(docs["doc_id"].to_pylist(), docs["text"].cast(pa.binary()).to_pylist(), strict=True):
        lines = text.split(b"\n") if text is not None else []
        own = have.get(d, {})
        left = [x for n, x in enumerate(lines) if not any(_digest(x, p) == digest for p, digest in own.get(n, ()))]
        total.append(len(lines))
        gone.append(len(lines) - len(left))
        kept.append(b"\n".join(left) if text is not None else None)
    out = docs.drop_columns(["bucket", "text"])
    for name, column in (("n_lines", pa.array(total, pa.int64())), ("n_removed", pa.array(gone, pa.int64())), ("kept_text", pa.array(kept, pa.binary()).cast(pa.string()))):
        out = out.append_column(name, column)
    return out


def line_dedup(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = 6, keep: tuple[str, ...] = (), exact_words: int = 1) -> DataFrame:
    """Per row: doc_id, the columns in `keep`, n_lines, n_removed, kept_text (kept lines joined by a line feed).

    Lines end at line feeds; words are runs of other bytes than 0x20 and 0x09-0x0D. A line of at least `least_words` words goes
    if an earlier one (of a smaller id, or of the same id and further up) that is as long holds the same words, but for at most
    one inserted, deleted or replaced; lines are judged on the input, so a removed line still removes later ones. Shorter
    lines of at least `exact_words` words go where an earlier line holds exactly the same words; all other lines stay.
    A null text has no lines and stays null, an empty one has one line. Rows without an id lose nothing and serve
    as no witness; rows that repeat an id with the same text are not earlier than each other, and each is returned. An empty
    table gives an empty result. Other columns are not read.
    """
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), *keep, F.col(text_column).cast("string").alias("text"))
    n_buckets = buckets_for(text_bytes(docs)) | 1
    packed = docs.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(_described(n_buckets, least_words, exact_words), PACKED)
    met = packed.groupBy("kind", "bucket").applyInArrow(_met(n_buckets), PACKED)
    claims = stored(met.select("bucket", *"abcdef").groupBy("bucket").applyInArrow(_reduced, CLAIMS), "claims")
    bucket = lambda c: F.coalesce(F.pmod(F.col(c), F.lit(n_buckets)), F.lit(0)).cast("int").alias("bucket")
    asked = claims.select("source_id", "source_line", "source_place").distinct()
    sources = docs.filter(has_slot("doc_id", slots_of(claims, "source_id")))
    digests = sources.select(bucket("doc_id"), "doc_id", "text").groupBy("bucket").cogroup(asked.withColumn("bucket", bucket("source_id")).groupBy("bucket")).applyInArrow(_source_digests, "source_id long, source_line long, source_place long, digest binary")
    checked = dealt_join(claims, digests, ["source_id", "source_line", "source_place"], "doc_id").select(bucket("doc_id"), "doc_id", "line", "place", "digest")
    schema = StructType([*docs.select("doc_id", *keep).schema.fields, StructField("n_lines", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
    affected = has_slot("doc_id", slots_of(claims, "doc_id"))
    changed = docs.filter(affected).select(bucket("doc_id"), "doc_id", *keep, "text").groupBy("bucket").cogroup(checked.groupBy("bucket")).applyInArrow(_removed, schema)
    breaks = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    rest = docs.filter(~affected).select("doc_id", *keep, F.coalesce(breaks, F.lit(0)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept_text"))
    return changed.unionByName(rest)
