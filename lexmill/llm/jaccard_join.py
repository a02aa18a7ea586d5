"""Exact Jaccard join on word shingles by parity sketches, and the components of its links.

A document's set is its distinct runs of five lower-cased words (a shorter text: all its words as one). Sizes fall into bands
[2^j, 2^(j+1)). In a band the space of 64-bit shingle hashes is cut into 2^(j+1) blocks, and a block's parity vector (every
shingle flips the bit its hash names) is kept folded: the XOR of the hashes in it. The vectors' Hamming distance is at most the
symmetric difference, which a pair of sizes a and b that reaches similarity t bounds by (1-t)/(1+t) * (a+b) = D. By the
pigeonhole principle at most D blocks differ, so if both keep their D+1 first non-empty blocks in one global order, they share
one of them. The order puts blocks first whose rarest shingle is rare in the corpus (a counting sketch of fixed size over all
texts), so passages that many documents share seldom make candidates. Small bands have a block for each hash. A set also makes
candidates in the band above if a partner can be there.

Documents of equal sets form a class, found by the sets' digests, and only the first of a class has keys. Equal keys are found
in packed buckets. Candidates are joined in three rounds, each with size, Hamming (a dense parity sketch of two to four bits a
shingle) and exact checks: first every set with the first document of its key, in the task that made the keys and in the key's
bucket; then, for keys of three owners or more whose documents are still in different components, first documents outside a
crowded key's largest component with a few chosen ones of it, and at last all pairs between components
that pass the Hamming check, which keys of many owners make block by block before any pair becomes a row. Pairs in one component
aren't made, so a group of near copies costs links in proportion to its size, and no link that matters to a component is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .packed import bucket_of, planes, unplanes
from .slots import has_slot, slots_of
from .tables import buckets_for, dealt_join, stored
from .words import GRAM_KEYS, LOWER, U64, buffers, give_back, grams, mix, rows_of, slices, word_bounds, word_hashes

SHINGLE = 5
DESCRIBED = "doc_id long, n long, k1 long, k2 long, sketch array<long>, slice int, part int, counts binary"
DESCRIBED_ARROW = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "n", "k1", "k2")], ("sketch", pa.list_(pa.int64())), ("slice", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])
COUNTED = "slice int, part int, counts binary"
#: Kinds: a key's first document in a task, with how many more it has there; keys of several documents in a task; pairs (first document, other one).
KEYS, REPEATED, PAIRS = 0, 1, 2
PACKED = "kind int, bucket int, a binary, b binary, c binary"
PACKED_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in "abc"]])
FOUND = "kind int, key long, doc_id long"
FOUND_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64())])
LOW48 = U64((1 << 48) - 1)
COUNTERS, SLICE = 1 << 23, 1 << 14
TOP = U64(64 - 23)
#: Parts that rows of one class, or pairs of one document, are dealt into for a join, so that none of them fills one task.
SALTS = 64
#: Owners up to which a key's pairs are rows of a join; more of them meet in blocks of about so many, with sketches of so many words.
FEW, BLOCK, WORDS = 16, 128, 32
#: Documents of a crowded key's largest component that the others are compared with before the blocks.
LEADERS = 4
#: Of a document's crowded keys, how many travel with it into the blocks.
SMALLEST = 8
#: Keys that a bucket holds, about.
KEYS_EACH = 500_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each row, and for each row its first (one more than rows)."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends)
    keys, row, _ = grams(hashes, first, SHINGLE)
    size = np.diff(first)
    for n in range(1, SHINGLE):
        short = np.flatnonzero(size == n)
        if len(short):
            total = sum((hashes[first[short] + k] * GRAM_KEYS[k] for k in range(n)), np.full(len(short), n, np.uint64))
            keys, row = np.r_[keys, mix(total)], np.r_[row, short]
    order = np.argsort(keys)
    order = order[np.argsort(row[order].astype(np.uint16 if len(size) < 65536 else np.int64), kind="stable")]
    keys, row = keys[order], row[order]
    once = np.r_[True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])] if len(keys) else np.zeros(0, bool)
    keys, row = keys[once], row[once]
    return keys, np.searchsorted(row, np.arange(len(size) + 1))


def _sets_of(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    data, offsets = buffers(batch.column("text"))
    for i, j in slices(offsets):
        yield slice(i, j), *shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: set size, digest and sketch; and how many documents hold a shingle, by the top bits of its hash:
    a row for each slice of the counters.
    """
    counts, part = np.zeros(COUNTERS, np.int32), TaskContext.get().partitionId() // 256
    for batch in batches:
        for rows, keys, first in _sets_of(batch):
            np.add.at(counts, (keys >> TOP).astype(np.int64), 1)
            d1, d2 = _added(mix(keys + U64(1)), first), _added(mix(keys ^ U64(0x5851F42D4C957F2D)), first)
            sketch, start = sketches(keys, first)
            own = [pa.array(np.diff(first), pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.ListArray.from_arrays(start.astype(np.int32), sketch.view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows], *own, *(pa.nulls(len(first) - 1, x.type) for x in list(DESCRIBED_ARROW)[5:])], schema=DESCRIBED_ARROW)
    for k in range(COUNTERS // SLICE):
        own = counts[k * SLICE : (k + 1) * SLICE]
        if own.any():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, x.type) for x in list(DESCRIBED_ARROW)[:5]), pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([planes(own)], pa.binary())], schema=DESCRIBED_ARROW)
    give_back()


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros(SLICE, np.int64)
    for x in table["counts"]:
        total += unplanes(x.as_py())
    return pa.table({"slice": table["slice"][:1], "part": table["part"][:1], "counts": [planes(total)]})


def _octaves(table: pa.Table) -> pa.Table:
    total = unplanes(_summed(table)["counts"][0].as_py())
    return pa.table({"slice": table["slice"][:1], "octaves": [np.log2(total + 1).astype(np.int8).tobytes()], "total": [int(total.sum())]})


def rarity_classes(slices: DataFrame) -> np.ndarray:
    """For each top of a hash, how often shingles of that top occur, in octaves above the mean: 2^23 numbers, however large the
    corpus, counted over all texts. They order blocks and never drop any. 256 tasks are summed, then the sums.
    """
    summed = slices.select("slice", "part", "counts").groupBy("slice", "part").applyInArrow(_summed, COUNTED).groupBy("slice").applyInArrow(_octaves, "slice int, octaves binary, total long")
    octaves, every = np.zeros(COUNTERS, np.int8), 0
    for k, x, total in summed.collect():
        octaves[k * SLICE : (k + 1) * SLICE] = np.frombuffer(x, np.int8)
        every += total
    return np.maximum(0, octaves - int(np.log2(every / COUNTERS + 1))).astype(np.int8)


def most_apart(n: np.ndarray) -> np.ndarray:
    """The largest symmetric difference of a set of n with any set it can link to: (a+b)/7 at b = 4a/3."""
    return (n + 4 * n // 3) // 7


def block_keys(keys: np.ndarray, first: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the kept blocks and their rows. rarity: a class by the top bits of a hash, small for rare ones."""
    size = np.diff(first)
    rare = rarity[(keys >> TOP).astype(np.int64)]
    band = np.where(size > 0, np.log2(np.maximum(size, 1)).astype(np.int64), -1)
    out_keys, out_rows = [], []
    for above in (0, 1):
        for j in np.unique(band[band >= 0]):
            rows = np.flatnonzero((band == j) & (size * 4 >= 3 << (j + 1) if above else True))
            if not len(rows):
                continue
            of = int(j) + above
            n = size[rows]
            at = np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            own, row = keys[at], np.repeat(np.arange(len(rows)), n)
            if of >= 6:
                block = own >> U64(63 - of)
                new = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (row[1:] != row[:-1])])
                folded = mix(np.bitwise_xor.reduceat(own, new) ^ (block[new] << U64(8)))
                kind, row, most = np.minimum.reduceat(rare[at], new), row[new], most_apart(n) + 1
            else:
                folded, kind, most = own, rare[at], n // 4 + 1
            folded = mix(folded + np.array([of + 1], np.uint64) * U64(0x9E3779B97F4A7C15))
            order = np.lexsort((folded, kind, row))
            row = row[order]
            place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(rows)))[row]
            keep = place < most[row]
            out_keys.append(folded[order][keep])
            out_rows.append(rows[row[keep]])
    if not out_keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_keys), np.concatenate(out_rows)


def _widths(size: np.ndarray) -> np.ndarray:
    """The first word of each set's sketch (one more than sets)."""
    return np.r_[0, np.cumsum(np.where(size > 0, 1 << np.maximum(0, np.log2(np.maximum(size, 1)).astype(np.int64) - 4), 0))]


def sketches(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches, every shingle flips one bit, and each row's first word (one more than rows).

    A set in [2^j, 2^(j+1)) has 2^(j+2) bits, at least 64; halves XORed give the sketch of half the width.
    """
    start = _widths(np.diff(first))
    words, row = np.diff(start), rows_of(first)
    out = np.zeros(int(start[-1]), np.uint64)
    np.bitwise_xor.at(out, start[row] + ((keys >> U64(6)) & (words[row] - 1).astype(np.uint64)).astype(np.int64), U64(1) << (keys & U64(63)))
    return out, start


def _added(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1, np.uint64)
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        out[filled] = np.add.reduceat(values, first[filled])
    return out


def _name(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """A key as its bucket and low bits, as known on both sides of the shuffle."""
    return ((bucket_of(keys, n_buckets) << U64(48)) | (keys & LOW48)).view(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), PACKED_ARROW.types, strict=True)], schema=PACKED_ARROW)


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries in the order of keys and ids: the first of each key, and distinct pairs of its document and the key's others.

    Of keys of more than two entries here, which the second round sees again, a document is paired with the earliest first alone.
    """
    new = np.r_[True, keys[1:] != keys[:-1]]
    first = np.flatnonzero(new)
    group = (np.cumsum(new) - 1)[~new]
    a, b, two = ids[first][group], ids[~new], np.diff(np.r_[first, len(keys)])[group] == 2
    order = np.lexsort((a, two, b))
    a, b, two = a[order], b[order], two[order]
    new_b = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
    keep = np.where(two, np.r_[True, (a[1:] != a[:-1]) | new_b[1:] | ~two[:-1]], new_b) if len(b) else new_b
    order = np.lexsort((b[keep], a[keep]))
    return first, a[keep][order], b[keep][order]


def _in_order(keys: np.ndarray, ids: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Entries in the order of keys and ids, each once."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    once = np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])] if len(keys) else np.zeros(0, bool)
    return [keys[once], ids[once], *(x[order][once] for x in more)]


def _keyed(n_buckets: int, rarity, most: int = 500_000):
    def flush(parts: list[tuple], turn: int) -> Iterator[pa.RecordBatch]:
        keys, ids = _in_order(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        first, a, b = _stars(keys, ids)
        size = np.diff(np.r_[first, len(keys)])
        shared = np.repeat(size > 1, size)
        rows = [(PAIRS, turn % n_buckets, planes(np.diff(a, prepend=0)), planes(b), None), (REPEATED, turn % n_buckets, planes(_name(keys[shared], n_buckets)), planes(ids[shared]), None)] if len(a) else []
        keys, ids, more = keys[first], ids[first], size - 1
        bucket = bucket_of(keys, n_buckets)
        order = np.lexsort((ids, bucket))
        keys, ids, more, bucket = keys[order], ids[order], more[order], bucket[order]
        bounds = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            rows.append((KEYS, int(bucket[i]), planes(keys[i:j] & LOW48), planes(np.diff(ids[i:j], prepend=0)), planes(more[i:j])))
        for k in range(0, len(rows), 64):
            yield _batch(rows[k : k + 64])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, turn = [], 0, TaskContext.get().partitionId() * 31
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for part, keys, first in _sets_of(batch):
                keys, row = block_keys(keys, first, rarity.value)
                parts.append((keys, ids[part][row]))
                held += len(keys)
                if held >= most:
                    yield from flush(parts, turn)
                    parts, held, turn = [], 0, turn + 1
        if held:
            yield from flush(parts, turn)
        give_back()

    return run


def _met(table: pa.Table) -> pa.Table:
    """Of a bucket: pairs of a key's first document and its others, and the entries of keys of three owners or more; other rows are unpacked."""
    kind, bucket = table["kind"][0].as_py(), np.int64(table["bucket"][0].as_py())
    a, b, c = (table[x].to_pylist() for x in "abc")
    if kind == KEYS:
        keys, ids, more = (np.concatenate([f(x) for x in v]) for f, v in ((unplanes, a), (lambda x: np.cumsum(unplanes(x)), b), (unplanes, c)))
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        order = order[np.r_[False, same] | np.r_[same, False]]
        keys, ids, more = _in_order(keys[order], ids[order], more[order])
        first, x, y = _stars(keys, ids) if len(keys) else (np.zeros(0, np.int64),) * 3
        size = np.diff(np.r_[first, len(keys)])
        many = np.repeat(size + np.add.reduceat(more, first) > 2, size) if len(keys) else np.zeros(0, bool)
        columns = [np.r_[np.full(len(x), PAIRS), np.full(int(many.sum()), REPEATED)], np.r_[x, keys[many] | (bucket << np.int64(48))], np.r_[y, ids[many]]]
    else:
        x, y = [unplanes(v) for v in a], np.concatenate([unplanes(v) for v in b])
        columns = [np.full(len(y), kind), np.concatenate([np.cumsum(v) if kind == PAIRS else v for v in x]), y]
    out = pa.table([pa.array(v, f.type) for v, f in zip(columns, FOUND_ARROW, strict=True)], schema=FOUND_ARROW)
    give_back()
    return out


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, keys, first in _sets_of(batch):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], pa.ListArray.from_arrays(first.astype(np.int32), keys.view(np.int64))], names=["doc_id", "shingles"])
    give_back()


def _once(rows: DataFrame, repeated: DataFrame, row: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """row(rows), with one row for each id that the table `repeated` names; ids that aren't repeated need no shuffle for that."""
    if repeated.isEmpty():
        return row(rows)
    slots = slots_of(repeated, "doc_id")
    several = row(rows.filter(has_slot("doc_id", slots)))
    least = several.groupBy("doc_id").agg(F.min(F.struct(*[c for c in several.columns if c != "doc_id"])).alias("x")).select("doc_id", "x.*")
    return row(rows.filter(~has_slot("doc_id", slots))).unionByName(least)


def _near(pairs: DataFrame, members: DataFrame, docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Of pairs (a, b), a stored table: those whose sets are similar enough. The sketches' distance goes first, then the sets."""
    ids = lambda rows: slots_of(rows.select(F.explode(F.array("a", "b")).alias("doc_id")), "doc_id")
    paired = ids(pairs)
    members = members.filter(has_slot("doc_id", paired))
    side = lambda x: members.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    half = lambda x: f"zip_with(slice({x}, 1, size({x}) div 2), slice({x}, size({x}) div 2 + 1, size({x}) div 2), (x, y) -> x ^ y)"
    fold = lambda x, y: F.expr(f"if(size({x}) > size({y}), {half(x)}, {x})")
    apart = F.aggregate(F.zip_with(fold("sketch_a", "sketch_b"), fold("sketch_b", "sketch_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sized = dealt_join(pairs, side("a"), ["a"], "b").join(side("b"), "b").filter("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    close = stored(sized.filter(apart * 7 <= F.col("n_a") + F.col("n_b")).select("a", "b", "n_a", "n_b"), "close")
    paired.destroy()
    paired = ids(close)
    needed = docs.filter(has_slot("doc_id", paired))
    sets = stored(_once(needed, repeated, lambda rows: rows.mapInArrow(_set_rows, "doc_id long, shingles array<long>")), "sets")
    paired.destroy()
    joined = dealt_join(close, sets.withColumnsRenamed({"doc_id": "a", "shingles": "set_a"}), ["a"], "b").join(sets.withColumnsRenamed({"doc_id": "b", "shingles": "set_b"}), "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return joined.withColumn("both", both).filter("100 * both >= 75 * (n_a + n_b - both)").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _different(keys: DataFrame) -> DataFrame:
    """Of keys of three owners or more: one for each set of owners (told by their number and 128 bits), as the others make the same pairs."""
    owned = keys.groupBy("key").agg(F.count("*").alias("owners"), F.bit_xor(F.xxhash64("doc_id")).alias("h1"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("h2"))
    return owned.filter("owners > 2").groupBy("owners", "h1", "h2").agg(F.min("key").alias("key")).select("key", "owners")


def _open(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """Of keys (key, doc_id, owners): those whose owners are in several components, with each owner's root and the key's most frequent one."""
    placed = keys.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    mixed = placed.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("m", "root")).alias("x")).filter("roots > 1")
    return dealt_join(placed, mixed.select("key", F.col("x.root").alias("largest")), ["key"], "doc_id")


def _led(keys: DataFrame) -> DataFrame:
    """Pairs of the documents outside a key's largest component and some of that component, chosen by hashes of their ids.

    They join what is near to most of a large group before all that is left open is compared.
    """
    chosen = [F.min(F.struct(F.xxhash64("doc_id", F.lit(i)).alias("h"), "doc_id"))["doc_id"] for i in range(LEADERS)]
    leaders = keys.filter("root = largest").groupBy("key").agg(F.array(*chosen).alias("leaders"))
    pairs = dealt_join(keys.filter("root <> largest").select("key", "doc_id"), leaders, ["key"], "doc_id").select("doc_id", F.explode("leaders").alias("leader"))
    return pairs.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of blocks: the pairs of documents in different components whose sizes and sketches allow a link.

    A block without a partner (asking null) meets itself. Documents of the largest component ask nothing: the others find them.
    Of two that ask, the one of the smaller id does. A pair meets at every crowded key it shares, as documents of different
    components can't both be in a key's largest; where a smaller one is known to be shared, this key leaves the pair to it.
    """
    for batch in batches:
        for k in range(batch.num_rows):
            block, key = batch.column("block")[k].values, batch.column("key")[k].as_py()
            asking = batch.column("asking")[k]
            sides = [asking.values if asking.is_valid else block, block]
            (ids, n, root, out), (other_ids, other_n, other_root, other_out) = ([x.field(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n", "root", "out")] for x in sides)
            width = min(int(x.field("sketch").value_lengths().to_numpy(zero_copy_only=False).min()) for x in sides)
            own, other = (_folded(x.field("sketch"), width) for x in sides)
            earlier, other_earlier = (_earlier(x.field("smallest"), key) for x in sides)
            for i in np.flatnonzero(out):
                ok = np.flatnonzero((other_root != root[i]) & (~other_out | (ids[i] < other_ids)) & (4 * np.minimum(n[i], other_n) >= 3 * np.maximum(n[i], other_n)))
                ok = ok[np.bitwise_count(other[ok] ^ own[i]).sum(axis=1, dtype=np.int64) * 7 <= n[i] + other_n[ok]]
                before = earlier[i][earlier[i] < key]
                if len(ok) and len(before):
                    ok = ok[~np.isin(other_earlier[ok], before).any(axis=1)]
                if len(ok):
                    yield pa.RecordBatch.from_arrays([pa.array(f(ids[i], other_ids[ok]), pa.int64()) for f in (np.minimum, np.maximum)], names=["a", "b"])


def _earlier(smallest: pa.ListArray, key: int) -> np.ndarray:
    """Of each document the keys before this one that travel with it; the key itself, which none of them is, where there is none."""
    out = np.full((len(smallest), SMALLEST), key, np.int64)
    lengths, keys = smallest.value_lengths().to_numpy(zero_copy_only=False), smallest.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.minimum(keys, key)
    return out


def _folded(sketch: pa.ListArray, width: int) -> np.ndarray:
    """Sketches as rows of a matrix, wider ones XORed down to the width."""
    lengths, words = sketch.value_lengths().to_numpy(zero_copy_only=False), sketch.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    out, start = np.zeros((len(lengths), width), np.uint64), np.cumsum(lengths) - lengths
    for w in np.unique(lengths):
        at = np.flatnonzero(lengths == w)
        out[at] = np.bitwise_xor.reduce(words[start[at][:, None] + np.arange(w)].reshape(len(at), w // width, width), axis=1)
    return out


def _crowded(keys: DataFrame, reps: DataFrame) -> DataFrame:
    """Candidates (a, b) of keys with many owners, by blocks: only what passes the sketches becomes a row.

    A key of at most BLOCK owners is one block, which meets itself. The others' owners are dealt into blocks by size class, as
    sets of classes further apart than one can't link, and by a hash of their id, so that a block holds about BLOCK of them
    whatever the key's size; blocks meet pairwise. Sketches travel folded to WORDS words: that may pass a pair more, never one
    fewer. With each owner travel the SMALLEST of its crowded keys, so that a pair which meets at many keys seldom becomes more
    than one row.
    """
    smallest = keys.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set("key")), 1, SMALLEST).alias("smallest"))
    folded = F.expr(f"if(size(sketch) <= {WORDS}, sketch, transform(sequence(0, {WORDS - 1}), i -> aggregate(sequence(0, size(sketch) div {WORDS} - 1), 0L, (x, k) -> x ^ sketch[k * {WORDS} + i])))")
    own = F.struct("doc_id", "n", "root", (F.col("root") != F.col("largest")).alias("out"), "sketch", "smallest").alias("own")
    placed = keys.join(reps.select("doc_id", folded.alias("sketch")), "doc_id").join(smallest, "doc_id")
    alone = placed.filter(F.col("owners") <= BLOCK).select("key", own).groupBy("key").agg(F.collect_list("own").alias("block"))
    size_class = F.floor(F.ln("n") / F.lit(float(np.log(4 / 3)))).cast("int")
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("owners") / BLOCK)).cast("int")
    dealt = placed.filter(F.col("owners") > BLOCK).select("key", size_class.alias("class"), part.alias("part"), own)
    blocks = stored(dealt.groupBy("key", "class", "part").agg(F.collect_list("own").alias("block")), "blocks")
    asking = blocks.filter("exists(block, x -> x.out)").select("key", F.explode(F.array([F.col("class") + k for k in (-1, 0, 1)])).alias("class"), F.col("block").alias("asking"))
    met = asking.join(blocks.select("key", "class", "block"), ["key", "class"]).select("key", "asking", "block")
    return alone.unionByName(met, allowMissingColumns=True).mapInArrow(_meeting, "a long, b long")


def jaccard_components(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable by links of similarity 0.75 or more).

    Null and empty texts and texts without words have no shingles and are their own component. Rows without an id are
    returned with component_id null. Repeated rows of one id are one document; should their texts differ, the id counts with one
    of them, the same in each run. An empty table gives an empty result. Other columns are not read. Shingles are compared by
    64-bit hashes.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    described = stored(docs.mapInArrow(_described, DESCRIBED), "described")
    info = described.filter("slice is null").select("doc_id", "n", "k1", "k2", "sketch")
    rarity = spark.sparkContext.broadcast(rarity_classes(described.filter("slice is not null")))

    # classes of equal sets; a class, however large, is met in parts
    named = info.filter("doc_id is not null and n > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    part = named.groupBy("n", "k1", "k2", "salt").agg(F.min("doc_id").alias("least"), F.count("*").alias("m"))
    classes = part.groupBy("n", "k1", "k2").agg(F.min("least").alias("rep"), F.sum("m").alias("m")).filter("m > 1").drop("m")
    in_parts = part.select("n", "k1", "k2", "salt").join(classes, ["n", "k1", "k2"])
    tied = named.join(in_parts, ["n", "k1", "k2", "salt"]).filter("doc_id <> rep")
    later = stored(tied.groupBy("doc_id").agg(F.min("rep").alias("rep")), "later")
    slots = slots_of(later, "doc_id")
    by_chance = stored(info.filter("doc_id is not null").select("doc_id").filter(has_slot("doc_id", slots)).join(later, "doc_id", "left_anti").distinct(), "slots")
    firsts_too = slots_of(by_chance, "doc_id")
    firsts = docs.filter("doc_id is not null").filter(~has_slot("doc_id", slots) | has_slot("doc_id", firsts_too))

    n_keys = info.agg(F.coalesce(F.sum(F.col("n") / 3 + 1), F.lit(0))).first()[0]
    n_buckets = buckets_for(int(n_keys), KEYS_EACH)
    found = stored(firsts.mapInArrow(_keyed(n_buckets, rarity), PACKED).groupBy("kind", "bucket").applyInArrow(_met, FOUND), "found")
    for broadcast in (rarity, slots, firsts_too):
        broadcast.destroy()
    repeated = stored(named.groupBy("doc_id").agg(F.count("*").alias("m")).filter("m > 1").select("doc_id"), "repeated")
    reps = _once(named.select("doc_id", "n", "k1", "k2", "sketch"), repeated, lambda rows: rows).select("doc_id", "n", "sketch")
    star = stored(found.filter(f"kind = {PAIRS}").select(F.col("key").alias("a"), F.col("doc_id").alias("b")).distinct(), "star")
    links = stored(_near(star, reps, docs, repeated), "links")
    roots = components(links)

    keys = found.filter(f"kind = {REPEATED}").select("key", "doc_id").distinct()
    keys = stored(dealt_join(keys, _different(keys), ["key"], "doc_id"), "keys")
    led = _led(_open(keys.filter(F.col("owners") > FEW), roots))
    led = stored(led.join(star, ["a", "b"], "left_anti"), "led")
    links = stored(links.unionByName(_near(led, reps, docs, repeated)), "links")
    roots = components(links)

    open_keys = stored(_open(keys, roots).join(reps.select("doc_id", "n"), "doc_id"), "open")
    few = open_keys.filter(F.col("owners") <= FEW)
    outside = few.filter("root <> largest").select("key", F.col("doc_id").alias("other"), F.col("root").alias("other_root"), F.col("n").alias("other_n"))
    rest = outside.join(few, "key").filter("root <> other_root and 4 * least(n, other_n) >= 3 * greatest(n, other_n)").select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b"))
    rest = rest.unionByName(_crowded(open_keys.filter(F.col("owners") > FEW), reps)).distinct()
    rest = stored(rest.join(star, ["a", "b"], "left_anti"), "rest")
    more = stored(_near(rest, reps, docs, repeated), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    first = F.coalesce("rep", "doc_id")
    ruled = info.select("doc_id", "n").join(later, "doc_id", "left").select("doc_id", "n", first.alias("node"))
    return ruled.join(roots, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("component_id"))
