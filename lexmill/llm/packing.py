"""Best-fit packing: token pieces into as few sequences as they need.

Each task packs its pieces best-fit, longest first; nearly full sequences are done, the rest become items of the next round,
where fewer tasks pack them again, until one task has held all that is left or a round no longer helps.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored
from .tokens import encoder, forget, gathered

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BINS = "fill long, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"
MEMBER = pa.struct([PIECES_ARROW.field(i) for i in range(5)])
BINS_ARROW = pa.schema([("fill", pa.int64()), ("members", pa.list_(MEMBER))])
#: Items that one task packs at a time.
AT_ONCE = 200_000


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: longest items first, each into the bin that it leaves fullest."""
    bin_of, by_room, rooms, n = np.zeros(len(lengths), np.int64), {}, 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            bins = by_room[room]
            own = bins.pop()
            if not bins:
                rooms ^= 1 << room
        else:
            own, room, n = n, capacity, n + 1
        room -= length
        if room:
            by_room.setdefault(room, []).append(own)
            rooms |= 1 << room
        bin_of[i] = own
    return bin_of


def _pieces(vocabulary: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            tokens, first = encoder(vocabulary).encode(table["text"])
            size = np.diff(first) + 1
            ends = np.cumsum(size)
            ids = np.full(int(ends[-1]) if len(ends) else 0, end_id, "<u4")
            ids[np.arange(len(tokens)) + np.repeat(np.arange(len(size)), size - 1)] = tokens
            n = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            head = size - (n - 1) * capacity
            length = np.where(piece == 0, head[row], capacity)
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            raw, at = memoryview(ids).cast("B"), (ends - size)[row] + start
            sums = [crc32(raw[4 * i : 4 * j]) for i, j in zip(at.tolist(), (at + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks().take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], schema=PIECES_ARROW)
        forget(vocabulary)

    return run


def document_pieces(documents: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per piece of a document's ids (its text's and the end id): doc_id, piece, start, length, ids_crc32.

    Only documents of more than `capacity` ids are cut; their first piece holds what whole pieces leave over.
    """
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return docs.mapInArrow(_pieces(vocabulary, end_id, capacity), PIECES)


def _grouped(fill: np.ndarray, members: pa.ListArray, capacity: int) -> pa.RecordBatch:
    """Bins packed into bins."""
    bin_of = best_fit(fill, capacity)
    order = np.argsort(bin_of, kind="stable")
    count = pc.list_value_length(members).to_numpy(zero_copy_only=False)
    total = np.bincount(bin_of, fill).astype(np.int64)
    ends = np.cumsum(np.bincount(bin_of, count).astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(total), pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), members.take(pa.array(order)).flatten()).cast(BINS_ARROW.field(1).type)], schema=BINS_ARROW)


def _pack(capacity: int):
    """Packs rows of BINS, or of PIECES, as they come, AT_ONCE at a time; batches of a bounded number of bins go out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            if "members" in table.column_names:
                fill, members = table["fill"].to_numpy(), table["members"].combine_chunks()
            else:
                fill = table["length"].to_numpy()
                own = pa.StructArray.from_arrays([table[c].combine_chunks() for c in PIECES_ARROW.names], fields=list(MEMBER))
                members = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1), pa.int32()), own)
            out = _grouped(fill, members, capacity)
            for k in range(0, out.num_rows, 20_000):
                yield out.slice(k, 20_000)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= AT_ONCE:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece, with its sequence and its place there."""
    base, seen = TaskContext.get().partitionId() << 40, 0
    for batch in batches:
        members = batch.column("members")
        count = pc.list_value_length(members).to_numpy(zero_copy_only=False)
        flat = members.flatten()
        length = flat.field("length").to_numpy()
        ends = np.cumsum(length)
        first = np.cumsum(count) - count
        before = (ends - length)[first] if len(ends) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(count)), count)
        yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in PIECES_ARROW.names), pa.array(base + seen + row), pa.array(ends - length - before[row])], names=[*PIECES_ARROW.names, "sequence_id", "offset"])
        seen += batch.num_rows


def best_fit_packing(pieces: DataFrame, capacity: int = 1024, near: int = 4) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset (gapless from 0 in each sequence).

    No sequence exceeds `capacity` (pieces longer than that, or shorter than one, are an error); sequences with at most `near`
    free places leave the rounds. Every piece is placed, repeated ones too; nulls in other columns than length stay as they
    are; an empty table gives an empty one.
    """
    checked = pieces.select("doc_id", "piece", "start", F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(F.raise_error(F.lit("a piece's length is outside 1 to the capacity"))).cast("long").alias("length"), "ids_crc32")
    bins = stored(checked.mapInArrow(_pack(capacity), BINS), "bins")
    done = bins.filter(F.col("fill") >= capacity - near)
    left = bins.filter(F.col("fill") < capacity - near)
    n, last = left.count(), False
    while n > 1 and not last:
        tasks = max(1, -(-n // AT_ONCE))
        bins = stored(left.repartition(tasks, F.xxhash64("fill", F.col("members")[0])).mapInArrow(_pack(capacity), BINS), "bins")
        done = done.unionByName(bins.filter(F.col("fill") >= capacity - near))
        left = bins.filter(F.col("fill") < capacity - near)
        before, n = n, left.count()
        last = tasks == 1 or n > 0.98 * before
    return done.unionByName(left).mapInArrow(_placed, f"{PIECES}, sequence_id long, offset long")
