"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file (one folder of Parquet per shard) holds blocks of whole documents in ascending doc_id order: doc ids, token counts, the
control bytes (two bits a token: its length in bytes, less one) and the data bytes. `ranks` maps ranks to ids. Shards follow the
order of doc_id, so a document's place is the sum of the shards, blocks and documents before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import shared_folder, stored, temporary, text_bytes
from .tokens import encoder, forget, gathered

ROUGH = "part int, ids binary, sizes binary, tokens binary, counts array<long>"
ROUGH_ARROW = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary()), ("counts", pa.list_(pa.int64()))])
BLOCKS = "shard int, block int, n_docs long, n_tokens long, ids binary, sizes binary, control binary, data binary"
BLOCK_TOKENS = 1 << 20
#: Bytes of each of the four tokens of a control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned integers below 2^32."""
    values = values.astype("<u4")
    more = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = more
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    kept = np.arange(4, dtype=np.uint8) <= more[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n integers of pack(), by a table of lengths."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.r_[np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]
    at = np.cumsum(sizes) - sizes
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(sizes > k)
        if len(longer):
            out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenized(vocabulary: str, bounds: np.ndarray, vocabulary_size: int):
    """Rough blocks: the documents of a batch by shard, in order of doc_id, compressed; and how often the task saw each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, coder = np.zeros(vocabulary_size, np.int64), zstandard.ZstdCompressor(level=1)
        for table in gathered(batches):
            table = table.sort_by([("doc_id", "ascending")])
            tokens, first = encoder(vocabulary).encode(table["text"])
            counts += np.bincount(tokens, minlength=vocabulary_size)
            ids, sizes = table["doc_id"].to_numpy(), np.diff(first)
            cuts = np.r_[0, np.searchsorted(ids, bounds, "right"), len(ids)]
            for part, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if i < j:
                    own = tokens[first[i] : first[j]].view(np.uint8).reshape(-1, 2).T.tobytes()
                    yield pa.RecordBatch.from_pylist([{"part": part, "ids": ids[i:j].tobytes(), "sizes": sizes[i:j].tobytes(), "tokens": coder.compress(own)}], ROUGH_ARROW)
        forget(vocabulary)
        if counts.any():
            yield pa.RecordBatch.from_pylist([{"part": -1, "counts": counts.tolist()}], ROUGH_ARROW)

    return run


def _block(shard: int, k: int, ids: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> dict:
    control, data = pack(ranks)
    return {"shard": shard, "block": k, "n_docs": len(ids), "n_tokens": len(ranks), "ids": ids.tobytes(), "sizes": sizes.tobytes(), "control": control, "data": data}


def _coded(rank_of, end_id: int):
    """A shard's blocks, documents in ascending order; the end id closes each document."""

    def run(table: pa.Table) -> pa.Table:
        coder, parts = zstandard.ZstdDecompressor(), []
        for ids, sizes, tokens in zip(*(table[c].to_pylist() for c in ("ids", "sizes", "tokens")), strict=True):
            raw = np.frombuffer(coder.decompress(tokens), np.uint8)
            parts.append((np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), np.ascontiguousarray(raw.reshape(2, -1).T).view("<u2").ravel()))
        ids, sizes, tokens = (np.concatenate(x) for x in zip(*parts, strict=True))
        first = np.cumsum(sizes) - sizes
        head = tokens[np.minimum(first, max(len(tokens) - 1, 0))].astype(np.int64) if len(tokens) else sizes
        _, same, rows = np.unique(ids, return_inverse=True, return_counts=True)
        tie = np.zeros(len(ids), np.uint64)
        for k in np.flatnonzero(rows[same] > 1):
            tie[k] = xxhash.xxh3_64_intdigest(tokens[first[k] : first[k] + sizes[k]].tobytes())
        order = np.lexsort((tie, head, sizes, ids))  # rows that share an id: the shorter text first, then by their tokens
        shard, out, i = table["part"][0].as_py(), [], 0
        ends = np.cumsum(sizes[order] + 1)
        while i < len(order):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_TOKENS, "right")))
            own = order[i:j]
            n = sizes[own] + 1
            last = np.cumsum(n)
            at = np.repeat(first[own] - (last - n), n) + np.arange(int(last[-1]))
            block = tokens[np.minimum(at, max(len(tokens) - 1, 0))] if len(tokens) else np.zeros(len(at), np.uint16)
            block[last - 1] = end_id
            out.append(_block(shard, len(out), ids[own], n, rank_of.value[block]))
            i = j
        return pa.Table.from_pylist(out, pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), *[(c, pa.binary()) for c in ("ids", "sizes", "control", "data")]]))

    return run


def write_token_files(documents: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", shard_bytes: int = 12 << 20) -> None:
    """Writes the ids of all texts under `path`. Null texts count as empty, an empty text has the end id alone; rows without an
    id are left out (they have no place in the order); rows that share an id all stay. An empty table gives files without
    blocks. Other columns are not read. A shard holds about shard_bytes of text.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).filter("doc_id is not null")
    shards = max(1, -(-text_bytes(docs) // shard_bytes))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)] or [0.5], 20 * shards)).first()[0] if shards > 1 else []
    bounds = np.array(sorted(set(cuts or [])), np.int64)
    size = len(encoder(vocabulary).starts_piece)
    rough = stored(docs.mapInArrow(_tokenized(vocabulary, bounds, size), ROUGH), "rough")
    counts = np.zeros(size, np.int64)
    for i, n in rough.filter("part = -1").select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col")).collect():  # a row for each id of the vocabulary
        counts[i] = n
    counts[end_id] += rough.filter("part >= 0").agg(F.coalesce(F.sum(F.octet_length("sizes")), F.lit(0)) / 8).first()[0]
    by_rank = np.lexsort((np.arange(size), -counts)).astype(np.uint32)
    rank_of = np.zeros(size, np.uint32)
    rank_of[by_rank] = np.arange(size, dtype=np.uint32)
    spark.createDataFrame(pa.table({"rank": np.arange(size), "id": by_rank.astype(np.int64)})).coalesce(1).write.parquet(f"{path}/ranks")
    blocks = rough.filter("part >= 0").select("part", "ids", "sizes", "tokens").groupBy("part").applyInArrow(_coded(spark.sparkContext.broadcast(rank_of), end_id), BLOCKS)
    blocks.write.option("compression", "zstd").parquet(f"{path}/shards")


def _decoded(id_of):
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
                tokens = memoryview(id_of.value[unpack(row["control"], row["data"], row["n_tokens"])].astype("<u4")).cast("B")
                ends = np.cumsum(sizes)
                sums = [crc32(tokens[4 * i : 4 * j]) for i, j in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["shard"]), pa.int32()), pa.array(np.full(len(ids), row["block"]), pa.int32()), pa.array(ids), pa.array(ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())], schema=schema)

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()  # a row for each id of the vocabulary
    id_of = np.zeros(len(ranks), np.uint32)
    for r in ranks:
        id_of[r["rank"]] = r["id"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/shards")
    index = blocks.select("shard", "block", "n_tokens")
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))  # a row for each shard
    starts = index.withColumn("within", F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")).join(shards, "shard").select("shard", "block", (F.col("before") + F.col("within")).alias("before"))
    docs = blocks.select("shard", "block", "n_tokens", "ids", "sizes", "control", "data").mapInArrow(_decoded(spark.sparkContext.broadcast(id_of)), "shard int, block int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_file_digests(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    spark = documents.sparkSession
    path = temporary(spark, shared_folder(spark).rstrip("/"), "tokens")
    write_token_files(documents, path, vocabulary)
    return read_token_files(spark, path)
