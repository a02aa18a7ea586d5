"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored
from .words import SEPARATORS, buffers, slices, word_bounds

WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of a source that one bin of keys holds, about.
BIN_ROWS = 4096
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        size, quality = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
        for i, j in slices(offsets):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            _, _, first = word_bounds(part, own)
            size[i:j] = np.diff(first)
            inside = np.r_[0, np.cumsum(~SEPARATORS[part])]
            letters = np.r_[0, np.cumsum(LETTER[part])]
            quality[i:j] = np.diff(letters[own]) / np.maximum(1, np.diff(inside[own]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(size), pa.array(0.05 + 0.95 * quality), batch.column("digest")], names=["doc_id", "source", "size", "quality", "digest"])


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text), quality (0.05 to 1, by the share of letters in its words), digest (of the text)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("digest"))
    return docs.mapInArrow(_measured, "doc_id long, source string, size long, quality double, digest long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Of (source, source_size): with target. A row for each source, so one task is enough.

    Sources by code point, null last, take the weights in turn. Targets share `share` of all sizes by weight; none exceeds
    `most` times its source's size, the excess goes to the others by weight. Sources of the smallest most * size / weight fill
    first, so one pass over them in that order finds the level of the rest.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("limit", F.col("source").asc_nulls_last())
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("limit", F.col("cap") / F.col("weight"))
    all_of = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(all_of) * F.lit(share))
    rows = rows.withColumn("used", F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1))).withColumn("open", F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("total") - F.coalesce("used", F.lit(0.0))) / F.col("open"))
    # the first source whose limit is above the level that is left for it and all after it stays open
    rows = rows.withColumn("level", F.min(F.when(F.col("level") <= F.col("limit"), F.struct("limit", "level"))).over(all_of)["level"])
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def sampling_key(weight: Column, *ids: Column, seed: int = 17) -> Column:
    """An exponential key -ln(u) / weight, u by hash of ids: the smallest keys are a weighted sample without replacement."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 53))) / weight


def mix_sources(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """Of (doc_id, source, size, quality, digest): doc_id, source, digest, size, source_size, target, taken (words the mix takes).

    Complete epochs of a source come first; the rest of its target goes to the documents with the smallest keys, whole ones,
    the last of them only if that brings the source nearer to its target. Null sizes count as 0 and are never taken; null
    or non-positive qualities count as 0.05; equal keys go by doc_id and digest; of rows equal in all it is fixed how many are taken, not which. No
    source meets in one task: keys fall into bins of about BIN_ROWS rows, sums of bins come first, and only the bin in which a
    budget ends is sorted.
    """
    rows = rows.withColumn("size", F.coalesce("size", F.lit(0)).cast("long")).withColumn("quality", F.when(F.col("quality") > 0, F.col("quality")).otherwise(F.lit(0.05)))
    keyed = stored(rows.select("doc_id", "source", "digest", "size", "quality", sampling_key(F.col("quality"), F.col("doc_id"), F.col("digest"), seed=seed).alias("key")), "keyed")
    sizes = stored(keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"), F.avg("quality").alias("usual")), "sizes")
    aims = targets(sizes.select("source", "source_size"), weights, share, most)
    aims = aims.join(sizes.select(F.col("source").alias("s"), "source_rows", "usual"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    aims = stored(aims.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "aims")  # a row for each source
    joined = keyed.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    n_bins = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / BIN_ROWS))
    binned = joined.withColumn("bin", F.floor(n_bins * (1 - F.exp(-F.col("key") * F.col("usual")))).cast("long"))
    sums = binned.groupBy(F.col("source").alias("s"), F.col("bin").alias("b")).agg(F.sum("size").alias("bin_size"))
    by_bin = Window.partitionBy("s").orderBy("b")
    sums = stored(sums.withColumn("before", F.sum("bin_size").over(by_bin) - F.col("bin_size")), "sums")
    placed = binned.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).drop("s", "b")
    out = ["doc_id", "source", "digest", "size", "source_size", "target"]
    ends_here = (F.col("before") < F.col("budget")) & (F.col("before") + F.col("bin_size") > F.col("budget"))
    whole = placed.filter(~ends_here).select(*out, (F.col("size") * (F.col("epochs") + F.when(F.col("before") + F.col("bin_size") <= F.col("budget"), 1).otherwise(0))).alias("taken"))
    in_order = Window.partitionBy("source", "bin").orderBy("key", F.col("doc_id").asc_nulls_last(), "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = placed.filter(ends_here).withColumn("upto", F.col("before") + F.sum("size").over(in_order))
    split = split.select(*out, (F.col("size") * (F.col("epochs") + F.when(F.col("upto") - F.col("size") / 2 <= F.col("budget"), 1).otherwise(0))).alias("taken"))
    return whole.unionByName(split).withColumn("taken", F.col("taken").cast("long"))
