"""Segments of documents into chunks within a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.sentences import estimated_tokens, paragraphs, sentences, visible
from lexmill.functions.words import word_list


def _runs(target: int, merge_below: int | None, overlap: int = 0):
    """Greedy runs over arrays of sizes, as slices (at, n, size, again): a run ends where the next would pass the target. With merge_below
    an item joins a run only under the same name and while the run is smaller than that. Each run but the first also takes the
    last `overlap` items of the one before, `again` of them; `size` is without them.
    """

    def of(sizes: pa.ListArray, names: pa.ListArray | None) -> pa.ListArray:
        size, name = sizes.flatten().to_pylist(), names.flatten().to_pylist() if names is not None else None
        ends = np.cumsum(pc.fill_null(pc.list_value_length(sizes), 0).to_numpy()).tolist()
        starts, firsts, lasts, held, agains, n_runs, at = [], [], [], [], [], [], 0
        for end in ends:
            before = len(starts)
            for i in range(at, end):
                if len(starts) > before and held[-1] + size[i] <= target and (merge_below is None or (name[i] is not None and name[i] == name[i - 1] and held[-1] < merge_below)):
                    held[-1] += size[i]
                    lasts[-1] = i + 1
                else:
                    from_ = max(starts[-1], i - overlap) if len(starts) > before else i
                    firsts.append(from_ - at + 1)
                    agains.append(i - from_)
                    starts.append(i)
                    held.append(size[i])
                    lasts.append(i + 1)
            n_runs.append(len(starts) - before)
            lasts[before:] = [x - at for x in lasts[before:]]
            at = end
        first = np.array(firsts, np.int32)
        run = pa.StructArray.from_arrays([pa.array(first), pa.array(np.array(lasts, np.int32) - first + 1), pa.array(held, pa.int32()), pa.array(agains, pa.int32())], ["at", "n", "size", "again"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_runs)].astype(np.int32)), run)

    @F.arrow_udf("array<struct<at:int,n:int,size:int,again:int>>")
    def runs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sizes, names in batches:
            yield of(sizes, names if merge_below is not None else None)

    return runs


def _list(x: Column) -> Column:
    return F.sort_array(F.collect_list(x))


def chunked(segments: DataFrame, title: Column, version: Column, target: int = 350, most: int = 550, overlap: int = 2, merge_below: int = 180, parent_words: int = 1200) -> DataFrame:
    """Of segments (document_id, place, article, paragraph, text): chunks of at most `most` estimated tokens where sentences allow.

    Short neighbours of one article merge while they stay under merge_below and within the target. What is larger than `most` is
    split between sentences into parts of about the target; each but the first starts with the last `overlap` sentences of the
    one before (`repeated` characters). A sentence is never torn. Blank and null texts go; a null article merges with nothing. One document's segments
    meet in one group, the only shuffle; units and parts are slices of it. place should tell a document's segments apart; title and version are the same for all
    rows of a document.
    """
    kept = segments.filter(visible(F.col("text"))).withColumn("tokens", estimated_tokens(F.col("text")))
    rows = kept.groupBy("document_id").agg(F.min(title).alias("title"), F.min(version).alias("version"), _list(F.struct("place", "article", "paragraph", "text", "tokens")).alias("s"))
    unit = _runs(target, merge_below)(F.col("s.tokens"), F.col("s.article"))
    one = rows.withColumn("runs", unit).select("document_id", "title", "version", "s", F.posexplode("runs").alias("unit", "r"))
    one = one.select("document_id", "unit", "title", "version", F.slice("s", F.col("r.at"), F.col("r.n")).alias("s"), F.col("r.size").alias("size"))
    units = one.select("document_id", "unit", "title", "version", F.col("s")[0]["article"].alias("article"), F.col("s")[0]["paragraph"].alias("first"), F.element_at("s", -1)["paragraph"].alias("last"), F.array_join("s.text", "\n\n").alias("body"), "size", (F.col("size") <= most).alias("whole"), F.col("s.text").alias("texts"))
    split = F.flatten(F.transform("texts", lambda x: F.flatten(F.transform(paragraphs(x), lambda p: sentences(p)))))
    pieces = units.withColumn("sentences", F.when(~F.col("whole"), split)).drop("texts")
    part = _runs(target, None, overlap)(F.coalesce(F.transform("sentences", estimated_tokens), F.array().cast("array<int>")), F.lit(None).cast("array<string>"))
    told = pieces.withColumn("runs", part)
    alone = F.array(F.struct(F.lit(1).alias("at"), F.lit(1).alias("n"), F.col("size").alias("size"), F.lit(0).alias("again")))
    out = told.withColumn("runs", F.when(F.col("whole"), alone).otherwise(F.col("runs"))).select("*", F.size("runs").alias("parts"), F.posexplode("runs").alias("k", "r"))
    text = F.when(F.col("whole"), F.col("body")).otherwise(F.array_join(F.slice("sentences", F.col("r.at"), F.col("r.n")), " "))
    repeated = F.when(F.col("r.again") > 0, F.length(F.array_join(F.slice("sentences", F.col("r.at"), F.col("r.again")), " "))).otherwise(0)
    out = out.select("document_id", "unit", "title", "version", "article", "first", "last", "body", "size", "whole", "parts", (F.col("k") + 1).alias("part"), text.alias("text"), repeated.alias("repeated"))
    paragraph = F.when(F.col("first").eqNullSafe(F.col("last")), F.col("first"))
    note = F.when(F.col("parts") > 1, F.concat(F.lit("(bagian "), "part", F.lit(" dari "), "parts", F.lit(")")))
    named = F.concat_ws(" | ", *[F.when(x != "", x) for x in (F.col("title"), F.col("article"), paragraph)])
    header = F.concat_ws(" ", F.when(named != "", named), note)
    digest = F.substring(F.sha2(F.concat_ws("\n", F.col("document_id").cast("string"), F.concat(F.lit("v"), "version"), F.coalesce("article", F.lit("None")), F.coalesce("first", F.lit("None")), "text"), 256), 1, 16)
    words = word_list(F.col("body"))
    return out.select(
        "document_id", "unit", "part", "parts", "article", paragraph.alias("paragraph"), "text",
        F.concat(F.col("document_id").cast("string"), F.lit("-v"), "version", F.lit("-"), digest).alias("chunk_id"),
        F.when(header != "", F.concat(header, F.lit("\n"), "text")).otherwise(F.col("text")).alias("retrieval_text"),
        F.when((F.col("size") <= parent_words) | (F.size(words) <= parent_words), F.col("body")).otherwise(F.array_join(F.slice(words, 1, parent_words), " ")).alias("parent_text"),
        F.when(F.col("whole"), F.col("size")).otherwise(estimated_tokens(F.col("text"))).alias("token_estimate"), (F.col("parts") > 1).alias("continued"), "repeated",
    )
