"""Batches of queries against a corpus, by shared terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.words import tokens
from lexmill.sources.shared import stored

from .ordering import first_per_key

#: Bytes of text, about, whose documents are scored in one task, and pairs of a query and a document, if all share terms.
TASK_BYTES = 6 << 20
TASK_PAIRS = 1 << 20
#: Rows (query, term), about 50 bytes each, that are sent to every executor whatever Spark takes for their size.
SENT_TERMS = 200_000


def lexical_scores(queries: DataFrame, docs: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per query and document that share a term: the sum over query tokens, repeated ones again, of 1 + ln(1 + tf), by the root
    of the document's different terms. Rows should not repeat a document's id.

    Documents are dealt by id into parts of about TASK_BYTES of text, or of fewer if their texts are short, so that a part makes
    about TASK_PAIRS pairs at most: what a task counts and sums does not grow with the corpus or the queries, and no pair of query
    and document is shuffled. Terms meet by equality, where the texts lie; only if queries have more than SENT_TERMS terms, Spark
    may shuffle the texts' terms and the pairs, and its tasks grow with the corpus.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    sent = F.broadcast if asked.limit(SENT_TERMS + 1).count() <= SENT_TERMS else lambda df: df
    n_bytes, n_docs = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count("*")).first()
    n_pairs = n_docs * queries.select(query_id).distinct().count()
    dealt = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartition(max(8, -(-n_bytes // TASK_BYTES), -(-n_pairs // TASK_PAIRS)), "doc_id")
    words = dealt.select("doc_id", tokens(F.col("text")).alias("words")).withColumn("terms", F.size(F.array_distinct("words")))
    each = F.explode_outer("words").alias("term")  # explode would make Spark test their number before the texts are dealt, by making them twice
    held = words.select("doc_id", "terms", each).join(sent(asked.select("term").distinct()), "term", "left_semi")
    counts = held.groupBy("doc_id", "terms", "term").agg(F.count("*").alias("tf"))
    sums = counts.join(sent(asked), "term").groupBy("query_id", "doc_id", "terms").agg(F.sum(F.col("times") * (1 + F.log1p(F.col("tf").cast("double")))).alias("total"))
    return sums.select("query_id", "doc_id", (F.col("total") / F.sqrt(F.col("terms").cast("double"))).alias("score"))


def ranked(scores: DataFrame, score: str, tie: str, name: str) -> DataFrame:
    """Positive scores, ranked within each query from 1."""
    return scores.filter(F.col(score) > 0).withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), tie)))


def min_max(scores: DataFrame, score: str, name: str) -> DataFrame:
    """Scaled to 0..1 within each query; 1 where all are equal. Scores are read twice, and no query's rows meet in one task."""
    ends = stored(scores.groupBy(F.col("query_id").alias("_query")).agg(F.min(score).alias("_low"), F.max(score).alias("_high")), "ends")
    low, high = F.col("_low"), F.col("_high")
    scaled = scores.join(ends, F.col("query_id").eqNullSafe(F.col("_query"))).withColumn(name, F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(1.0)))
    return scaled.drop("_query", "_low", "_high")


def top_k(scores: DataFrame, score: Column, tie: str, k: int) -> DataFrame:
    return first_per_key(scores, ["query_id"], [score.desc(), F.col(tie)], k, rank="rank")


def marked(scores: DataFrame, relevant: DataFrame, name: str = "relevant") -> DataFrame:
    """Scores (query_id, doc_id, ...) and whether relevant (query_id, doc_id) has the pair. They meet by document, as scores are
    dealt: if relevant is no broadcast, it goes to their parts, and no pair is shuffled."""
    asking = relevant.groupBy("doc_id").agg(F.collect_set("query_id").alias("_asking"))
    return scores.join(asking, "doc_id", "left").withColumn(name, F.coalesce(F.array_contains("_asking", F.col("query_id")), F.lit(False))).drop("_asking")


def relevant_ranks(scores: DataFrame, relevant: DataFrame | Column, k: int) -> DataFrame:
    """What ranking_metrics needs of all ranks by score and doc_id: (query_id, doc_id, rank) of each query's first k documents, and
    of its best relevant one, whose rank is the number of those that are not behind it. Neither sorts a query's documents. Scores
    (query_id, doc_id, score), one for each pair and positive, and relevant (query_id, doc_id) are read more than once. Where scores
    say it themselves, relevant is the condition.
    """
    first = top_k(scores, F.col("score"), "doc_id", k).select("query_id", "doc_id", "rank")
    own = scores.filter(relevant) if isinstance(relevant, Column) else scores.join(relevant.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"])
    best = own.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "doc_id")).alias("x"))
    best = stored(best.select("query_id", (-F.col("x.minus")).alias("_score"), F.col("x.doc_id").alias("_doc")), "best")
    ahead = (F.col("score") > F.col("_score")) | ((F.col("score") == F.col("_score")) & (F.col("doc_id") <= F.col("_doc")))
    places = scores.join(best, "query_id").filter(ahead).groupBy("query_id", F.col("_doc").alias("doc_id")).agg(F.count("*").cast("int").alias("rank"))
    return first.unionByName(places)


def ranking_metrics(ranked_rows: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Of (query_id, doc_id, rank) and (query_id, doc_id): recall, precision, hit, reciprocal rank and nDCG at k for each query
    that has relevant documents; queries without results score 0. Repeated documents count at their first rank.
    """
    found = ranked_rows.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    truth = relevant.select("query_id", "doc_id").distinct()
    hits = found.join(truth, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0))).alias("gain"))
    wanted = truth.groupBy("query_id").agg(F.count("*").alias("wanted"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    rows = wanted.join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return rows.select("query_id", F.round(F.col("hits") / F.col("wanted"), 6).alias("recall"), F.round(F.col("hits") / k, 6).alias("precision"), (F.col("hits") > 0).cast("int").alias("hit"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.coalesce(F.col("gain"), F.lit(0.0)) / ideal, 6).alias("ndcg"))


def first_ranked(scores: DataFrame, depth: int, doc_id: str = "doc_id") -> DataFrame:
    """Each query's first `depth` documents of positive score, with their rank; scores equal to 9 places tie, ties go to the smaller id."""
    positive = scores.filter(F.col("score") > 0)
    return first_per_key(positive, ["query_id"], [F.round("score", 9).desc(), F.col(doc_id)], depth, rank="rank")


def fused_scores(rankings: dict[str, DataFrame], doc_id: str = "doc_id", k: int = 60) -> DataFrame:
    """Of named rankings (query_id, doc_id, score, rank): their fusion, and each one's score, 0 where it lacks the document."""
    rows = None
    for name, r in rankings.items():
        r = r.select("query_id", doc_id, "rank", "score", F.lit(name).alias("side"))
        rows = r if rows is None else rows.unionByName(r)
    own = [F.coalesce(F.max(F.when(F.col("side") == name, F.col("score"))), F.lit(0.0)).alias(name) for name in rankings]
    return rows.groupBy("query_id", doc_id).agg(F.sum(1 / (k + F.col("rank"))).alias("fusion"), *own)


def _runs(n: int, slice_bytes: int = 2 << 20):
    """Batches of (id, lower-case text) to a row (id, h, k) for each n words in a row, hashed to 128 bits; about `slice_bytes` of
    text are held as words at a time. A text's words are never in a run with another's."""
    factors = np.array([[pow(m, j, 1 << 64) for j in range(n)] for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)], np.uint64)

    def cut(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        spaced = pc.utf8_trim(pc.replace_substring_regex(texts, "[^a-z0-9]+", " "), " ")
        some = pc.not_equal(spaced, "")
        ids, words = ids.filter(some), pc.split_pattern(spaced.filter(some), " ")
        coded = words.flatten().dictionary_encode()
        known, code = coded.dictionary.to_numpy(zero_copy_only=False).astype(object), coded.indices.to_numpy()
        ends = np.cumsum(pc.list_value_length(words).to_numpy())
        runs = max(0, len(code) - n + 1)
        row = np.searchsorted(ends, np.arange(runs), side="right")
        whole = np.flatnonzero(np.arange(n, runs + n) <= ends[row])
        out = [ids.take(pa.array(row[whole]))]
        for key, factor in zip("hk", factors, strict=True):
            own = hash_array(known, hash_key=key * 16, categorize=False)[code]  # a word's hash, the same in every task
            total = np.zeros(runs, np.uint64)
            for j in range(n):
                total += own[j : j + runs] * factor[j]
            out.append(pa.array(total[whole].view(np.int64)))
        return pa.RecordBatch.from_arrays(out, names=["id", "h", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)) // slice_bytes
            starts = np.r_[0, np.flatnonzero(np.diff(part)) + 1]
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                yield cut(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))

    return run


def shared_grams(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, n: int, text: str = "text") -> DataFrame:
    """Pairs (query_id, doc_id) that share n words (runs of letters and digits) in a row. Runs are hashed where their text lies, and
    those that no query has end at the join.
    """

    def grams(df: DataFrame, i: str) -> DataFrame:
        kind = df.schema[i].dataType
        rows = df.select(i, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
        return rows.mapInArrow(_runs(n), f"id {kind.simpleString()}, h long, k long").withColumnRenamed("id", i)

    return grams(docs, doc_id).join(grams(queries, query_id).distinct(), ["h", "k"]).select(query_id, doc_id).distinct()
