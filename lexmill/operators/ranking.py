"""What follows a fused ranking: scores, adjustments, choice, citations. Rows are (query_id, doc_id, ...), one for each candidate."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.headings import asks_meaning, general_part, heading_only
from lexmill.functions.words import collapsed, tokens

#: Weights of the parts of a score.
WEIGHTS = {"fusion": 0.45, "lexical": 0.2, "semantic": 0.2, "overlap": 0.15, "topic": 0.2, "article": 0.25, "outdated": 0.2, "unverified": 0.05}


def overlap(query: Column, text: Column) -> Column:
    """Share of a query's different tokens that the text has."""
    asked = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(asked, tokens(text))) / F.greatest(F.lit(1), F.size(asked))


def rerank_score(weights: Mapping[str, float] = WEIGHTS) -> Column:
    """From fusion, lexical, semantic, overlap (numbers), topic_match, article_match (booleans) and status: the combined score."""
    w = {**WEIGHTS, **weights}
    part = lambda name: F.col(name) * w[name]
    boost = lambda name: F.when(F.col(f"{name}_match"), w[name]).otherwise(0.0)
    penalty = F.when(F.col("status").isin("revoked", "historical"), w["outdated"]).when(F.col("status") == "needs_verification", w["unverified"]).otherwise(0.0)
    return part("fusion") + part("lexical") + F.greatest("semantic", F.lit(0.0)) * w["semantic"] + part("overlap") + boost("topic") + boost("article") - penalty


def match_reasons() -> Column:
    """Names of the boosts and penalties that rerank_score has applied."""
    outdated, unverified = F.col("status").isin("revoked", "historical"), F.col("status") == "needs_verification"
    named = {"topic_match": F.col("topic_match"), "article_match": F.col("article_match"), "historical_or_revoked_penalty": outdated, "needs_verification_warning": unverified}
    return F.array_compact(F.array(*(F.when(c, name) for name, c in named.items())))


def focus_boost(ranked: DataFrame, query: str, text: str, score: str, least_letters: int = 5, stop: tuple[str, ...] = (), each: float = 0.09, most: float = 0.18) -> DataFrame:
    """Adds to `score` for each query term that some, but at most 70 %, of the query's candidates hold; single candidates stay."""
    w = Window.partitionBy("query_id")
    size = ranked.withColumn("_n", F.count("*").over(w)).withColumn("_terms", F.array_distinct(tokens(F.col(text))))
    wanted = F.filter(F.array_distinct(tokens(F.col(query))), lambda t: (F.length(t) >= least_letters) & ~t.isin(*stop) if stop else F.length(t) >= least_letters)
    held = size.select("query_id", "doc_id", "_n", F.explode(F.array_intersect(wanted, "_terms")).alias("_t"))
    telling = held.withColumn("_df", F.count("*").over(Window.partitionBy("query_id", "_t"))).filter((F.col("_n") > 1) & (F.col("_df") <= F.greatest(F.lit(1), F.floor(F.col("_n") * 0.7))))
    matches = telling.groupBy("query_id", "doc_id").agg(F.count("*").alias("matches"))
    out = ranked.join(matches, ["query_id", "doc_id"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.withColumn(score, F.round(F.col(score) + F.least(F.lit(most), each * F.col("matches")), 6))


def superseded(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """Of ranked rows and edges (older, newer): n_newer, whether a newer one is ranked for the same query, whether it replaces a ranked one."""
    pair = ranked.select("query_id", F.col("doc_id").alias("older")).join(edges, "older")
    both = pair.join(ranked.select("query_id", F.col("doc_id").alias("newer"), F.lit(True).alias("here")), ["query_id", "newer"], "left")
    old = both.groupBy("query_id", F.col("older").alias("doc_id")).agg(F.count("*").alias("n_newer"), F.coalesce(F.max("here"), F.lit(False)).alias("newer_ranked"))
    new = both.filter("here").select("query_id", F.col("newer").alias("doc_id"), F.lit(True).alias("replaces")).distinct()
    out = ranked.join(old, ["query_id", "doc_id"], "left").join(new, ["query_id", "doc_id"], "left")
    return out.fillna({"n_newer": 0, "newer_ranked": False, "replaces": False})


def relationship_score(score: Column) -> Column:
    """Lower where a newer document exists: by .15, of an outdated one by .3, or by .4 if the newer one is ranked too; .05 more for
    one that replaces a ranked document."""
    outdated = F.col("status").isin("revoked", "historical")
    down = F.when(F.col("n_newer") > 0, F.when(outdated & F.col("newer_ranked"), 0.4).when(outdated, 0.3).otherwise(0.15)).otherwise(0.0)
    return F.round(score - down + F.when(F.col("replaces"), 0.05).otherwise(0.0), 6)


def keep_unless_empty(ranked: DataFrame, unwanted: Column) -> DataFrame:
    """Drops unwanted rows of a query unless that leaves none of it."""
    w = Window.partitionBy("query_id")
    return ranked.withColumn("_bad", unwanted).withColumn("_left", F.count_if(~F.col("_bad")).over(w)).filter("not _bad or _left = 0").drop("_bad", "_left")


def demoted_definitions(ranked: DataFrame, question: str, penalty: float = 0.12) -> DataFrame:
    """Scores of passages that define words are lowered, not below 0, unless the query asks for a meaning or has one row alone."""
    alone = F.count("*").over(Window.partitionBy("query_id")) < 2
    down = general_part(F.col("chapter"), F.col("section")) & ~asks_meaning(F.col(question)) & ~F.col("_alone")
    return ranked.withColumn("_alone", alone).withColumn("demoted", down).withColumn("score", F.when(down, F.round(F.greatest(F.lit(0.0), F.col("score") - penalty), 6)).otherwise(F.col("score"))).drop("_alone")


def expanded(ranked: DataFrame, passages: DataFrame, most: int = 4, leading: int = 3, decay: float = 0.85) -> DataFrame:
    """Ranked rows (query_id, passage_id, rank, score) and up to `most` neighbours of the first `leading`: (query_id, passage_id,
    score, added).

    Neighbours are the passages just before and after one in its document (passages: passage_id, document_id, place, article,
    text), of the same article, no headings and not ranked already; they are taken in the order of rank and place, each once, with
    `decay` of the score of the row that brings them.
    """
    order = Window.partitionBy("document_id").orderBy("place", "passage_id")
    side = lambda f: f(F.struct("passage_id", "article", heading_only(F.col("text")).alias("heading"))).over(order)
    near = passages.select("passage_id", "article", F.array_compact(F.array(side(F.lag), side(F.lead))).alias("near"))
    first = ranked.filter(F.col("rank") <= leading).select("query_id", "passage_id", "rank", "score")
    some = first.join(near, "passage_id").select("query_id", "rank", "score", "article", F.posexplode("near").alias("k", "x")).filter((F.col("article") == F.col("x.article")) & ~F.col("x.heading"))
    new = some.select("query_id", F.col("x.passage_id").alias("passage_id"), "rank", "k", "score").join(ranked.select("query_id", "passage_id"), ["query_id", "passage_id"], "left_anti")
    once = new.groupBy("query_id", "passage_id").agg(F.min(F.struct("rank", "k", "score")).alias("x"))
    taken = once.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("x.rank", "x.k"))).filter(F.col("n") <= most)
    more = taken.select("query_id", "passage_id", F.round(F.col("x.score") * decay, 6).alias("score"), F.lit(True).alias("added"))
    return ranked.select("query_id", "passage_id", "score", F.lit(False).alias("added")).unionByName(more)


def diversified(ranked: DataFrame, k: int, relevance_weight: float = 0.7, per_document: int = 3, pool: int = 300) -> DataFrame:
    """Greedy maximal marginal relevance over each query's first `pool` candidates: (query_id, doc_id, place).

    ranked: query_id, doc_id, score, text, document. A choice is worth weight x relevance (scaled within the pool) plus
    (1 - weight) x (1 - largest Jaccard similarity of tokens to a chosen one); ties go to the earlier candidate.
    """
    first = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("_r") <= min(max(2 * k, 100), pool))
    rows = first.select("query_id", "doc_id", "score", "document", "_r", F.array_distinct(tokens(F.col("text"))).alias("terms"))

    def chosen(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_r").reset_index(drop=True)
        sets, own = [set(x) for x in group["terms"]], group["score"].to_numpy()
        span = own.max() - own.min()
        relevance = (own - own.min()) / span if span > 0 else np.ones(len(own))
        nearest, taken, used = np.zeros(len(own)), [], {}
        while len(taken) < k:
            free = [i for i in range(len(own)) if i not in taken and used.get(group["document"][i], 0) < per_document]
            if not free:
                break
            value = relevance_weight * relevance + (1 - relevance_weight) * (1 - nearest)
            best = max(free, key=lambda i: (value[i], -i))
            taken.append(best)
            used[group["document"][best]] = used.get(group["document"][best], 0) + 1
            for i in free:
                every = len(sets[i] | sets[best])
                nearest[i] = max(nearest[i], len(sets[i] & sets[best]) / every if every else 0.0)
        return pd.DataFrame({"query_id": group["query_id"][0], "doc_id": group["doc_id"][taken], "place": range(1, len(taken) + 1)})

    return rows.groupBy("query_id").applyInPandas(chosen, "query_id long, doc_id long, place int")


def refusals(queries: DataFrame, ranked: DataFrame, in_scope: Column, threshold: float = 0.08) -> DataFrame:
    """Per query: why it isn't answered (out_of_scope, no_result, low_score), or null."""
    best = ranked.groupBy("query_id").agg(F.max("score").alias("top"))
    reason = F.when(~in_scope, "out_of_scope").when(F.col("top").isNull(), "no_result").when(F.col("top") < threshold, "low_score")
    return queries.join(best, "query_id", "left").select("query_id", reason.alias("refusal"))


def warnings(ranked: DataFrame) -> DataFrame:
    """Per query: warnings from status and n_newer of its rows, in a fixed order."""
    outdated = F.col("status").isin("revoked", "historical")
    flags = {
        "retrieved_source_status_needs_verification": F.bool_or(F.col("status") == "needs_verification"),
        "retrieved_source_contains_historical_or_revoked_document": F.bool_or(outdated),
        "retrieved_source_superseded_by_newer_document": F.bool_or(F.col("n_newer") > 0),
        "retrieved_source_revoked_or_superseded_document": F.bool_or((F.col("n_newer") > 0) & outdated),
    }
    return ranked.groupBy("query_id").agg(F.array_compact(F.array(*(F.when(c, name) for name, c in flags.items()))).alias("warnings"))


def citations(ranked: DataFrame, most_letters: int = 800) -> DataFrame:
    """Rows of (query_id, doc_id, rank, text) numbered cit_001, ...; repeated chunks count at their first rank."""
    once = ranked.groupBy("query_id", "doc_id").agg(F.min_by(F.struct("rank", "text"), "rank").alias("x"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("x.rank"))
    return once.select("query_id", "doc_id", F.format_string("cit_%03d", number).alias("citation"), F.substring(collapsed(F.col("x.text")), 1, most_letters).alias("quote"))


def first_documents(ranked: DataFrame, document: str, documents: int = 2, chunks: int = 4) -> DataFrame:
    """Of ranked rows: those of the query's first documents, by first appearance, no more than `chunks` in all."""
    seen = ranked.withColumn("_first", F.min("rank").over(Window.partitionBy("query_id", document)))
    chosen = seen.withColumn("_d", F.dense_rank().over(Window.partitionBy("query_id").orderBy("_first"))).filter(F.col("_d") <= documents)
    return chosen.withColumn("_c", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("_c") <= chunks).drop("_first", "_d", "_c")


def related_documents(ranked: DataFrame, document: str) -> DataFrame:
    """Each query's documents in order of first appearance: (query_id, document, place)."""
    first = ranked.groupBy("query_id", document).agg(F.min("rank").alias("_first"))
    return first.select("query_id", document, F.row_number().over(Window.partitionBy("query_id").orderBy("_first")).alias("place"))


def confidence(top: Column, results: Column, warned: Column, most_citations: int = 4) -> Column:
    """0 without results; else .75 of the top score and .25 of the citations' share, .15 less if warned, within .05 and .95."""
    value = F.least(top, F.lit(1.0)) * 0.75 + F.least(results / most_citations, F.lit(1.0)) * 0.25 - F.when(warned, 0.15).otherwise(0.0)
    return F.when(results == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.05), F.least(value, F.lit(0.95))), 3))


def within_budget(ranked: DataFrame, cost: Column, budget: int, separator: int = 2) -> DataFrame:
    """Rows in rank order while their cost and separators fit; the first misfit ends it."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(cost + separator).over(w) - separator
    return ranked.withColumn("used", total).withColumn("_over", F.max((F.col("used") > budget).cast("int")).over(w)).filter("_over = 0").drop("_over")
