"""What decides on a release: gates of cleaned texts, sweeps of weights, comparisons, and who may see what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.headings import heading_only
from lexmill.functions.sentences import estimated_tokens

from . import chunking, ranking


def official(rows: DataFrame, url: str, domains: DataFrame) -> DataFrame:
    """Rows whose https address lies on a domain of the table (domain) or below it. Null and other addresses go.

    A host is split into itself and the domains above it, so the tables meet by equality.
    """
    host = F.lower(F.regexp_extract(F.col(url), r"^https://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = domains.select(F.lower("domain").alias("_domain")).distinct()
    return rows.withColumn("_domain", F.explode(F.when(host != "", above))).join(known, "_domain", "left_semi").drop("_domain").distinct()


def visible(documents: DataFrame, eligible: DataFrame, key: str, digest: str) -> DataFrame:
    """Documents whose digest is the eligible one of their key: a newer file that nobody has reviewed is not shown."""
    return documents.join(eligible.select(key, digest).distinct(), [key, digest], "left_semi")


def settled(started: Column, cancelled: Column, prompt: Column, completion: Column, answer_tokens: Column, estimated: Column, reserved: Column) -> Column:
    """What a turn used, as (prompt_tokens, completion_tokens, source): the provider's figures where it gave some, else
    estimates; nothing if it never started, what was reserved if there is neither a figure nor an answer.
    """
    p, c, a = (F.greatest(F.lit(0), F.coalesce(x, F.lit(0)).cast("long")) for x in (prompt, completion, answer_tokens))
    given = p + c > 0
    own_prompt = F.when(p > 0, p).otherwise(estimated.cast("long"))
    answered = F.when(a > 0, F.greatest(F.lit(1), a)).otherwise(F.lit(0)).cast("long")
    row = lambda x, y, s: F.struct(x.cast("long").alias("prompt_tokens"), y.cast("long").alias("completion_tokens"), s.alias("source"))
    told = F.when(given, "provider").otherwise("estimated")
    whole = F.when((p > 0) & ((c > 0) | (a == 0)), "provider").otherwise("estimated")
    return (
        F.when(~started, row(F.lit(0), F.lit(0), F.lit("none")))
        .when(cancelled, row(own_prompt, c, told))
        .when(given, row(own_prompt, F.when(c > 0, c).otherwise(answered), whole))
        .when(a > 0, row(estimated, answered, F.lit("estimated")))
        .otherwise(row(reserved, F.lit(0), F.lit("estimated")))
    )


def cleaning_gates(chunks: DataFrame, detected: DataFrame, most_tokens: int) -> DataFrame:
    """Per document_id: whether its articles were found, follow each other, are all in chunks, no chunk repeats another and all
    are within the budget; status passed if all hold, else review_required. headings, the number of chunks that are headings
    alone, holds nothing back.

    chunks: document_id, article, text; detected: document_id, article ('Pasal 12'), null for a document without any.
    """
    told = chunks.select("document_id", F.unhex(F.sha2(F.lower(F.regexp_replace("text", r"\s+", " ")), 256)).alias("h"), estimated_tokens(F.col("text")).alias("t"), heading_only(F.col("text")).alias("heading"))
    texts = told.groupBy("document_id", "h").agg(F.count("*").alias("m"), F.max("t").alias("t"), F.min("t").alias("l"), F.count_if("heading").alias("headings"))
    sizes = texts.groupBy("document_id").agg(F.count_if(F.col("m") > 1).alias("repeated"), F.count_if((F.col("t") > most_tokens) | (F.col("l") <= 0)).alias("overlong"), F.sum("headings").alias("headings"))
    both = detected.select("document_id", "article", F.lit(False).alias("held")).unionByName(chunks.select("document_id", "article", F.lit(True).alias("held")))
    number = F.when(F.col("seen"), F.regexp_extract("article", r"(\d+)", 1).try_cast("bigint"))
    seen = both.groupBy("document_id", "article").agg(F.bool_or(~F.col("held")).alias("seen"), F.bool_or("held").alias("held"))
    named = F.col("seen") & F.col("article").isNotNull()
    articles = seen.groupBy("document_id").agg(F.count_if("seen").alias("n"), F.count_if(named).alias("articles"), (F.coalesce(F.max(number), F.lit(0)) - F.size(F.collect_set(number))).alias("missing"), F.count_if(named & ~F.col("held")).alias("unchunked")).filter("n > 0").drop("n")
    out = articles.join(sizes, "document_id", "left").fillna(0, ["repeated", "overlong", "headings"])
    passed = (F.col("articles") > 0) & (F.col("missing") == 0) & (F.col("unchunked") == 0) & (F.col("repeated") == 0) & (F.col("overlong") == 0)
    return out.withColumn("status", F.when(passed, "passed").otherwise("review_required"))


def cleaning_report(chunks: DataFrame, detected: DataFrame, unresolved: DataFrame, margins: DataFrame, most_tokens: int) -> DataFrame:
    """cleaning_gates with its three warnings, which hold nothing back: unresolved (pages that nobody could read), headings (chunks
    that are headings alone) and margin_noise (chunks with a removed line as one of theirs).

    unresolved: document_id, page; margins: document_id, line.
    """
    gates = cleaning_gates(chunks, detected, most_tokens)
    pages = unresolved.groupBy("document_id").agg(F.count("*").alias("unresolved"))
    removed = margins.groupBy("document_id").agg(F.collect_set(F.trim("line")).alias("removed"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    noisy = chunks.select("document_id", "chunk_id", "text").join(removed, "document_id").filter(F.arrays_overlap(lines, "removed")).groupBy("document_id").agg(F.count_distinct("chunk_id").alias("margin_noise"))
    out = gates
    for x in (pages, noisy):
        out = out.join(x, "document_id", "left")
    return out.fillna(0, ["unresolved", "margin_noise"])


def swept(scored: DataFrame, truth: DataFrame, options: dict[str, dict[str, float]], base: dict[str, float], k: int = 5) -> DataFrame:
    """For each option of weights: mean recall in the first k and mean reciprocal rank, over the queries of truth (query_id, doc_id).

    scored: query_id, doc_id, score by the base weights, and the weighed columns. All options are ranked in one job.
    """
    listed = F.array(*[F.struct(F.lit(n).alias("option"), *[F.lit(w.get(c, base[c]) - base[c]).alias(f"d_{c}") for c in base]) for n, w in options.items()])
    rows = scored.withColumn("x", F.explode(listed))
    moved = rows.select(F.col("x.option").alias("option"), "query_id", "doc_id", F.round(F.col("score") + sum(F.col(f"x.d_{c}") * F.col(c) for c in base), 6).alias("score"))
    ranked = moved.withColumn("rank", F.row_number().over(Window.partitionBy("option", "query_id").orderBy(F.desc("score"), "doc_id")))
    return ranked_options(ranked, truth, list(options), k)


def diversified_options(scored: DataFrame, truth: DataFrame, options: dict[str, float], k: int = 5) -> DataFrame:
    """swept for weights of relevance against diversity: each query's first ten by maximal marginal relevance."""
    ranked = None
    for name, weight in options.items():
        own = ranking.diversified(scored, 10, weight).select(F.lit(name).alias("option"), "query_id", "doc_id", F.col("place").alias("rank"))
        ranked = own if ranked is None else ranked.unionByName(own)
    return ranked_options(ranked, truth, list(options), k)


def ranked_options(ranked: DataFrame, truth: DataFrame, options: list[str], k: int) -> DataFrame:
    """(option, mean_recall, mean_reciprocal_rank) of rankings (option, query_id, doc_id, rank); queries without results count 0."""
    wanted = truth.groupBy("query_id").agg(F.count("*").alias("wanted"))
    hits = ranked.join(truth, ["query_id", "doc_id"]).groupBy("option", "query_id").agg(F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"))
    every = wanted.withColumn("option", F.explode(F.array(*map(F.lit, options))))
    each = every.join(hits, ["option", "query_id"], "left")
    return each.groupBy("option").agg(F.round(F.avg(F.coalesce("hits", F.lit(0)) / F.col("wanted")), 6).alias("mean_recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mean_reciprocal_rank"))


def chunk_options(segments: DataFrame, options: dict[str, dict[str, int]]) -> DataFrame:
    """Per option of chunking.chunked: (option, chunk_count, avg_chunk_tokens, min_chunk_tokens, max_chunk_tokens,
    avg_overlap_ratio, parent_text_ratio): how many chunks there are, their tokens, the share of a chunk that the next one of its
    document repeats, and the length of the texts around them by their own. Segments are read once for each option.
    """
    before = Window.partitionBy("document_id").orderBy("unit", "part")
    out = None
    for name, option in options.items():
        own = chunking.chunked(segments, F.lit(""), F.lit(1), **option).select("document_id", "unit", "part", "token_estimate", "repeated", F.length("text").alias("n"), F.length("parent_text").alias("p")).withColumn("last", F.lag("n").over(before))
        own = own.groupBy(F.lit(name).alias("option")).agg(
            F.count("*").alias("chunk_count"), F.round(F.avg("token_estimate"), 1).alias("avg_chunk_tokens"), F.min("token_estimate").alias("min_chunk_tokens"), F.max("token_estimate").alias("max_chunk_tokens"),
            F.round(F.avg(F.col("repeated") / F.col("last")), 3).alias("avg_overlap_ratio"), F.round(F.sum("p") / F.greatest(F.lit(1), F.sum("n")), 3).alias("parent_text_ratio"),
        )
        out = own if out is None else out.unionByName(own)
    return out


def compared(figures: DataFrame, name: str, before: str, after: str, higher: list[str], lower: list[str]) -> DataFrame:
    """Per measure: its value in the rows named before and after, the change, and whether it got worse."""
    listed = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"), F.lit(s).alias("sign")) for s, ms in ((1, higher), (-1, lower)) for m in ms])
    rows = figures.filter(F.col(name).isin(before, after)).select(name, F.explode(listed).alias("x")).select(name, "x.*")
    both = rows.groupBy("measure").agg(F.max(F.when(F.col(name) == before, F.col("value"))).alias("before"), F.max(F.when(F.col(name) == after, F.col("value"))).alias("after"), F.max("sign").alias("sign"))
    change = F.col("after") - F.col("before")
    return both.select("measure", "before", "after", F.round(change, 6).alias("change"), (change * F.col("sign") < -1e-9).alias("worse"))
