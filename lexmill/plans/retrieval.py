"""Queries of retrieval and its evaluation: benchmark passages ask, documents answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.words import tokens
from lexmill.operators import measures, retrieval, vectors
from lexmill.sources.shared import stored

from .registry import Tables, query

#: Lexical scores of every pair that shares a term.
LEXICAL = r"""q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark) GROUP BY 1, 2),
d AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents) GROUP BY 1, 2),
k AS (SELECT doc_id, count(*) AS terms FROM d GROUP BY 1),
lex AS (SELECT query_id, d.doc_id, sum(times * (1 + ln(1 + tf))) / sqrt(any_value(terms)) AS score FROM d JOIN q ON q.term = d.term JOIN k ON k.doc_id = d.doc_id GROUP BY 1, 2)"""
#: Documents that share eight words in a row with a query.
ECHO = r"""words AS (SELECT 0 AS side, item_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark UNION ALL SELECT 1, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') FROM documents),
grams AS (SELECT DISTINCT side, id, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT side, id, w, unnest(range(1, len(w) - 6)) AS p FROM words)),
echo AS (SELECT DISTINCT q.id AS query_id, d.id AS doc_id FROM grams q JOIN grams d ON d.g = q.g AND q.side = 0 AND d.side = 1)"""
#: Both rankings down to this place; a document's vector and a query's are those of its id.
DEPTH = 100
SEMANTIC = f"""sem AS (SELECT b.item_id AS query_id, e.vec_id AS doc_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM benchmark b JOIN embeddings a ON a.vec_id = b.item_id JOIN embeddings e ON true SEMI JOIN documents d ON d.doc_id = e.vec_id)"""
RANKED = f"""lr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM lex WHERE score > 0) WHERE rank <= {DEPTH}),
sr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sem WHERE score > 0) WHERE rank <= {DEPTH}),
fused AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS fusion, coalesce(max(score) FILTER (WHERE side = 0), 0) AS lexical, coalesce(max(score) FILTER (WHERE side = 1), 0) AS semantic FROM (SELECT *, 0 AS side FROM lr UNION ALL SELECT *, 1 FROM sr) GROUP BY 1, 2)"""


def _lexical(t: Tables) -> DataFrame:
    return retrieval.lexical_scores(t.benchmark.withColumnRenamed("item_id", "query_id"), t.documents)


def fused(t: Tables) -> DataFrame:
    """(query_id, doc_id, fusion, lexical, semantic) of the first documents by terms and by vectors."""
    asked = t.benchmark.select(F.col("item_id").alias("query_id")).join(t.embeddings, F.col("vec_id") == F.col("query_id")).select("query_id", "embedding")
    known = t.embeddings.withColumnRenamed("vec_id", "doc_id").join(t.documents.select("doc_id"), "doc_id", "left_semi")
    lexical = retrieval.first_ranked(_lexical(t), DEPTH)
    semantic = retrieval.first_ranked(vectors.nearest(asked, known, "query_id", "doc_id", "embedding", DEPTH), DEPTH)
    return retrieval.fused_scores({"lexical": lexical, "semantic": semantic})


@query(f"""WITH {LEXICAL} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM lex) WHERE rank <= 10""")
def r_lexical(t: Tables) -> DataFrame:
    return retrieval.top_k(_lexical(t), F.round("score", 9), "doc_id", 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {LEXICAL}, {SEMANTIC}, {RANKED} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(fusion, 8) AS fusion FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fusion, 12) DESC, doc_id) AS rank FROM fused) WHERE rank <= 10""")
def r_rrf(t: Tables) -> DataFrame:
    return retrieval.top_k(fused(t), F.round("fusion", 12), "doc_id", 10).select("query_id", "rank", "doc_id", F.round("fusion", 8).alias("fusion"))


@query(f"""WITH {LEXICAL} SELECT query_id, count(*) AS n, round(avg(CASE WHEN h > l THEN (score - l) / (h - l) ELSE 1.0 END), 6) AS mean_scaled FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS l, max(score) OVER (PARTITION BY query_id) AS h FROM lex) GROUP BY 1""")
def r_minmax(t: Tables) -> DataFrame:
    return retrieval.min_max(stored(_lexical(t), "scores"), "score", "scaled").groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("scaled"), 6).alias("mean_scaled"))


@query(r"""SELECT item_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS terms FROM benchmark""")
def r_tokenize(t: Tables) -> DataFrame:
    words = tokens(F.col("text"))
    return t.benchmark.select("item_id", F.size(words).cast("long").alias("n"), F.size(F.array_distinct(words)).cast("long").alias("terms"))


@query("""SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0)) WHERE rank <= 10""")
def r_cosine(t: Tables) -> DataFrame:
    asked = t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectors.nearest(asked, t.embeddings, "query_id", "vec_id", "embedding", 10)
    return retrieval.top_k(found, F.round("score", 9), "vec_id", 10).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH {LEXICAL}, {ECHO}, top AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM lex),
truth AS (SELECT query_id, doc_id FROM echo),
w AS (SELECT query_id, count(*) AS wanted FROM truth GROUP BY 1),
h AS (SELECT t.query_id, count(*) FILTER (WHERE rank <= 5) AS hits, min(rank) AS first, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1.0) END) AS gain FROM top JOIN truth t ON t.query_id = top.query_id AND t.doc_id = top.doc_id GROUP BY 1)
SELECT w.query_id, round(coalesce(hits, 0) / wanted, 6) AS recall, round(coalesce(hits, 0) / 5, 6) AS "precision", CAST(coalesce(hits, 0) > 0 AS INTEGER) AS hit, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, round(coalesce(gain, 0) / list_sum(list_transform(range(1, CAST(least(wanted, 5) AS BIGINT) + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg FROM w LEFT JOIN h ON h.query_id = w.query_id""")
def e_recall(t: Tables) -> DataFrame:
    truth, scores = expected_scores(t)
    return retrieval.ranking_metrics(retrieval.relevant_ranks(scores, F.col("relevant"), 5), truth)


def expected_scores(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The documents that each question expects, and all lexical scores with whether they are expected, both stored."""
    truth = stored(retrieval.shared_grams(t.benchmark.withColumnRenamed("item_id", "query_id"), t.documents, "query_id", "doc_id", 8), "truth")
    return truth, stored(retrieval.marked(_lexical(t).withColumn("score", F.round("score", 9)).filter("score > 0"), truth), "scores")


@query("""WITH s AS (SELECT l.doc_id, n_chars / 20000.0 AS score, toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id), c AS (SELECT DISTINCT score AS threshold FROM s UNION SELECT 0.0 UNION SELECT 1.0), g AS (SELECT score, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS bad FROM s GROUP BY 1), j AS (SELECT threshold, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad FROM c LEFT JOIN g ON g.score = c.threshold),
a AS (SELECT threshold, coalesce(sum(bad) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + coalesce(sum(n - bad) OVER (ORDER BY threshold ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS correct, sum(n) OVER () AS every FROM j)
SELECT CAST(threshold AS DOUBLE) AS threshold, round(correct / every, 6) AS accuracy FROM a ORDER BY correct DESC, threshold DESC LIMIT 1""")
def e_threshold(t: Tables) -> DataFrame:
    return measures.best_threshold(t.labels.join(t.documents, "doc_id").select((F.col("n_chars") / 20000.0).alias("score"), (F.col("toxic") == 1).alias("below")))


@query("""WITH p AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) SELECT conv_id, count(*) AS pairs FROM p WHERE role = 'user' AND next = 'assistant' GROUP BY 1""")
def g_memory(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.withColumn("next", F.lead("role").over(w)).filter("role = 'user' and next = 'assistant'").groupBy("conv_id").agg(F.count("*").alias("pairs"))


@query(r"""SELECT conv_id, turn, CAST(greatest(1, floor(len(list_filter(string_split(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' '), lambda w: w <> '')) * CAST(1.15 AS DOUBLE))) AS BIGINT) AS tokens FROM conversations""")
def g_token_budget(t: Tables) -> DataFrame:
    from lexmill.functions.words import word_list

    return t.conversations.select("conv_id", "turn", F.greatest(F.lit(1), F.floor(F.size(word_list(F.col("text"))) * F.lit(1.15))).cast("long").alias("tokens"))
