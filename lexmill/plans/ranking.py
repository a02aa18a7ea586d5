"""Queries on ranked candidates: benchmark passages ask, each has its first 20 documents of the fused ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.words import word_list
from lexmill.operators import ranking, retrieval
from lexmill.sources.shared import stored

from .registry import Tables, query
from .retrieval import ECHO, LEXICAL, RANKED, SEMANTIC, fused

STATUS = "CASE WHEN l.toxic = 1 THEN 'revoked' WHEN l.quality = 0 THEN 'needs_verification' ELSE 'current' END"
TERMS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9_]+')"
POOL = f"""{LEXICAL}, {SEMANTIC}, {RANKED}, pool AS (SELECT p.*, b.text AS asked, d.text, d.lang, d.source, {STATUS} AS status, len(list_intersect(list_distinct({TERMS.format("b.text")}), {TERMS.format("d.text")})) / greatest(1, len(list_distinct({TERMS.format("b.text")}))) AS overlap, d.lang = 'en' AS topic_match, d.source = 'src1' AS article_match
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fusion, 12) DESC, doc_id) AS rank FROM fused) p JOIN benchmark b ON b.item_id = p.query_id JOIN documents d ON d.doc_id = p.doc_id LEFT JOIN labels l ON l.doc_id = p.doc_id WHERE rank <= 20),
scored AS (SELECT *, round(fusion * 0.45 + lexical * 0.2 + greatest(semantic, 0) * 0.2 + overlap * 0.15 + CASE WHEN topic_match THEN 0.2 ELSE 0 END + CASE WHEN article_match THEN 0.25 ELSE 0 END - CASE status WHEN 'revoked' THEN 0.2 WHEN 'needs_verification' THEN 0.05 ELSE 0 END, 6) AS score FROM pool)"""
EDGES = """edges AS (SELECT a.doc_id AS older, b.doc_id AS newer FROM (SELECT doc_id, lead(doc_id) OVER (PARTITION BY lang, source ORDER BY doc_id) AS next FROM documents) a JOIN documents b ON b.doc_id = a.next)"""
RELATED = f"""{EDGES}, rel AS (SELECT s.*, (SELECT count(*) FROM edges e WHERE e.older = s.doc_id) AS n_newer, EXISTS (SELECT 1 FROM edges e JOIN scored x ON x.doc_id = e.newer WHERE e.older = s.doc_id AND x.query_id = s.query_id) AS newer_ranked, EXISTS (SELECT 1 FROM edges e JOIN scored x ON x.doc_id = e.older WHERE e.newer = s.doc_id AND x.query_id = s.query_id) AS replaces FROM scored s)"""


def _pool(t: Tables) -> DataFrame:
    """Stored, as several steps read it: 20 rows for each query at most. Documents and labels that no query has ranked end where
    they are read: before a second join Spark takes the first one's rows for many, and would shuffle and sort all texts."""
    status = F.when(F.col("toxic") == 1, "revoked").when(F.col("quality") == 0, "needs_verification").otherwise("current")
    first = stored(retrieval.top_k(fused(t), F.round("fusion", 12), "doc_id", 20), "first")
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("asked"))
    chosen = stored(first.select("doc_id").distinct(), "chosen")
    texts, labels = (df.join(chosen, "doc_id", "left_semi") for df in (t.documents.select("doc_id", "text", "lang", "source"), t.labels))
    rows = first.join(asked, "query_id").join(texts, "doc_id").join(labels, "doc_id", "left")
    rows = rows.withColumn("status", status).withColumn("overlap", ranking.overlap(F.col("asked"), F.col("text"))).withColumn("topic_match", F.coalesce(F.col("lang") == "en", F.lit(False))).withColumn("article_match", F.coalesce(F.col("source") == "src1", F.lit(False)))
    return stored(rows.withColumn("score", F.round(ranking.rerank_score(), 6)), "pool")


def _edges(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    next_of = F.lead("doc_id").over(Window.partitionBy("lang", "source").orderBy("doc_id"))
    return t.documents.select(F.col("doc_id").alias("older"), next_of.alias("newer")).filter("newer is not null")


@query(f"""WITH {POOL} SELECT query_id, doc_id, score, array_to_string(list_filter([CASE WHEN topic_match THEN 'topic_match' END, CASE WHEN article_match THEN 'article_match' END, CASE status WHEN 'revoked' THEN 'historical_or_revoked_penalty' WHEN 'needs_verification' THEN 'needs_verification_warning' END], lambda x: x IS NOT NULL), ',') AS reasons FROM scored""")
def r_rerank(t: Tables) -> DataFrame:
    return _pool(t).select("query_id", "doc_id", "score", F.array_join(ranking.match_reasons(), ",").alias("reasons"))


@query(f"""WITH {POOL}, n AS (SELECT query_id, count(*) AS n FROM scored GROUP BY 1), w AS (SELECT query_id, doc_id, unnest(list_intersect(list_filter(list_distinct({TERMS.format("asked")}), lambda x: length(x) >= 5), list_distinct({TERMS.format("text")}))) AS term FROM scored),
f AS (SELECT w.*, count(*) OVER (PARTITION BY w.query_id, term) AS df FROM w), m AS (SELECT f.query_id, doc_id, count(*) AS matches FROM f JOIN n ON n.query_id = f.query_id WHERE n > 1 AND df <= greatest(1, floor(n * 0.7)) GROUP BY 1, 2)
SELECT s.query_id, s.doc_id, coalesce(matches, 0) AS matches, round(score + least(0.18, 0.09 * coalesce(matches, 0)), 6) AS score FROM scored s LEFT JOIN m ON m.query_id = s.query_id AND m.doc_id = s.doc_id""")
def r_focus(t: Tables) -> DataFrame:
    return ranking.focus_boost(_pool(t), "asked", "text", "score").select("query_id", "doc_id", "matches", "score")


@query(f"""WITH {POOL}, {RELATED} SELECT query_id, doc_id, n_newer, newer_ranked, replaces FROM rel""")
def jn_graph_1hop(t: Tables) -> DataFrame:
    return ranking.superseded(_pool(t), _edges(t)).select("query_id", "doc_id", "n_newer", "newer_ranked", "replaces")


@query(f"""WITH {POOL}, {RELATED} SELECT query_id, doc_id, round(score - CASE WHEN n_newer = 0 THEN 0 WHEN status <> 'revoked' THEN 0.15 WHEN newer_ranked THEN 0.4 ELSE 0.3 END + CASE WHEN replaces THEN 0.05 ELSE 0 END, 6) AS score FROM rel""")
def r_relationship(t: Tables) -> DataFrame:
    return ranking.superseded(_pool(t), _edges(t)).select("query_id", "doc_id", ranking.relationship_score(F.col("score")).alias("score"))


@query(f"""WITH {POOL}, {RELATED} SELECT query_id, array_to_string(list_filter([CASE WHEN bool_or(status = 'needs_verification') THEN 'retrieved_source_status_needs_verification' END, CASE WHEN bool_or(status = 'revoked') THEN 'retrieved_source_contains_historical_or_revoked_document' END, CASE WHEN bool_or(n_newer > 0) THEN 'retrieved_source_superseded_by_newer_document' END, CASE WHEN bool_or(n_newer > 0 AND status = 'revoked') THEN 'retrieved_source_revoked_or_superseded_document' END], lambda x: x IS NOT NULL), ',') AS warnings FROM rel GROUP BY 1""")
def r_warnings(t: Tables) -> DataFrame:
    return ranking.warnings(ranking.superseded(_pool(t), _edges(t))).select("query_id", F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH {POOL} SELECT item_id AS query_id, CASE WHEN item_id % 7 = 0 THEN 'out_of_scope' WHEN top IS NULL THEN 'no_result' WHEN top < 0.5 THEN 'low_score' END AS refusal FROM benchmark LEFT JOIN (SELECT query_id, max(score) AS top FROM scored GROUP BY 1) s ON s.query_id = item_id""")
def r_refuse(t: Tables) -> DataFrame:
    asked = t.benchmark.select(F.col("item_id").alias("query_id"))
    return ranking.refusals(asked, _pool(t), F.col("query_id") % 7 != 0, 0.5)  # every seventh stands for one out of scope


@query()
def r_mmr(t: Tables) -> DataFrame:
    return ranking.diversified(_pool(t).withColumn("document", F.coalesce("source", F.lit(""))), 10)


@query(f"""WITH {POOL} SELECT query_id, doc_id, printf('cit_%03d', row_number() OVER (PARTITION BY query_id ORDER BY rank)) AS citation, sha256(substr(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, 800)) AS quote FROM scored""")
def g_citations(t: Tables) -> DataFrame:
    return ranking.citations(_pool(t)).withColumn("quote", F.sha2("quote", 256))


@query(f"""WITH {POOL}, f AS (SELECT *, min(rank) OVER (PARTITION BY query_id, source) AS first FROM scored), dd AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS d FROM f), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS c FROM dd WHERE d <= 2) SELECT query_id, doc_id, source FROM c WHERE c <= 4""")
def g_select_citations(t: Tables) -> DataFrame:
    return ranking.first_documents(_pool(t), "source").select("query_id", "doc_id", "source")


@query(f"""WITH {POOL} SELECT query_id, source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first) AS INTEGER) AS place FROM (SELECT query_id, source, min(rank) AS first FROM scored GROUP BY 1, 2)""")
def g_related_docs(t: Tables) -> DataFrame:
    return ranking.related_documents(_pool(t), "source")


@query(f"""WITH {POOL} SELECT query_id, round(greatest(0.05, least(0.75 * least(max(score), 1.0) + 0.25 * least(count(*) / 4, 1.0) - CASE WHEN bool_or(status <> 'current') THEN 0.15 ELSE 0 END, 0.95)), 3) AS confidence FROM scored GROUP BY 1""")
def g_confidence(t: Tables) -> DataFrame:
    best = _pool(t).groupBy("query_id").agg(F.max("score").alias("top"), F.count("*").alias("n"), F.bool_or(F.col("status") != "current").alias("warned"))
    return best.select("query_id", ranking.confidence(F.col("top"), F.col("n"), F.col("warned")).alias("confidence"))


@query(f"""WITH {POOL}, c AS (SELECT *, len(list_filter(string_split(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ' '), lambda w: w <> '')) AS cost FROM scored), u AS (SELECT *, sum(cost + 2) OVER (PARTITION BY query_id ORDER BY rank) - 2 AS used FROM c), o AS (SELECT *, max(CASE WHEN used > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS over FROM u) SELECT query_id, doc_id, CAST(used AS BIGINT) AS used FROM o WHERE over = 0""")
def wn_prefix_budget(t: Tables) -> DataFrame:
    return ranking.within_budget(_pool(t), F.size(word_list(F.col("text"))), 2000).select("query_id", "doc_id", F.col("used").cast("long").alias("used"))


@query(f"""WITH {POOL}, {ECHO} SELECT s.query_id, round(avg(CASE WHEN e.doc_id IS NULL THEN 0 WHEN s.article_match THEN 1 ELSE 0.5 END), 6) AS correctness FROM scored s LEFT JOIN echo e ON e.query_id = s.query_id AND e.doc_id = s.doc_id WHERE rank <= 4 GROUP BY 1""")
def e_citation(t: Tables) -> DataFrame:
    expected = retrieval.shared_grams(t.benchmark.withColumnRenamed("item_id", "query_id"), t.documents, "query_id", "doc_id", 8).withColumn("expected", F.lit(True))
    cited = _pool(t).filter("rank <= 4").join(expected, ["query_id", "doc_id"], "left")
    return cited.groupBy("query_id").agg(F.round(F.avg(F.when(F.col("expected").isNull(), 0.0).when(F.col("article_match"), 1.0).otherwise(0.5)), 6).alias("correctness"))


@query(f"""WITH {ECHO} SELECT query_id, doc_id FROM echo""")
def g_prompt_echo(t: Tables) -> DataFrame:
    return retrieval.shared_grams(t.benchmark.withColumnRenamed("item_id", "query_id"), t.documents, "query_id", "doc_id", 8)


@query(f"""WITH {POOL}, {ECHO}, m AS (SELECT 'lexical' AS mode, query_id, doc_id, lexical AS value FROM scored UNION ALL SELECT 'semantic', query_id, doc_id, semantic FROM scored UNION ALL SELECT 'fusion', query_id, doc_id, fusion FROM scored UNION ALL SELECT 'final', query_id, doc_id, score FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY round(value, 9) DESC, doc_id) AS rank FROM m)
SELECT mode, count(DISTINCT e.query_id) AS queries, count(r.doc_id) FILTER (WHERE rank <= 5) AS hits, round(count(r.doc_id) FILTER (WHERE rank <= 5) / count(*), 6) AS recall FROM (SELECT DISTINCT mode FROM m) x CROSS JOIN echo e LEFT JOIN r USING (mode, query_id, doc_id) GROUP BY 1""")
def e_modes(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    modes = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(c).alias("value")) for m, c in (("lexical", "lexical"), ("semantic", "semantic"), ("fusion", "fusion"), ("final", "score")))))
    rows = _pool(t).select("query_id", "doc_id", modes.alias("x")).select("query_id", "doc_id", "x.*")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("mode", "query_id").orderBy(F.round("value", 9).desc(), "doc_id")))
    expected = retrieval.shared_grams(t.benchmark.withColumnRenamed("item_id", "query_id"), t.documents, "query_id", "doc_id", 8)
    every = expected.withColumn("mode", F.explode(F.array(*map(F.lit, ("lexical", "semantic", "fusion", "final")))))
    joined = every.join(ranked, ["mode", "query_id", "doc_id"], "left")
    return joined.groupBy("mode").agg(F.countDistinct("query_id").alias("queries"), F.count_if(F.col("rank") <= 5).alias("hits"), F.round(F.count_if(F.col("rank") <= 5) / F.count("*"), 6).alias("recall"))
