"""Queries of lookups, sets, states of jobs and the figures that a dashboard shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.words import tokens
from lexmill.operators import lookups, ordering, vectors
from lexmill.operators.retrieval import top_k

from .registry import Tables, query

K = "CAST(json_extract(props, '$.k') AS INTEGER)"


def _k():
    return F.get_json_object("props", "$.k").cast("int")


@query("""WITH last AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) SELECT o_custkey, last.o_orderkey, coalesce(n, 0) AS n FROM last LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def ag_chunk_counts(t: Tables) -> DataFrame:
    return lookups.children_of_newest(t.orders, t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("""SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY seen) AS neighbours FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS seen FROM orders GROUP BY 1, 2) GROUP BY 1""")
def ag_adjacency(t: Tables) -> DataFrame:
    return lookups.adjacency(t.orders, "o_custkey", "o_orderpriority", ["o_orderkey"]).withColumn("neighbours", F.array_join("neighbours", ","))


@query("""SELECT o_custkey, sha256(string_agg(line, chr(10) ORDER BY line)) AS hash FROM (SELECT o_custkey, o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority AS line FROM orders) GROUP BY 1""")
def ag_snapshot_hash(t: Tables) -> DataFrame:
    return lookups.snapshot_hash(t.orders, ["o_custkey"], ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("""SELECT c_custkey, o_orderkey, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def jn_inner_builds(t: Tables) -> DataFrame:
    counted = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return counted.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey").join(t.customer.select("c_custkey"), "c_custkey").select("c_custkey", "o_orderkey", "n")


@query("""SELECT doc_id, coalesce(len(embedding), 0) AS size FROM documents LEFT JOIN embeddings ON vec_id = doc_id""")
def jn_lookup_left(t: Tables) -> DataFrame:
    sizes = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.size("embedding").cast("long").alias("size"))
    return t.documents.select("doc_id").join(sizes, "doc_id", "left").fillna({"size": 0})


@query("""SELECT event_id, user_id, c_name FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) LEFT JOIN customer ON c_custkey = user_id""")
def jn_lookup_names(t: Tables) -> DataFrame:
    page = ordering.page(t.events, [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "user_id")
    return lookups.named_page(page, t.customer.withColumnRenamed("c_custkey", "user_id"), "user_id", "c_name").select("event_id", "user_id", "c_name")


@query("""SELECT o_orderkey, CASE WHEN lag(o_orderstatus) OVER w = o_orderstatus THEN lag(o_orderkey) OVER w END AS previous, CASE WHEN lead(o_orderstatus) OVER w = o_orderstatus THEN lead(o_orderkey) OVER w END AS following FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def jn_neighbor(t: Tables) -> DataFrame:
    return lookups.neighbours(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", "o_orderstatus")


@query("""SELECT doc_id FROM documents WHERE (doc_id, sha256(text)) NOT IN (SELECT doc_id, sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) OR text IS NULL""")
def v_resume(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))
    return lookups.unresumed(rows, rows.filter("doc_id % 3 = 0"), ["doc_id", "hash"]).select("doc_id")  # every third stands for a checkpoint


@query(f"""SELECT event_id, CASE WHEN event_id = first THEN 'run' WHEN event_type = kind THEN 'replay' ELSE 'conflict' END AS outcome FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, {K}) AS first, first_value(event_type) OVER (PARTITION BY user_id, {K} ORDER BY event_id) AS kind FROM events)""")
def o_idempotency(t: Tables) -> DataFrame:
    return lookups.replays(t.events.withColumn("k", _k()), ["user_id", "k"], ["event_id"], "event_type").select("event_id", "outcome")


@query(f"""WITH s AS (SELECT event_id, CASE {K} % 9 WHEN 0 THEN NULL WHEN 1 THEN 200 WHEN 2 THEN 401 WHEN 3 THEN 404 WHEN 4 THEN 418 WHEN 5 THEN 429 WHEN 6 THEN 500 ELSE 503 END AS status, CASE {K} % 4 WHEN 0 THEN 'upstream_Timeout' WHEN 1 THEN 'rag_index' WHEN 2 THEN 'RATE_LIMIT' END AS code FROM events)
SELECT event_id, CASE WHEN contains(lower(coalesce(code, '')), 'timeout') THEN 'timeout' WHEN status = 429 OR contains(lower(coalesce(code, '')), 'rate_limit') THEN 'rate_limited' WHEN status = 503 AND contains(lower(coalesce(code, '')), 'rag_') THEN 'provider' WHEN status IS NULL THEN 'unknown' WHEN status IN (401, 403) THEN 'auth' WHEN status IN (400, 404, 422) THEN 'validation' WHEN status BETWEEN 400 AND 499 THEN 'client' WHEN status >= 500 THEN 'server' ELSE 'ok' END AS class FROM s""")
def o_classify(t: Tables) -> DataFrame:
    statuses = F.array(*(F.lit(x).cast("int") for x in (None, 200, 401, 404, 418, 429, 500, 503, 503)))
    codes = F.array(*(F.lit(x).cast("string") for x in ("upstream_Timeout", "rag_index", "RATE_LIMIT", None)))
    rows = t.events.select("event_id", statuses[_k() % 9].alias("status"), codes[_k() % 4].alias("code"))
    return rows.select("event_id", lookups.error_class(F.col("status"), F.col("code")).alias("class"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events), s AS (SELECT event_id, user_id, event_type IN ('view', 'click') AND ts < now - INTERVAL 2 HOUR AS stuck, event_type = 'purchase' AS healthy FROM events, m), h AS (SELECT DISTINCT user_id FROM s WHERE healthy)
SELECT event_id, CASE WHEN h.user_id IS NULL THEN 'failed' ELSE 'kept' END AS version FROM s LEFT JOIN h ON h.user_id = s.user_id WHERE stuck""")
def o_stuck(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("now"))  # one row
    stuck = t.events.join(F.broadcast(now), F.col("ts") < F.col("now") - F.expr("INTERVAL 2 HOUR")).filter("event_type in ('view', 'click')")
    healthy = t.events.filter("event_type = 'purchase'").select("user_id", F.lit(True).alias("healthy")).distinct()
    return stuck.join(healthy, "user_id", "left").select("event_id", F.when(F.col("healthy"), "kept").otherwise("failed").alias("version"))


@query("""SELECT c_custkey, coalesce(price, 100.0) AS price FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o_custkey = c_custkey""")
def o_rule_latest(t: Tables) -> DataFrame:
    newest = t.orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("price"))
    return t.customer.select("c_custkey").join(newest, "c_custkey", "left").fillna({"price": 100.0})


@query("""WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations), w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS a, list_distinct(regexp_extract_all(lower(coalesce(next, '')), '[a-z0-9_]+')) AS b FROM p WHERE next IS NOT NULL)
SELECT conv_id, turn, len(list_intersect(a, b)) AS shared, CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) END AS similarity FROM w""")
def st_jaccard(t: Tables) -> DataFrame:
    pairs = t.conversations.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("next is not null")
    shared = F.size(F.array_intersect(tokens(F.col("text")), tokens(F.col("next")))).cast("long")
    return pairs.select("conv_id", "turn", shared.alias("shared"), F.round(lookups.jaccard(F.col("text"), F.col("next")), 6).alias("similarity"))


@query("""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM benchmark) SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: list_position(w, x))), lambda i: w[i]), ' ') AS terms FROM w""")
def st_distinct_ordered(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(F.array_distinct(tokens(F.col("text"))), " ").alias("terms"))


@query("""SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 WHERE b.label < 5)) WHERE rank <= 5""")
def so_topk_vector(t: Tables) -> DataFrame:
    asked = t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return top_k(vectors.nearest(asked, t.embeddings.filter("label < 5"), "query_id", "vec_id", "embedding", 5), F.round("score", 9), "vec_id", 5).select("query_id", "rank", "vec_id")


@query(r"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark), c AS (SELECT item_id, CAST('0x' || substr(sha256(term), 1, 8) AS BIGINT) AS i, 1 + ln(1 + count(*)) AS w FROM w GROUP BY item_id, term) SELECT item_id, i, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS w FROM c""")
def r_sparse_vec(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.explode(lookups.sparse_vector(F.col("text"))).alias("x")).select("item_id", "x.i", F.round("x.w", 6).alias("w"))


@query("""SELECT round(min(s), 6) AS worst, min(s) >= 0.99 AS compatible FROM (SELECT list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 2))) AS s FROM embeddings)""")
def v_compat(t: Tables) -> DataFrame:
    fresh = F.transform("embedding", lambda x: F.round(x.cast("double"), 2))
    return t.embeddings.agg(F.coalesce(F.round(F.min(vectors.cosine(F.col("embedding"), fresh)), 6), F.lit(0.0)).alias("worst"), F.coalesce(F.min(vectors.cosine(F.col("embedding"), fresh)) >= 0.99, F.lit(False)).alias("compatible"))


@query(r"""SELECT page_id, round(len(regexp_extract_all(html, '[\x{FFFD}\p{Cc}\p{Cf}\p{Co}]')) / length(html) - len(regexp_extract_all(html, '[\n\t]')) / length(html), 6) AS rate FROM pages""")
def tx_corruption(t: Tables) -> DataFrame:
    return t.pages.select("page_id", lookups.corruption_rate(F.col("html")).alias("rate"))


@query("""SELECT page_id, CASE WHEN length(trim(coalesce(html, ''))) >= 40 THEN 'text' WHEN page_id % 2 > 0 THEN 'scanned' ELSE 'empty' END AS kind FROM pages""")
def tx_kind(t: Tables) -> DataFrame:
    return t.pages.select("page_id", lookups.text_kind(F.col("html"), F.col("page_id") % 2).alias("kind"))


@query("""SELECT doc_id, n - 1 AS others, least FROM (SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) AS n, min(doc_id) OVER (PARTITION BY sha256(text)) AS least FROM documents WHERE text IS NOT NULL) WHERE n > 1""")
def tx_dup_file(t: Tables) -> DataFrame:
    hashed = t.documents.filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    groups = hashed.groupBy("h").agg((F.count("*") - 1).alias("others"), F.min("doc_id").alias("least")).filter("others > 0")
    return hashed.join(groups, "h").select("doc_id", "others", "least")


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE toxic = 0) AS clean, count(*) FILTER (WHERE toxic IS NULL) AS pending, greatest(0, count(*) - count(toxic)) AS processing, round(100.0 * count(toxic) / count(*), 4) AS done FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def ui_residual(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left").groupBy("source")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic").isNull()).alias("pending"), F.greatest(F.lit(0), F.count("*") - F.count("toxic")).alias("processing"), F.round(F.try_divide(100.0 * F.count("toxic"), F.count("*").cast("double")), 4).alias("done"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 100) AS slow, count(*) FILTER (WHERE props IS NOT NULL) AS with_props FROM events""")
def ui_counts(t: Tables) -> DataFrame:
    return t.events.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 100).alias("slow"), F.count_if(F.col("props").isNotNull()).alias("with_props"))


@query(f"""SELECT 'm' || {K} AS model, round(sum(value), 4) AS tokens FROM events WHERE starts_with('m' || {K}, 'm1') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6""")
def ui_model_rollup(t: Tables) -> DataFrame:
    named = t.events.select(F.concat(F.lit("m"), _k().cast("string")).alias("model"), "value").filter(F.startswith("model", F.lit("m1")))
    return named.groupBy("model").agg(F.round(F.sum("value"), 4).alias("tokens")).orderBy(F.desc("tokens"), "model").limit(6)


@query("""WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, CAST(sum(n) AS BIGINT) AS total, max(n) AS most, CAST(row_number() OVER (ORDER BY max(n) DESC, event_type) AS INTEGER) AS place FROM d GROUP BY 1""")
def ui_series_totals(t: Tables) -> DataFrame:
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    series = daily.groupBy("event_type").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    return series.withColumn("place", F.row_number().over(Window.orderBy(F.desc("most"), "event_type")))  # a row for each series


@query("""WITH r AS (SELECT ts::DATE AS day, event_type AS mode, avg(value) AS score FROM events GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(score, 9) DESC, mode) AS k FROM r) SELECT CAST(day AS VARCHAR) AS day, mode, round(score, 6) AS score, round(score - lag(score) OVER (ORDER BY day), 6) AS delta FROM b WHERE k = 1""")
def ui_best_mode(t: Tables) -> DataFrame:
    runs = t.events.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("mode")).agg(F.avg("value").alias("score"))
    best = ordering.first_per_key(runs, ["day"], [F.round("score", 9).desc(), F.col("mode")])
    before = F.lag("score").over(Window.orderBy("day"))  # a row for each day
    return best.select(F.col("day").cast("string").alias("day"), "mode", F.round("score", 6).alias("score"), F.round(F.col("score") - before, 6).alias("delta"))


@query("""SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'the') AND lang = 'en' AND source IN ('src1', 'src2')""")
def ui_search(t: Tables) -> DataFrame:
    return t.documents.filter(F.lower("text").contains("the") & (F.col("lang") == "en") & F.col("source").isin("src1", "src2")).select("doc_id")
