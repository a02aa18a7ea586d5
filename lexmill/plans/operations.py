"""Queries of operational analytics: events stand for requests and observations, orders for versions and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.numbers import clamp, ratio
from lexmill.operators import alerts, measures, ordering, sets

from .registry import Tables, query

BUCKET = "CASE WHEN value <= 50 THEN '50' WHEN value <= 100 THEN '100' WHEN value <= 250 THEN '250' WHEN value <= 500 THEN '500' WHEN value <= 1000 THEN '1000' WHEN value <= 2000 THEN '2000' WHEN value <= 5000 THEN '5000' WHEN value <= 15000 THEN '15000' ELSE '+Inf' END"


def _error() -> Column:
    return F.col("event_type") == "error"


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(value) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def ag_percentiles(t: Tables) -> DataFrame:
    return measures.percentiles(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("""SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, count(value) AS n FROM events GROUP BY 1""")
def ag_len_dist_nearest(t: Tables) -> DataFrame:
    return measures.nearest_rank(t.events, ["event_type"], "value", {"p95": 0.95, "p99": 0.99})


@query(f"""SELECT event_type, {BUCKET} AS bucket, count(*) AS "count" FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def ag_hist_record(t: Tables) -> DataFrame:
    return measures.histogram(t.events, ["event_type"], F.col("value"))


@query(f"""SELECT bucket, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type, {BUCKET} AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def ag_hist_merge(t: Tables) -> DataFrame:
    maps = measures.histogram(t.events, ["event_type"], F.col("value")).groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "count"))).alias("counts"))
    return maps.select(F.explode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))


@query("""WITH h AS (SELECT event_type, CASE WHEN value <= 50 THEN 25.0 WHEN value <= 100 THEN 75.0 WHEN value <= 250 THEN 175.0 WHEN value <= 500 THEN 375.0 WHEN value <= 1000 THEN 750.0 WHEN value <= 2000 THEN 1500.0 WHEN value <= 5000 THEN 3500.0 WHEN value <= 15000 THEN 10000.0 ELSE 22500.0 END AS m, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY m) AS upto, sum(n) OVER (PARTITION BY event_type) AS every FROM h)
SELECT event_type, CAST(min(m) AS DOUBLE) AS p95 FROM r WHERE upto >= greatest(1, ceil(every * 0.95)) GROUP BY 1""")
def ag_hist_percentile(t: Tables) -> DataFrame:
    return measures.histogram_percentile(measures.histogram(t.events, ["event_type"], F.col("value")), ["event_type"], 0.95, "p95")


@query("""SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute, event_type, count(*) AS "count", count(*) FILTER (WHERE event_type = 'error') AS error_count, round(sum(value), 4) AS sum_latency FROM events GROUP BY 1, 2""")
def o_bucket(t: Tables) -> DataFrame:
    return measures.minute_buckets(t.events, "ts", ["event_type"], _error(), F.col("value")).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("""WITH d AS (SELECT unnest(generate_series(date '2023-12-30', date '2024-02-02', interval 1 day))::DATE AS day), g AS (SELECT ts::DATE AS day, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) AS users FROM events GROUP BY 1)
SELECT CAST(d.day AS VARCHAR) AS day, coalesce(requests, 0) AS requests, coalesce(errors, 0) AS errors, coalesce(users, 0) AS users FROM d LEFT JOIN g ON g.day = d.day""")
def jn_full_dict_merge(t: Tables) -> DataFrame:
    # the calendar reaches 2 days before the first event and 3 after the last; on the given tables these are the SQL's dates
    days = t.events.agg(F.date_sub(F.to_date(F.min("ts")), 2).alias("first_day"), F.date_add(F.to_date(F.max("ts")), 3).alias("last_day"))
    out = measures.daily_series(t.events, days, "ts", {"requests": F.count("*"), "errors": F.count_if(_error()), "users": F.countDistinct("user_id")})
    return out.withColumn("day", F.col("day").cast("string"))


@query("""SELECT CAST(ts::DATE AS VARCHAR) AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def ag_count_distinct_day(t: Tables) -> DataFrame:
    return t.events.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.countDistinct("user_id").alias("users"))


@query("""SELECT CAST(ts::DATE AS VARCHAR) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def ag_daily_counts(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'purchase'").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, round(sum(value), 4) AS total, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def ag_group_sum_top(t: Tables) -> DataFrame:
    last = t.events.agg(F.max("ts").alias("last"))
    recent = t.events.join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAY"))  # one row
    return recent.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n")).orderBy(F.desc("total"), "user_id").limit(10)


@query("""SELECT count(*) AS requests, round(sum(value) / count(value), 6) AS average, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate, round(count(*) / (count(DISTINCT date_trunc('minute', ts))), 6) AS per_minute FROM events""")
def ag_overview(t: Tables) -> DataFrame:
    return t.events.agg(F.count("*").alias("requests"), ratio(F.sum("value"), F.count("value")).alias("average"), ratio(F.count_if(_error()), F.count("*")).alias("error_rate"), ratio(F.count("*"), F.countDistinct(F.date_trunc("minute", "ts"))).alias("per_minute"))


@query("""SELECT event_type, round(avg(value), 6) AS average, arg_max(value, (ts, event_id)) AS latest FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1""")
def ag_probe_avg_latest(t: Tables) -> DataFrame:
    last = t.events.agg(F.max("ts").alias("last"))
    recent = t.events.join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("INTERVAL 1 DAY"))  # one row
    return recent.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("average"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'error')
SELECT e.user_id, e.n, e.error_rate, coalesce(i.newest, 0) AS newest FROM (SELECT user_id, count(*) AS n, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate FROM events GROUP BY 1) e LEFT JOIN (SELECT user_id, count(*) AS newest FROM r WHERE k <= 10 GROUP BY 1) i ON i.user_id = e.user_id""")
def ag_service_errors(t: Tables) -> DataFrame:
    newest = ordering.first_per_key(t.events.filter(_error()), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).groupBy("user_id").agg(F.count("*").alias("newest"))
    return measures.rates_by(t.events, ["user_id"], {"error_rate": _error()}).join(newest, "user_id", "left").withColumn("newest", F.coalesce("newest", F.lit(0)))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS average, round(count(*) FILTER (WHERE value > 100) / count(*), 6) AS slow_rate FROM events GROUP BY 1""")
def ag_by_mode(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("average"), ratio(F.count_if(F.col("value") > 100), F.count("*")).alias("slow_rate"))


@query("""SELECT coalesce(m, 'unknown') AS model, n FROM (SELECT CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 3 = 0 THEN NULL ELSE 'm' || (CAST(json_extract(props, '$.k') AS INTEGER) % 3) END AS m, count(*) AS n FROM events GROUP BY 1)""")
def ag_tokens_by_model(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    grouped = t.events.groupBy(F.when(k % 3 != 0, F.concat(F.lit("m"), (k % 3).cast("string"))).alias("m")).agg(F.count("*").alias("n"))
    return grouped.select(F.coalesce("m", F.lit("unknown")).alias("model"), "n")


@query("""SELECT CAST(ts::DATE AS VARCHAR) AS day, round(count(*) FILTER (WHERE event_type = 'purchase') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 6) AS rate FROM events GROUP BY 1""")
def ag_support_rate(t: Tables) -> DataFrame:
    return t.events.groupBy(F.to_date("ts").cast("string").alias("day")).agg(ratio(F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "view")).alias("rate"))


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY 1""")
def ag_counts_by_key(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT user_id, coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0) AS pending FROM events GROUP BY 1""")
def ag_pending_sum(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.coalesce(F.sum(F.when(F.col("event_type") == "click", F.col("value"))), F.lit(0.0)).alias("pending"))


@query("""SELECT CAST(ts::DATE AS VARCHAR) AS day, round(sum(value) FILTER (WHERE event_type = 'click'), 4) AS click, round(sum(value) FILTER (WHERE event_type = 'view'), 4) AS "view", round(greatest(0, sum(value) - coalesce(sum(value) FILTER (WHERE event_type IN ('click', 'view')), 0)), 4) AS unattributed FROM events GROUP BY 1""")
def ag_usage_today(t: Tables) -> DataFrame:
    part = lambda *kinds: F.sum(F.when(F.col("event_type").isin(*kinds), F.col("value")))
    return t.events.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(part("click"), 4).alias("click"), F.round(part("view"), 4).alias("view"), F.round(F.greatest(F.lit(0.0), F.sum("value") - F.coalesce(part("click", "view"), F.lit(0.0))), 4).alias("unattributed"))


@query("""SELECT sha256(text) AS fingerprint, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 20""")
def ag_having_dups(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.count("*").alias("n")).filter("n > 1").orderBy("fingerprint").limit(20)


@query("""SELECT conv_id, coalesce(max(turn), 0) + 1 AS next FROM conversations GROUP BY 1""")
def ag_max_seq(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg((F.coalesce(F.max("turn"), F.lit(0)) + 1).alias("next"))


@query("""WITH x AS (SELECT l_orderkey, min(l_shipdate) AS shipped FROM lineitem GROUP BY 1) SELECT o_orderpriority, round(avg(date_diff('second', o_orderdate, shipped)) , 4) AS seconds, count(*) AS n FROM orders JOIN x ON l_orderkey = o_orderkey WHERE shipped > o_orderdate GROUP BY 1""")
def ag_avg_duration(t: Tables) -> DataFrame:
    shipped = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("shipped"))
    took = F.timestamp_diff("SECOND", F.col("o_orderdate"), F.col("shipped"))
    return t.orders.join(shipped, F.col("l_orderkey") == F.col("o_orderkey")).filter("shipped > o_orderdate").groupBy("o_orderpriority").agg(F.round(F.avg(took), 4).alias("seconds"), F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def wn_latest_version(t: Tables) -> DataFrame:
    return ordering.first_per_key(t.orders, ["o_custkey"], [F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def wn_latest_job(t: Tables) -> DataFrame:
    return ordering.first_per_key(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "value")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'""")
def wn_latest_review(t: Tables) -> DataFrame:
    return ordering.first_per_key(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).filter(~_error()).select("user_id", "event_id")


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seq FROM conversations""")
def wn_message_seq(t: Tables) -> DataFrame:
    return ordering.numbered(t.conversations, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], "seq").select("conv_id", "turn", "seq")


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx FROM orders""")
def wn_chunk_index(t: Tables) -> DataFrame:
    return ordering.numbered(t.orders, ["o_custkey"], [F.col("o_orderkey")], "idx", 0).select("o_custkey", "o_orderkey", "idx")


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE k <= 8""")
def wn_recent_n(t: Tables) -> DataFrame:
    newest = ordering.first_per_key(t.conversations.select("conv_id", "turn").distinct(), ["conv_id"], [F.desc("turn")], 8)
    return ordering.numbered(newest, ["conv_id"], [F.col("turn")], "place").select("conv_id", "turn", "place")


@query("""WITH s AS (SELECT conv_id, turn, least(length(text), 480) AS cost, sum(least(length(text), 480)) OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM conversations)
SELECT conv_id, turn, CAST(cost AS BIGINT) AS cost FROM s WHERE upto <= 1800""")
def wn_memory_budget(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("cost", F.least(F.length("text"), F.lit(480)).cast("long"))
    return ordering.while_budget_lasts(rows, ["conv_id"], [F.desc("turn"), F.col("role"), F.col("text")], F.col("cost"), 1800).select("conv_id", "turn", "cost")


@query("""WITH inner_cap AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS b FROM orders), kept AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS a FROM inner_cap WHERE b <= 2) SELECT o_custkey, o_orderkey FROM kept WHERE a <= 3""")
def wn_cap_per_key(t: Tables) -> DataFrame:
    return ordering.capped(t.orders, [(["o_custkey", "o_orderstatus"], 2), (["o_custkey"], 3)], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_orderkey) AS k FROM orders) WHERE k <= 25""")
def wn_stratified(t: Tables) -> DataFrame:
    risk = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(3)
    return ordering.first_per_key(t.orders, ["o_orderstatus"], [risk, F.col("o_orderkey")], 25).select("o_orderstatus", "o_orderkey")


@query("""SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F') WHERE k <= 5""")
def wn_first_n_per_cat(t: Tables) -> DataFrame:
    return ordering.first_per_key(t.orders.filter("o_orderstatus = 'F'"), ["o_orderpriority"], [F.col("o_orderkey")], 5).select("o_orderpriority", "o_orderkey")


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS following FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def wn_neighbors(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("following"))


@query("""SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100""")
def so_page(t: Tables) -> DataFrame:
    return ordering.page(t.events, [F.desc("ts"), F.desc("event_id")], 50, 100).select("event_id", "event_type")


@query("""SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20""")
def so_recent(t: Tables) -> DataFrame:
    return t.events.filter(_error()).orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id")


@query("""SELECT c.c_name, n.n_name, r.r_name, count(*) AS orders, coalesce(max(l.lines), 0) AS lines FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2, 3""")
def jn_inner_left_multi(t: Tables) -> DataFrame:
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("per"))
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left").join(per_order, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.groupBy("c_name", "n_name", "r_name").agg(F.count("*").alias("orders"), F.coalesce(F.max("per"), F.lit(0)).alias("lines"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def jn_semi_subquery(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)""")
def jn_semi_in(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderstatus").isin("F", "P")).join(t.lineitem.filter("l_discount > 0.09"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("""SELECT k AS doc_id, side FROM (SELECT doc_id AS k, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unexpected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) GROUP BY 1, 2""")
def jn_anti_sets(t: Tables) -> DataFrame:
    return sets.differences(t.documents, t.labels, "doc_id")


@query("""SELECT c.c_custkey, coalesce((SELECT o_orderstatus FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 1), 'none') AS status FROM customer c""")
def jn_correlated_latest(t: Tables) -> DataFrame:
    newest = t.orders.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    return t.customer.join(newest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("status", F.lit("none")).alias("status"))


@query("""SELECT o.o_orderkey, coalesce(CASE WHEN x.n > 5 THEN 'L' END, o.o_orderstatus) AS status FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) x ON x.l_orderkey = o.o_orderkey""")
def jn_update_from(t: Tables) -> DataFrame:
    counted = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return t.orders.join(counted, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce(F.when(F.col("n") > 5, "L"), "o_orderstatus").alias("status"))


@query("""SELECT k, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, value FROM events) GROUP BY 1""")
def jn_lateral_json(t: Tables) -> DataFrame:
    parsed = t.events.select(F.explode(F.map_entries(F.from_json("props", "map<string,int>"))).alias("e"), "value").filter("e.key = 'k'")
    return parsed.groupBy(F.col("e.value").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def o_retention(t: Tables) -> DataFrame:
    last = t.events.agg(F.max("ts").alias("last"))
    return t.events.join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAY")).select("event_id")  # one row


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'down' WHEN value > 100 THEN 'degraded' ELSE 'up' END AS status FROM events""")
def o_probe_status(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.when(_error(), "down").when(F.col("value") > 100, "degraded").otherwise("up").alias("status"))


@query("""WITH e AS (SELECT date_trunc('minute', make_timestamp(epoch_us(ts) // 60)) AS m, event_type AS k, value * 40 AS v, user_id % 5 AS service, value FROM events WHERE ts IS NOT NULL), a AS (SELECT DISTINCT m + to_minutes(CAST(d AS INTEGER)) AS as_of FROM e, (SELECT unnest(range(1, 16)) AS d)),
s AS (SELECT as_of, count(*) FILTER (WHERE m >= as_of - INTERVAL 5 MINUTE) AS n, count(*) FILTER (WHERE k = 'error' AND m >= as_of - INTERVAL 5 MINUTE) AS errors, count(*) FILTER (WHERE k = 'purchase') AS timeouts, count(*) FILTER (WHERE k IN ('view', 'click', 'signup')) AS limited, list_sort(list(CASE WHEN v <= 50 THEN 25.0 WHEN v <= 100 THEN 75.0 WHEN v <= 250 THEN 175.0 WHEN v <= 500 THEN 375.0 WHEN v <= 1000 THEN 750.0 WHEN v <= 2000 THEN 1500.0 WHEN v <= 5000 THEN 3500.0 WHEN v <= 15000 THEN 10000.0 ELSE 22500.0 END) FILTER (WHERE v IS NOT NULL AND m >= as_of - INTERVAL 10 MINUTE)) AS l
  FROM a JOIN e ON e.m < as_of AND e.m >= as_of - INTERVAL 15 MINUTE GROUP BY as_of)
SELECT as_of, 'error_rate_high' AS rule, 'critical' AS severity, NULL AS subject FROM s WHERE n > 0 AND errors / n > 0.05 UNION ALL SELECT as_of, 'p95_latency_high', 'warning', NULL FROM s WHERE l[CAST(greatest(1, ceil(len(l) * 0.95)) AS BIGINT)] > 3000 UNION ALL SELECT as_of, 'repeated_timeouts', 'warning', NULL FROM s WHERE timeouts >= 3 UNION ALL SELECT as_of, 'rate_limit_spike', 'warning', NULL FROM s WHERE limited >= 20
UNION ALL SELECT DISTINCT as_of, 'service_down', 'critical', CAST(service AS VARCHAR) FROM a JOIN e ON e.m < as_of AND e.m >= as_of - INTERVAL 10 MINUTE WHERE k = 'signup' AND value > 80""")
def o_alert_rules(t: Tables) -> DataFrame:
    """Events as requests, sixty times as fast; purchases stand for timeouts, most others for limited requests, signups for probes."""
    rows = t.events.withColumn("at", F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60)))
    kind = F.col("event_type")
    probes = rows.filter(kind == "signup").select(F.col("at").alias("time"), (F.col("user_id") % 5).alias("service"), F.when(F.col("value") > 80, "down").otherwise("up").alias("status"))
    found = alerts.active_alerts(rows, "at", _error(), F.col("value") * 40, kind == "purchase", kind.isin("view", "click", "signup"), probes)
    return found.withColumn("as_of", F.col("as_of").cast("timestamp_ntz"))


@query("""SELECT user_id, CAST(ts::DATE AS VARCHAR) AS day, CAST(sum(value) AS DOUBLE) AS used, greatest(0, 500 - sum(value)) AS remaining FROM events GROUP BY 1, 2""")
def o_quota_snapshot(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.sum("value").alias("used"), F.greatest(F.lit(0.0), 500 - F.sum("value")).alias("remaining"))


@query("""SELECT c_custkey, round(c_acctbal * least(greatest(c_custkey % 20, 0), 12) / 12, 6) AS allowance FROM customer WHERE c_acctbal > 0""")
def o_calc_thr(t: Tables) -> DataFrame:
    return t.customer.filter("c_acctbal > 0").select("c_custkey", F.round(F.col("c_acctbal") * clamp(F.col("c_custkey") % 20, 0, 12) / 12, 6).alias("allowance"))


@query("""SELECT c_custkey, CAST(least(floor((c_custkey % 137) / 10.0) + 1, 9) AS INTEGER) AS multiplier, round(c_acctbal * least(floor((c_custkey % 137) / 10.0) + 1, 9), 2) AS severance FROM customer WHERE c_acctbal > 0""")
def o_calc_severance(t: Tables) -> DataFrame:
    times = F.least(F.floor((F.col("c_custkey") % 137) / 10) + 1, F.lit(9)).cast("int")
    return t.customer.filter("c_acctbal > 0").select("c_custkey", times.alias("multiplier"), F.round(F.col("c_acctbal") * times, 2).alias("severance"))


@query("""SELECT conv_id, count(*) AS messages, max(turn) AS last FROM conversations GROUP BY 1""")
def o_conv_list(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS roles FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1""")
def o_roles(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("roles"))


@query("""SELECT o_orderkey, CASE WHEN o_orderdate IS NULL THEN 'due' WHEN date_diff('day', o_orderdate, m) <= 90 THEN 'fresh' WHEN date_diff('day', o_orderdate, m) <= 180 THEN 'due' ELSE 'stale' END AS freshness FROM orders, (SELECT max(o_orderdate) AS m FROM orders)""")
def tx_freshness(t: Tables) -> DataFrame:
    last = t.orders.agg(F.max("o_orderdate").alias("m"))
    age = F.datediff("m", "o_orderdate")
    return t.orders.join(F.broadcast(last)).select("o_orderkey", F.when(F.col("o_orderdate").isNull(), "due").when(age <= 90, "fresh").when(age <= 180, "due").otherwise("stale").alias("freshness"))  # one row


@query("""SELECT event_type, n, round(sum(n) OVER (ORDER BY n DESC, event_type ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def ui_running_share(t: Tables) -> DataFrame:
    n = t.events.groupBy("event_type").agg(F.count("*").alias("n"))  # a row for each type
    return n.select("event_type", "n", F.round(F.sum("n").over(Window.orderBy(F.desc("n"), "event_type").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("""SELECT event_type, CAST(ts::DATE AS VARCHAR) AS day, n, CASE WHEN h > l THEN round((n - l) / (h - l), 6) ELSE 1.0 END AS scaled FROM (SELECT *, min(n) OVER (PARTITION BY event_type) AS l, max(n) OVER (PARTITION BY event_type) AS h FROM (SELECT event_type, ts::DATE AS ts, count(*) AS n FROM events GROUP BY 1, 2))""")
def ui_minmax_scale(t: Tables) -> DataFrame:
    n = t.events.groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type")
    low, high = F.min("n").over(w), F.max("n").over(w)
    return n.select("event_type", "day", "n", F.when(high > low, F.round((F.col("n") - low) / (high - low), 6)).otherwise(F.lit(1.0)).alias("scaled"))
