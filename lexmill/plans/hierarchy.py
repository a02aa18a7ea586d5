"""Queries on trees: nodes that name their parents, and spans that lie in each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import trees

from .registry import Tables, query

#: Each document hangs below the one of half its id; some name a later one instead, so that chains get lost or run in circles.
_NODES = """n AS (SELECT doc_id AS node, CASE WHEN doc_id = 0 THEN NULL WHEN doc_id % 41 = 5 THEN doc_id * 3 + 1 WHEN doc_id % 37 = 4 THEN doc_id * 2 + 1 ELSE doc_id // 2 END AS parent FROM documents)"""
_WALK = f"""{_NODES}, walk AS (SELECT node, node AS here, parent AS up, 0 AS depth, [node] AS path FROM n UNION ALL
  SELECT w.node, n.node, n.parent, w.depth + 1, list_append(w.path, n.node) FROM walk w JOIN n ON n.node = w.up WHERE NOT list_contains(w.path, w.up)),
ended AS (SELECT node, here, up, depth, path, CASE WHEN up IS NULL THEN 'rooted' WHEN list_contains(path, up) THEN 'cycle' ELSE 'orphan' END AS state FROM walk WHERE up IS NULL OR list_contains(path, up) OR up NOT IN (SELECT node FROM n))"""


def nodes(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    up = F.when(d == 0, None).when(d % 41 == 5, d * 3 + 1).when(d % 37 == 4, d * 2 + 1).otherwise(F.floor(d / 2))
    return t.documents.select(d.alias("node"), up.cast("long").alias("parent"))


@query(f"WITH RECURSIVE {_WALK} SELECT node, CASE WHEN state <> 'cycle' THEN here END AS root, CASE WHEN state <> 'cycle' THEN CAST(depth AS BIGINT) END AS depth, state FROM ended")
def jn_tree_parent(t: Tables) -> DataFrame:
    return trees.chains(nodes(t))


@query(f"WITH RECURSIVE {_WALK} SELECT node, unnest(path[2:]) AS ancestor, CAST(unnest(range(1, len(path))) AS BIGINT) AS distance FROM ended WHERE state <> 'cycle'")
def jn_tree_ancestors(t: Tables) -> DataFrame:
    return trees.ancestors(nodes(t))


#: Events as starts and ends of spans, a trace for each user and day.
_MARKS = """m AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS trace, event_id, ts, event_type AS name, event_type NOT IN ('purchase', 'error') AS o FROM events)"""
_SPANS = f"""{_MARKS}, s AS (SELECT *, sum(CASE WHEN o THEN 1 ELSE -1 END) OVER (PARTITION BY trace ORDER BY event_id) AS s FROM m),
f AS (SELECT *, least(0, min(s) OVER (PARTITION BY trace ORDER BY event_id)) AS floor, least(0, coalesce(min(s) OVER (PARTITION BY trace ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM s),
l AS (SELECT trace, event_id, ts, name, o, CAST(s - floor AS BIGINT) AS level, row_number() OVER (PARTITION BY trace, o ORDER BY event_id) AS span FROM f WHERE o OR floor = before),
p AS (SELECT a.trace, a.span, a.name, a.level, a.event_id AS begin, a.ts, (SELECT arg_max(b.span, b.event_id) FROM l b WHERE b.trace = a.trace AND b.o AND b.level = a.level - 1 AND b.event_id < a.event_id) AS parent,
  (SELECT min(b.event_id) FROM l b WHERE b.trace = a.trace AND NOT b.o AND b.level = a.level - 1 AND b.event_id > a.event_id) AS "end" FROM l a WHERE a.o)"""


def _spans(t: Tables) -> DataFrame:
    trace = F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd"))
    marks = t.events.select(trace.alias("trace"), "event_id", ~F.col("event_type").isin("purchase", "error"), "event_type").toDF("trace", "event_id", "o", "name")
    return trees.spans(marks, "trace", "event_id", "o", "name")


@query(f"""WITH {_SPANS} SELECT trace, span, name, level, "begin", parent, "end" FROM p""")
def ui_span_tree(t: Tables) -> DataFrame:
    return _spans(t).withColumn("level", F.col("level").cast("long"))


@query(f"""WITH {_SPANS}, e AS (SELECT trace, min(ts) AS first, max(ts) AS last, bool_or(name = 'error') AS failed FROM m GROUP BY 1), k AS (SELECT trace, count(*) AS spans, max(level) AS deepest, count(*) FILTER (WHERE "end" IS NULL) AS aborted FROM p GROUP BY 1)
SELECT e.trace, coalesce(spans, 0) AS spans, coalesce(deepest, 0) AS deepest, coalesce(aborted, 0) AS aborted, CASE WHEN failed THEN 'error' ELSE 'ok' END AS status, (epoch_us(last) - epoch_us(first)) // 1000 AS duration_ms,
  failed OR (epoch_us(last) - epoch_us(first)) // 1000 >= 43200000 OR CAST('0x' || substr(md5(e.trace), 1, 8) AS BIGINT) % 100 < 5 AS persisted FROM e LEFT JOIN k ON k.trace = e.trace""")
def o_trace(t: Tables) -> DataFrame:
    """What is kept of a trace: failed and slow ones (half a day here), and one in twenty by its id."""
    trace = F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("trace")
    whole = t.events.groupBy(trace).agg(F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000).alias("duration_ms"), F.max(F.col("event_type") == "error").alias("failed"))
    counted = _spans(t).groupBy("trace").agg(F.count("*").alias("spans"), F.max("level").alias("deepest"), F.count_if(F.col("end").isNull()).alias("aborted"))
    return trees.kept_traces(whole.join(counted, "trace", "left").fillna(0, ["spans", "deepest", "aborted"]), "trace", slow_ms=43_200_000, percent=5)
