"""Queries on remembered requests and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import turns
from lexmill.streaming import keyed

from .registry import Tables, query


@query(r"""WITH RECURSIVE r AS (SELECT CAST(user_id AS VARCHAR) AS identity, CASE WHEN event_id % 11 = 0 THEN 'bad key' ELSE 'request-' || (event_id % 7) END AS request_key, ts AS tm, CASE WHEN event_type <> 'error' THEN CAST(event_id AS VARCHAR) END AS response FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY identity, request_key ORDER BY tm, response NULLS FIRST) AS i FROM r WHERE regexp_matches(request_key, '^[A-Za-z0-9_\-]{8,64}$')),
w AS (SELECT identity, request_key, i, tm, 'fresh' AS disposition, response, CASE WHEN response IS NOT NULL THEN tm END AS held_at, response AS held FROM o WHERE i = 1 UNION ALL
  SELECT o.identity, o.request_key, o.i, o.tm, CASE WHEN o.tm - w.held_at <= INTERVAL 24 HOUR THEN 'replayed' ELSE 'fresh' END, CASE WHEN o.tm - w.held_at <= INTERVAL 24 HOUR THEN w.held ELSE o.response END,
    CASE WHEN o.tm - w.held_at <= INTERVAL 24 HOUR THEN w.held_at WHEN o.response IS NOT NULL THEN o.tm END, CASE WHEN o.tm - w.held_at <= INTERVAL 24 HOUR THEN w.held ELSE o.response END
  FROM w JOIN o ON o.identity = w.identity AND o.request_key = w.request_key AND o.i = w.i + 1)
SELECT identity, request_key, tm AS "at", disposition, response FROM w UNION ALL SELECT identity, request_key, tm, 'rejected', NULL FROM r WHERE NOT regexp_matches(request_key, '^[A-Za-z0-9_\-]{8,64}$')""")
def ss_replays(t: Tables) -> DataFrame:
    """Events as requests; errors are responses that nobody remembers."""
    e = F.col("event_id")
    rows = t.events.select("user_id", F.when(e % 11 == 0, F.lit("bad key")).otherwise(F.concat(F.lit("request-"), e % 7)).alias("k"), "ts", F.when(F.col("event_type") != "error", e.cast("string")).alias("x"))
    return keyed.replayed(rows, "user_id", "k", "ts", "x").withColumn("at", F.col("at").cast("timestamp_ntz"))


_PAIRS = """s AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lag(role) OVER w AS r, lag(turn) OVER w AS asked, lag(coalesce(text, '')) OVER w AS q FROM conversations WHERE role IN ('user', 'assistant') AND conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, asked AS question_at, turn AS answer_at, q AS question, text AS answer FROM s WHERE role = 'assistant' AND r = 'user')"""


@query(f"WITH {_PAIRS} SELECT conv_id, question_at, answer_at, md5(question) AS question, md5(answer) AS answer FROM p")
def ss_turn_pairs(t: Tables) -> DataFrame:
    return turns.turn_pairs(t.conversations, "conv_id", "turn").withColumn("question", F.md5("question")).withColumn("answer", F.md5("answer"))


_DIRTY = r"regexp_matches({0}, '[\w.+-]+@[\w-]+(\.[\w-]+)+') OR regexp_matches({0}, '(^|\D)\d{{16}}(\D|$)') OR regexp_matches({0}, '(^|[^\p{{L}}\p{{N}}_])(\+62|62|0)[\s.-]?(\d[\s.-]?){{8,13}}\d($|[^\p{{L}}\p{{N}}_])') OR regexp_matches({0}, '(?i)\b(bearer|api[ _-]?key|access[ _-]?token|refresh[ _-]?token|token)\s*[:=]?\s*([A-Za-z0-9._~+/=-]{{8,}})')"


@query(rf"""WITH {_PAIRS}, c AS (SELECT conv_id, answer_at, regexp_replace(question, '^\s+|\s+$', '', 'g') AS q, regexp_replace(answer, '^\s+|\s+$', '', 'g') AS a FROM p), f AS (SELECT * FROM c WHERE q <> '' AND a <> '' AND length(a) >= 40 AND NOT ({_DIRTY.format("q")}) AND NOT ({_DIRTY.format("a")})),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY answer_at DESC) AS back FROM f) SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY answer_at) AS INTEGER) AS place, md5(q) AS question, md5(a) AS answer FROM n WHERE back <= 2""")
def g_history(t: Tables) -> DataFrame:
    """Answers of fewer than 40 characters count as not cited."""
    pairs = turns.turn_pairs(t.conversations, "conv_id", "turn")
    return turns.history(pairs, "conv_id", cited=F.length(F.regexp_replace("answer", r"(?U)^\s+|\s+$", "")) >= 40).withColumn("question", F.md5("question")).withColumn("answer", F.md5("answer"))


@query(rf"""WITH {_PAIRS}, f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY answer_at DESC) AS back FROM p WHERE length(answer) >= 40), k AS (SELECT * FROM f WHERE back <= 8) SELECT conv_id, count(*) AS turns, max(answer_at) AS upto, string_agg('m' || question_at || ':' || 'a' || (question_at % 3), ';' ORDER BY answer_at) AS digest FROM k GROUP BY 1""")
def g_summary(t: Tables) -> DataFrame:
    """Conversations in at most eight turns; answers of 40 characters or more cite one document."""
    pairs = turns.turn_pairs(t.conversations, "conv_id", "turn")
    cited = F.when(F.length("answer") >= 40, F.array(F.struct(F.concat(F.lit("a"), F.col("question_at") % 3).alias("document_id"), F.lit("").alias("article"), F.lit(None).cast("string").alias("title"))))
    made = pairs.withColumn("turn", turns.summary_turn(F.col("question"), F.concat(F.lit("m"), "question_at"), cited))
    kept = turns.summaries(made, "conv_id", "answer_at")
    upto = made.filter("turn is not null").groupBy("conv_id").agg(F.max("answer_at").alias("upto"))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["source"], F.lit(":"), F.array_join(x["document_ids"], ","))), ";")
    return kept.join(upto, "conv_id").select("conv_id", F.size("turns").cast("long").alias("turns"), "upto", told.alias("digest"))
