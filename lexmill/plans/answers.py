"""Queries on questions, claims, evaluation and release, on streams' bucket forms, and on JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import claims as words_of
from lexmill.functions import questions, sentences
from lexmill.operators import claims, evaluation, retrieval, sets
from lexmill.sources import json_lines, shared
from lexmill.sources.shared import stored
from lexmill.streaming import buckets

from .ranking import STATUS
from .registry import SQL, Tables, query
from .retrieval import ECHO, LEXICAL, e_recall, expected_scores
from .structure import sentences_sql

_LOWER = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
for _wrong, _right in questions.TYPOS.items():
    _LOWER = rf"regexp_replace({_LOWER}, '\b{_wrong}\b', '{_right}', 'g')"
ASKED = f"asked AS (SELECT item_id, {_LOWER} AS q FROM benchmark)"


def _named(dictionary: dict[str, str]) -> str:
    listed = ", ".join(f"CASE WHEN {' OR '.join(f'contains(q, {chr(39)}{w}{chr(39)})' for w in words.split('|'))} THEN '{name}' END" for name, words in dictionary.items())
    return f"list_filter([{listed}], lambda x: x IS NOT NULL)"


def _asked(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", questions.normal_question(F.col("text")).alias("q"))


@query(f"WITH {ASKED} SELECT item_id, q FROM asked")
def q_normalize(t: Tables) -> DataFrame:
    return _asked(t)


@query(f"WITH {ASKED} SELECT item_id, array_to_string({_named(questions.TOPICS)}, ',') AS topics, coalesce(nullif(array_to_string({_named(questions.INTENTS)}, ','), ''), 'general_question') AS intents FROM asked")
def q_topics(t: Tables) -> DataFrame:
    return _asked(t).select("item_id", F.array_join(questions.topics(F.col("q")), ",").alias("topics"), F.array_join(questions.intents(F.col("q")), ",").alias("intents"))


@query(f"WITH {ASKED} SELECT item_id, len({_named(questions.TOPICS)}) > 0 OR {' OR '.join(f'contains(q, {chr(39)}{w}{chr(39)})' for w in questions.DOMAIN.split('|'))} AS in_scope FROM asked")
def q_scope(t: Tables) -> DataFrame:
    return _asked(t).select("item_id", questions.in_scope(F.col("q")).alias("in_scope"))


@query()
def q_rewrites(t: Tables) -> DataFrame:
    """Each passage of the benchmark as a question, with its rewrites."""
    return _asked(t).select("item_id", F.posexplode(questions.rewrites(F.col("q"))).alias("place", "rewrite"))


_STOP = ", ".join(f"'{w}'" for w in words_of.STOP)
_WORDS = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({{}}, '')), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))"
_NUMBERS = r"list_distinct(list_transform(regexp_extract_all(coalesce({}, ''), '\b\d+(?:[.,]\d+)?\b'), lambda x: replace(x, ',', '.')))"
CLAIMS = f"""said AS (SELECT conv_id, turn, unnest({sentences_sql("text")}) AS claim, unnest(range(1, 1 + len({sentences_sql("text")}))) AS place FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn * 100000 + place AS claim_id, claim, turn - 1 AS cited, {_WORDS.format("claim")} AS words, {_NUMBERS.format("claim")} AS said FROM said),
e AS (SELECT conv_id, turn AS citation_id, {_WORDS.format("text")} AS has, {_NUMBERS.format("text")} AS known FROM conversations WHERE role = 'user'),
m AS (SELECT c.*, citation_id, CASE WHEN len(words) = 0 THEN 0 ELSE len(list_intersect(words, coalesce(has, []))) / len(words) END AS score, len(list_filter(said, lambda x: NOT list_contains(coalesce(known, []), x))) = 0 AND len(list_filter(words, lambda x: x IN ({", ".join(f"'{w}'" for w in words_of.QUALIFIERS)}) AND NOT list_contains(coalesce(has, []), x))) = 0 AS ok FROM c LEFT JOIN e ON e.conv_id = c.conv_id),
o AS (SELECT conv_id, claim_id, any_value(claim) AS claim, max(score) FILTER (WHERE citation_id = cited) AS own, bool_or(ok) FILTER (WHERE citation_id = cited) AS own_ok, max(CASE WHEN citation_id = cited THEN cited END) AS cited, max(score) FILTER (WHERE ok AND score >= 0.65 AND citation_id IS NOT NULL) AS best, arg_max(citation_id, score * 1000000 - citation_id / 1000.0) FILTER (WHERE ok AND score >= 0.65 AND citation_id IS NOT NULL) AS best_id FROM m GROUP BY 1, 2),
v AS (SELECT *, coalesce(own_ok AND own >= 0.35, false) AS stands, NOT coalesce(own_ok AND own >= 0.35, false) AND coalesce(best > coalesce(own, 0), false) AS moved FROM o),
claims AS (SELECT conv_id, claim_id, claim, CASE WHEN moved THEN best_id ELSE cited END AS cited, moved, stands OR moved AS supported, round(CASE WHEN moved THEN best ELSE coalesce(own, 0) END, 4) AS support_score FROM v)"""


def _claims(t: Tables) -> DataFrame:
    said = t.conversations.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(sentences.sentences(F.col("text"))).alias("k", "claim"))
    said = said.select("conv_id", (F.col("turn") * 100000 + F.col("k") + 1).alias("claim_id"), "claim", (F.col("turn") - 1).alias("cited"))
    shown = t.conversations.filter("role = 'user'").select("conv_id", F.col("turn").alias("citation_id"), F.col("text").alias("quote"))
    return claims.verified(said, shown, ["conv_id"])


@query(f"WITH {CLAIMS} SELECT * FROM claims")
def g_claims(t: Tables) -> DataFrame:
    """Sentences of the assistant's turns as claims, the user's turns as passages, the turn before as the cited one."""
    return _claims(t)


@query(f"WITH {CLAIMS} SELECT conv_id, count(*) AS claims, round(avg(CASE WHEN supported THEN support_score ELSE 0 END), 6) AS faithfulness, round(avg(CASE WHEN supported THEN 0.0 ELSE 1.0 END), 6) AS unsupported_rate FROM claims GROUP BY 1")
def e_faithful(t: Tables) -> DataFrame:
    return claims.faithfulness(_claims(t), ["conv_id"])


@query(f"WITH a AS (SELECT conv_id, turn, list_distinct({_WORDS.format('text')}) AS w FROM conversations WHERE role = 'assistant'), c AS (SELECT conv_id, list_distinct(flatten(list({_WORDS.format('text')}))) AS w FROM conversations WHERE role = 'user' GROUP BY 1) SELECT a.conv_id, turn, CASE WHEN len(a.w) = 0 THEN 0 ELSE round(len(list_intersect(a.w, coalesce(c.w, []))) / len(a.w), 4) END AS coverage FROM a LEFT JOIN c ON c.conv_id = a.conv_id")
def g_coverage(t: Tables) -> DataFrame:
    """The assistant's turns as answers, all turns of the user as claims on each."""
    answers = t.conversations.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    said = t.conversations.filter("role = 'user'").select("conv_id", F.col("text").alias("claim"))
    return claims.coverage(answers, answers.select("conv_id", "turn").join(said, "conv_id"), ["conv_id", "turn"])


@query(f"WITH p AS (SELECT conv_id, turn, role, {_WORDS.format('text')} AS a, lag({_WORDS.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(coalesce(b, [])) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS overlap FROM p WHERE role = 'assistant'")
def e_answer_jaccard(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    said = t.conversations.withColumn("a", words_of.content_words(F.col("text"))).withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("role = 'assistant'")
    share = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    return said.select("conv_id", "turn", F.when((F.size("a") == 0) | F.col("b").isNull() | (F.size("b") == 0), 0.0).otherwise(F.round(share, 6)).alias("overlap"))


MEASURES = ("recall", "precision", "hit", "reciprocal_rank", "ndcg")
#: The least of each measure that a release needs; a measure that nobody took fails.
GATES = {"recall_at_5": 0.90, "recall_at_10": 0.95, "citation_precision": 0.95, "refusal_recall": 0.95, "refusal_precision": 0.90, "language_accuracy": 0.99}
_ANSWERED = f"({SQL['e_recall']})"
AGGREGATE = f"""agg AS (SELECT (SELECT count(*) FROM benchmark) AS question_count, count(*) AS answerable_count, (SELECT count(*) FROM benchmark) - count(*) AS refusal_count, {", ".join(f'coalesce(round(avg("{m}"), 6), 0.0) AS mean_{m}' for m in MEASURES)} FROM {_ANSWERED} r)"""


def _aggregate(t: Tables) -> DataFrame:
    means = e_recall(t).agg(F.count("*").alias("answerable_count"), *[F.coalesce(F.round(F.avg(m), 6), F.lit(0.0)).alias(f"mean_{m}") for m in MEASURES])
    asked = t.benchmark.agg(F.count("*").alias("question_count"))
    return asked.join(means).select("question_count", "answerable_count", (F.col("question_count") - F.col("answerable_count")).alias("refusal_count"), *[f"mean_{m}" for m in MEASURES])  # one row with one row


#: The best lexical score that a question needs to be answered, and which questions count as hard ones.
ANSWERED_FROM, HARD = 0.01, 5
_SPACED = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


def _said_in(column: str) -> str:
    hits = lambda known: f"len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce({column}, '')), '[a-z]+')), [{', '.join(f'{chr(39)}{w}{chr(39)}' for w in known)}]))"
    more = f"{hits(questions.INDONESIAN)} - {hits(questions.ENGLISH)}"
    return f"CASE WHEN {more} > 0 THEN 'id' WHEN {more} < 0 THEN 'en' WHEN regexp_matches({column}, '[^\\x00-\\x7F]') THEN 'id' ELSE 'en' END"


RESULTS = rf"""{LEXICAL}, {ECHO}, r5 AS {_ANSWERED},
ranked AS (SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM lex WHERE score > 0),
wants AS (SELECT query_id, count(*) AS wanted FROM echo GROUP BY 1), hit10 AS (SELECT x.query_id, count(*) AS hits, sum(1 / log2(rank + 1.0)) AS gain FROM ranked x JOIN echo e ON e.query_id = x.query_id AND e.doc_id = x.doc_id WHERE rank <= 10 GROUP BY 1),
r10 AS (SELECT x.query_id, round(coalesce(hits, 0) / wanted, 6) AS recall_at_10, round(coalesce(gain, 0) / list_sum(list_transform(range(1, CAST(least(wanted, 10) AS BIGINT) + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg_at_10 FROM wants x LEFT JOIN hit10 y ON y.query_id = x.query_id),
sel AS (SELECT x.query_id, x.doc_id, rank, score, d.text, d.source, {STATUS} <> 'current' AS stale, e.doc_id IS NOT NULL AS relevant, d.source = 'src1' AS exact FROM ranked x JOIN documents d ON d.doc_id = x.doc_id LEFT JOIN labels l ON l.doc_id = x.doc_id LEFT JOIN echo e ON e.query_id = x.query_id AND e.doc_id = x.doc_id WHERE rank <= 10),
tops AS (SELECT query_id, max(score) AS best, count(*) AS n_selected, count(*) FILTER (WHERE stale) AS n_stale FROM sel GROUP BY 1),
c1 AS (SELECT sel.*, min(rank) OVER (PARTITION BY sel.query_id, source) AS first FROM sel JOIN tops ON tops.query_id = sel.query_id WHERE best >= {ANSWERED_FROM} AND rank <= 8), c2 AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS place FROM c1), c3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS c FROM c2 WHERE place <= 2),
c4 AS (SELECT *, substr({_SPACED}, 1, 800) AS quote FROM c3 WHERE c <= 4), c5 AS (SELECT *, trim(quote) AS line, substr(trim(quote), 1, 217) AS head, regexp_extract(substr(trim(quote), 1, 217), '(?s)^(.*[.!?]\s)', 1) AS ended FROM c4),
cited AS (SELECT *, CASE WHEN length(line) <= 220 THEN line ELSE rtrim(CASE WHEN length(ended) > 73 THEN ended ELSE head END) || '...' END AS claim FROM c5),
cl AS (SELECT query_id, rank, {_WORDS.format("claim")} AS words, {_NUMBERS.format("claim")} AS said, {_WORDS.format("quote")} AS has, {_NUMBERS.format("quote")} AS known FROM cited),
met AS (SELECT x.query_id, x.rank, y.rank AS other, CASE WHEN len(x.words) = 0 THEN 0 ELSE len(list_intersect(x.words, y.has)) / len(x.words) END AS score, len(list_filter(x.said, lambda i: NOT list_contains(y.known, i))) = 0 AND len(list_filter(x.words, lambda i: i IN ({", ".join(f"'{w}'" for w in words_of.QUALIFIERS)}) AND NOT list_contains(y.has, i))) = 0 AS ok FROM cl x JOIN cl y ON y.query_id = x.query_id),
owned AS (SELECT query_id, rank, max(score) FILTER (WHERE other = rank) AS own, bool_or(ok) FILTER (WHERE other = rank) AS own_ok, max(score) FILTER (WHERE ok AND score >= 0.65) AS best FROM met GROUP BY 1, 2),
judged AS (SELECT *, own_ok AND own >= 0.35 AS stands, NOT (own_ok AND own >= 0.35) AND coalesce(best > own, false) AS moved FROM owned),
held AS (SELECT query_id, round(avg(CASE WHEN moved THEN round(best, 4) WHEN stands THEN round(own, 4) ELSE 0 END), 6) AS faithfulness, round(avg(CASE WHEN stands OR moved THEN 0.0 ELSE 1.0 END), 6) AS unsupported_claim_rate FROM judged GROUP BY 1),
made AS (SELECT query_id, string_agg(regexp_replace(claim, '[ .]+$', '') || '.', ' ' ORDER BY rank) AS answer, arg_min(doc_id, rank) AS top, round(avg(CASE WHEN NOT relevant THEN 0.0 WHEN exact THEN 1.0 ELSE 0.5 END), 6) AS citation_correctness FROM cited GROUP BY 1),
said AS (SELECT *, {_WORDS.format("answer")} AS mine FROM made),
joined AS (SELECT b.item_id % {HARD} = 0 AS hard, r5.query_id IS NOT NULL AS answerable, coalesce(best < {ANSWERED_FROM}, true) AS refused, coalesce(best, 0.0) AS best, coalesce(n_selected, 0) AS n_selected, coalesce(n_stale, 0) AS n_stale, r5.* EXCLUDE (query_id), r10.* EXCLUDE (query_id), made.citation_correctness AS cc, held.faithfulness AS ff, held.unsupported_claim_rate AS uu, mine, {_WORDS.format("b.text")} AS own, list_cosine_similarity(CAST(eg.embedding AS DOUBLE[]), CAST(ew.embedding AS DOUBLE[])) AS sim, {_said_in("b.text")} = {_said_in("made.answer")} AS same
  FROM benchmark b LEFT JOIN r5 ON r5.query_id = b.item_id LEFT JOIN r10 ON r10.query_id = b.item_id LEFT JOIN tops ON tops.query_id = b.item_id LEFT JOIN made ON made.query_id = b.item_id LEFT JOIN said ON said.query_id = b.item_id LEFT JOIN held ON held.query_id = b.item_id LEFT JOIN embeddings ew ON ew.vec_id = b.item_id LEFT JOIN embeddings eg ON eg.vec_id = made.top),
results AS (SELECT *, CASE WHEN answerable THEN coalesce(cc, 0) END AS citation_correctness, CASE WHEN answerable THEN coalesce(ff, 0) END AS faithfulness, CASE WHEN answerable THEN coalesce(uu, 0) END AS unsupported_claim_rate, CASE WHEN answerable THEN CASE WHEN len(mine) > 0 AND len(own) > 0 THEN round(len(list_intersect(mine, own)) / len(list_distinct(list_concat(mine, own))), 6) ELSE 0 END END AS answer_correctness,
  CASE WHEN answerable AND NOT refused AND sim IS NOT NULL THEN round(greatest(0.0, least(1.0, sim)), 6) END AS answer_similarity, refused OR same AS language_correct FROM joined),
tried AS (SELECT DISTINCT best AS t FROM results UNION SELECT 0.0 UNION SELECT 1.0), told AS (SELECT t, (SELECT count(*) FROM results WHERE (best < t) = (NOT answerable)) AS correct FROM tried)"""
_MEAN = "coalesce(round(avg({0}), 6), 0.0) AS {1}"
_RATIO = "coalesce(round(count(*) FILTER (WHERE {0}) / nullif(count(*) FILTER (WHERE {1}), 0), 6), 0.0) AS {2}"


@query(f"""WITH {RESULTS} SELECT count(*) AS question_count, count(*) FILTER (WHERE answerable) AS answerable_count, count(*) FILTER (WHERE NOT answerable) AS refusal_count, {", ".join(_MEAN.format(f'"{m}"', f"mean_{m}") for m in MEASURES)}, {", ".join(_MEAN.format(m, m) for m in ("recall_at_10", "ndcg_at_10", "citation_correctness", "faithfulness", "unsupported_claim_rate", "answer_correctness", "answer_similarity"))}, {_MEAN.format("citation_correctness", "citation_precision")}, CAST(0.0 AS DOUBLE) AS ragas_faithfulness, {_MEAN.format("CASE WHEN hard THEN recall END", "hard_negative_recall_at_5")}, coalesce(round(sum(n_stale) / greatest(1, sum(n_selected)), 6), 0.0) AS stale_source_rate, {_RATIO.format("language_correct", "true", "language_accuracy")}, {_RATIO.format("refused <> answerable", "true", "refusal_accuracy")}, {_RATIO.format("refused AND NOT answerable", "refused", "refusal_precision")}, {_RATIO.format("NOT refused AND answerable", "NOT answerable", "refusal_recall")}, {_RATIO.format("refused AND NOT answerable", "NOT answerable", "correct_refusal_recall")}, (SELECT round(CAST(t AS DOUBLE), 6) FROM told ORDER BY correct DESC, t DESC LIMIT 1) AS recommended_refusal_threshold FROM results""")
def e_aggregate(t: Tables) -> DataFrame:
    """All measures of the reference. A question's own passage stands for the answer that it expects, documents that share eight
    words with it for those that it expects, sources for documents; questions without such a document should be refused."""
    truth, scores = expected_scores(t)
    ranks = stored(retrieval.relevant_ranks(scores, F.col("relevant"), 10), "ranks")
    later = retrieval.ranking_metrics(ranks, truth, 10).select("query_id", F.col("recall").alias("recall_at_10"), F.col("ndcg").alias("ndcg_at_10"))
    first = stored(retrieval.top_k(scores, F.col("score"), "doc_id", 10), "first")
    chosen = stored(first.select("doc_id").distinct(), "chosen")
    texts, labels = (df.join(chosen, "doc_id", "left_semi") for df in (t.documents.select("doc_id", "text", "source"), t.labels))
    stale = F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))
    selected = stored(first.join(texts, "doc_id").join(labels, "doc_id", "left").select("query_id", "doc_id", "rank", "score", "relevant", "text", "source", stale.alias("stale"), (F.col("source") == "src1").alias("exact")), "selected")
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.col("text").alias("expected"), (F.col("item_id") % HARD == 0).alias("hard"))
    return evaluation.aggregated(stored(evaluation.question_results(asked, retrieval.ranking_metrics(ranks, truth, 5).join(later, "query_id"), selected, t.embeddings, ANSWERED_FROM), "results"))


@query(f"WITH {AGGREGATE}, g AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, CAST({v} AS DOUBLE))' for k, v in GATES.items())}) x(gate, threshold)) SELECT gate, threshold, CASE gate WHEN 'recall_at_5' THEN mean_recall WHEN 'citation_precision' THEN mean_precision END AS actual, coalesce(CASE gate WHEN 'recall_at_5' THEN mean_recall WHEN 'citation_precision' THEN mean_precision END >= threshold, false) AS passed FROM agg, g")
def e_gates(t: Tables) -> DataFrame:
    """Six gates; of the measures only recall and precision are taken here, so the others fail."""
    actual = {"recall_at_5": F.col("mean_recall"), "citation_precision": F.col("mean_precision")}
    listed = F.array(*[F.struct(F.lit(k).alias("gate"), F.lit(v).alias("threshold"), actual.get(k, F.lit(None).cast("double")).alias("actual")) for k, v in GATES.items()])
    return _aggregate(t).select(F.explode(listed).alias("x")).select("x.*", F.coalesce(F.col("x.actual") >= F.col("x.threshold"), F.lit(False)).alias("passed"))


@query(f"""WITH {AGGREGATE}, f AS (SELECT count(*) FILTER (WHERE hit = 0) AS failed FROM {_ANSWERED} r) SELECT CASE WHEN answerable_count = 0 THEN 'needs_review' WHEN failed > 0 OR mean_recall < 0.7 OR mean_reciprocal_rank < 0.5 THEN 'no_go' ELSE 'go' END AS release, failed AS failed_probes, CASE WHEN answerable_count = 0 THEN 'no validation evidence at all' ELSE concat_ws(',', CASE WHEN failed > 0 THEN 'probes' END, CASE WHEN mean_recall < 0.7 THEN 'recall_at_k' END, CASE WHEN mean_reciprocal_rank < 0.5 THEN 'mrr' END) END AS reasons FROM agg, f""")
def e_release(t: Tables) -> DataFrame:
    """go, no_go or needs_review, with reasons: answerable questions are probes, those without a hit fail."""
    seen = e_recall(t).agg(F.count("*").alias("n"), F.count_if(F.col("hit") == 0).alias("failed"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))
    reasons = F.concat_ws(",", F.when(F.col("failed") > 0, "probes"), F.when(F.col("recall") < 0.7, "recall_at_k"), F.when(F.col("mrr") < 0.5, "mrr"))
    none = F.col("n") == 0
    return seen.select(F.when(none, "needs_review").when(reasons != "", "no_go").otherwise("go").alias("release"), F.col("failed").alias("failed_probes"), F.when(none, "no validation evidence at all").otherwise(reasons).alias("reasons"))


_LE = ", ".join(f"count(*) FILTER (WHERE value <= {b}{f' AND value > {a}' if a else ''}) AS le_{b}" for a, b in zip((0, 50, 100, 250, 500, 1000, 2000, 5000), (50, 100, 250, 500, 1000, 2000, 5000, 15000), strict=True))


@query(f"SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS bucket, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(value), 4) AS latency_sum, max(value) AS latency_max, {_LE}, count(*) FILTER (WHERE value > 15000 OR value IS NULL) AS le_inf FROM events WHERE ts IS NOT NULL GROUP BY 1")
def ss_minute_buckets(t: Tables) -> DataFrame:
    out = buckets.minute_buckets(t.events, "ts", F.col("event_type") == "error", F.col("value"))
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")).withColumn("latency_sum", F.round("latency_sum", 4))


@query("WITH m AS (SELECT date_trunc('minute', ts) AS m, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e FROM events WHERE ts IS NOT NULL GROUP BY 1), s AS (SELECT CAST(m AS TIMESTAMP) + to_minutes(k) AS until, n, e FROM m, range(1, 16) r(k)) SELECT until, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(e) AS BIGINT) AS errors, round(sum(e) / sum(n), 6) AS error_rate FROM s GROUP BY 1")
def ss_trailing(t: Tables) -> DataFrame:
    return buckets.trailing(t.events, "ts", F.col("event_type") == "error", 15).withColumn("until", F.col("until").cast("timestamp_ntz"))


@query("SELECT doc_id, text, lang FROM documents")
def src_jsonl(t: Tables) -> DataFrame:
    """Documents written as JSON lines and read back."""
    rows = t.documents.select("doc_id", "text", "lang")
    path = shared.scratch(rows.sparkSession, "jsonl")
    rows.write.option("ignoreNullFields", "false").json(path)
    return json_lines.read_json_lines(rows.sparkSession, path, rows.schema)


@query("SELECT 'empty_text' AS finding, doc_id FROM documents WHERE text IS NULL OR trim(text) = '' UNION ALL SELECT 'repeated_key', doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1 AND doc_id IS NOT NULL UNION ALL SELECT 'missing_key', doc_id FROM documents WHERE doc_id IS NULL")
def sink_export_jsonl(t: Tables) -> DataFrame:
    """What forbids the export of the documents."""
    return json_lines.findings(t.documents, "doc_id", "text")


@query("SELECT doc_id, l.quality, l.doc_id IS NOT NULL AS written FROM documents d LEFT JOIN labels l USING (doc_id)")
def sink_upsert(t: Tables) -> DataFrame:
    """Rows without a quality for all documents, overwritten by the labels that are there."""
    old = t.documents.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(False).alias("written"))
    new = t.labels.join(t.documents.select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality", F.lit(True).alias("written"))
    return sets.union_override(old, new, ["doc_id"])
