"""Queries of corpus preparation, over documents, pages and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import words
from lexmill.functions.numbers import ratio
from lexmill.functions.words import collapsed, fingerprint, lines, token_count, tokens, word_list
from lexmill.operators import ordering, sets, vectors

from .registry import Tables, query

#: Documents rejoined with their reviews; rows without one are pending.
REVIEWED = "SELECT d.doc_id, d.source, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
COLLAPSED = r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query(f"""SELECT sha256(lower({COLLAPSED})) AS fingerprint, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def st_dedup_exact(t: Tables) -> DataFrame:
    return sets.duplicate_groups(t.documents, fingerprint(F.col("text")), "doc_id")


@query("""WITH g AS (SELECT lang, sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1, 2) SELECT lang, round(sum(n - 1) / sum(n), 6) AS rate FROM g GROUP BY 1""")
def st_dup_scoped(t: Tables) -> DataFrame:
    groups = t.documents.groupBy("lang", F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    return groups.groupBy("lang").agg(ratio(F.sum(F.col("n") - 1), F.sum("n")).alias("rate"))


@query("""WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS e FROM embeddings) SELECT min(vec_id) AS first_id, count(*) AS copies FROM r GROUP BY e HAVING count(*) > 1""")
def st_dup_vectors(t: Tables) -> DataFrame:
    rounded = t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("e"))
    return rounded.groupBy("e").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").drop("e")


@query("""WITH s AS (SELECT DISTINCT CAST(doc_id % 10 AS INTEGER) AS k, CAST(doc_id // 10 + 1 AS INTEGER) AS n FROM labels), m AS (SELECT k, max(n) AS most FROM s GROUP BY 1), a AS (SELECT k, unnest(range(1, most + 1)) AS gap FROM m) SELECT a.k, CAST(a.gap AS INTEGER) AS gap FROM a LEFT JOIN s ON s.k = a.k AND s.n = a.gap WHERE s.n IS NULL""")
def st_minus(t: Tables) -> DataFrame:
    rows = t.labels.select((F.col("doc_id") % 10).cast("int").alias("k"), (F.floor(F.col("doc_id") / 10) + 1).cast("int").alias("n"))
    return sets.integer_gaps(rows, ["k"], "n")


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)) UNION ALL SELECT doc_id, 'reviewed' FROM labels""")
def st_union_override(t: Tables) -> DataFrame:
    return sets.union_override(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", F.lit("reviewed").alias("lang")), ["doc_id"])


@query("""SELECT DISTINCT source FROM documents WHERE lang <> 'en'""")
def st_distinct(t: Tables) -> DataFrame:
    return t.documents.filter("lang <> 'en'").select("source").distinct()


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS published, count(*) FILTER (WHERE quality = 0 OR toxic = 1) AS failed, count(*) FILTER (WHERE quality IS NULL) AS pending FROM (""" + REVIEWED + """) GROUP BY 1""")
def ag_doc_status(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("published"), F.count_if((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("failed"), F.count_if(F.col("quality").isNull()).alias("pending"))


@query("""SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'""")
def flt_hard(t: Tables) -> DataFrame:
    wanted = {"lang": "en", "source": "src1", "doc_id": None}
    kept = t.documents
    for column, value in wanted.items():
        kept = kept if value is None else kept.filter(F.col(column) == value)
    return kept.select("doc_id")


@query("""SELECT doc_id, lang, source FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'license') ORDER BY lang DESC, source DESC, doc_id""")
def flt_documents(t: Tables) -> DataFrame:
    return t.documents.filter(F.lower(F.concat_ws(" ", "source", "lang", "text")).contains("license")).orderBy(F.desc("lang"), F.desc("source"), "doc_id").select("doc_id", "lang", "source")


@query("""SELECT page_id FROM pages WHERE html ILIKE '%nav%' ORDER BY page_id LIMIT 100""")
def flt_logs(t: Tables) -> DataFrame:
    return t.pages.filter(F.col("html").ilike("%nav%")).orderBy("page_id").limit(100).select("page_id")


@query("""SELECT doc_id, octet_length(encode(text)) < 1024 AS small, octet_length(encode(text)) > 52428800 AS large FROM documents""")
def src_limits(t: Tables) -> DataFrame:
    size = F.octet_length("text")
    return t.documents.select("doc_id", (size < 1024).alias("small"), (size > 50 << 20).alias("large"))


@query(f"""SELECT doc_id, {COLLAPSED} AS collapsed FROM documents""")
def tx_collapse(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", collapsed(F.col("text")).alias("collapsed"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS tokens FROM documents""")
def tx_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", token_count(F.col("text")).cast("long").alias("tokens"))


@query(r"""SELECT doc_id, len(list_filter(s, lambda x: len(list_filter(string_split(trim(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' '), lambda w: w <> '')) <= 2)) AS short_lines, CASE WHEN len(s) < 10 THEN 0.0 ELSE round(len(list_filter(s, lambda x: len(list_filter(string_split(trim(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' '), lambda w: w <> '')) <= 2)) / len(s), 6) END AS ratio FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)""")
def tx_fragment_ratio(t: Tables) -> DataFrame:
    short = F.size(F.filter("s", lambda x: F.size(word_list(x)) <= 2))
    return t.documents.select("doc_id", lines(F.col("text")).alias("s")).select("doc_id", short.cast("long").alias("short_lines"), F.when(F.size("s") < 10, 0.0).otherwise(F.round(short / F.size("s"), 6)).alias("ratio"))


@query(rf"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) > 3 AND NOT list_contains([{", ".join(f"'{x}'" for x in words.STOP_WORDS)}], x)) AS terms, list_transform(regexp_extract_all(lower(coalesce(text, '')), '\b\d+(?:[.,]\d+)?\b'), lambda x: replace(x, ',', '.')) AS numbers FROM documents),
u AS (SELECT doc_id, list_transform(list_sort(list_transform(list_distinct(terms), lambda x: list_position(terms, x))), lambda i: terms[i]) AS terms, list_transform(list_sort(list_transform(list_distinct(numbers), lambda x: list_position(numbers, x))), lambda i: numbers[i]) AS numbers FROM w)
SELECT doc_id, array_to_string(list_concat(terms[1:32], list_filter(numbers, lambda x: NOT list_contains(terms[1:32], x))), ' ') AS terms FROM u""")
def tx_key_terms(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(words.key_terms(F.col("text")), " ").alias("terms"))


@query(r"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents), v AS (SELECT doc_id, len(list_intersect(w, ['the', 'and', 'of', 'is', 'to'])) AS en, len(list_intersect(w, ['der', 'die', 'und', 'das', 'nicht'])) AS de FROM w) SELECT doc_id, CAST(en AS INTEGER) AS en, CAST(de AS INTEGER) AS de, CASE WHEN de > en THEN 'de' ELSE 'en' END AS vote FROM v""")
def tx_lang_vote(t: Tables) -> DataFrame:
    words = F.array_distinct(tokens(F.col("text")))
    votes = lambda *markers: F.size(F.array_intersect(words, F.array(*map(F.lit, markers))))
    en, de = votes("the", "and", "of", "is", "to"), votes("der", "die", "und", "das", "nicht")
    return t.documents.select("doc_id", en.alias("en"), de.alias("de"), F.when(de > en, "de").otherwise("en").alias("vote"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS mails, sha256(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[redacted]', 'g')) AS redacted FROM documents""")
def g_redact_pii(t: Tables) -> DataFrame:
    mail = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(mail)).cast("long").alias("mails"), F.sha2(F.regexp_replace("text", mail, "[redacted]"), 256).alias("redacted"))


@query("""SELECT vec_id FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64""")
def v_check(t: Tables) -> DataFrame:
    return t.embeddings.filter(vectors.vector_problem(F.col("embedding"), 64).isNotNull()).select("vec_id")


@query("""SELECT label, count(*) AS n, round(avg(x), 6) AS mean_norm, round(min(x), 6) AS least_norm, round(max(x), 6) AS most_norm FROM (SELECT label, sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))) AS x FROM embeddings) GROUP BY 1""")
def ag_norm_stats(t: Tables) -> DataFrame:
    return vectors.norm_statistics(t.embeddings, "embedding", ("label",))


@query("""SELECT source, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, quantile_cont(n_chars, 0.5) AS median, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM documents GROUP BY 1""")
def ag_chunk_stats(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"), F.expr("percentile(n_chars, 0.5)").alias("median"), F.round(F.expr("percentile(n_chars, 0.95)"), 6).alias("p95"))


@query("""SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars, round(count(*) FILTER (WHERE toxic = 1) / nullif(count(toxic), 0), 6) AS toxic_rate FROM (SELECT d.*, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY 1""")
def ag_corpus_report(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.sum("n_chars").alias("chars"), ratio(F.count_if(F.col("toxic") == 1), F.count("toxic")).alias("toxic_rate"))


@query("""SELECT lang, source, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS k FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)) WHERE k <= 3""")
def ui_top_entries(t: Tables) -> DataFrame:
    return ordering.first_per_key(t.documents.groupBy("lang", "source").agg(F.count("*").alias("n")), ["lang"], [F.desc("n"), F.col("source")], 3)


@query("""SELECT lang, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY 1""")
def ui_facets(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query(r"""WITH l AS (SELECT doc_id, u.i AS i, u.t AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) d, LATERAL (SELECT unnest(d.s) AS t, unnest(range(1, len(d.s) + 1)) AS i) u), f AS (SELECT doc_id, i, trim(t) AS t, lead(trim(t)) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM l WHERE trim(t) <> '') SELECT doc_id, CAST(i AS INTEGER) AS i, coalesce(length(next) < 40, false) AS heading_follows FROM f""")
def wn_toc_lookahead(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(lines(F.col("text"))).alias("p", "t")).filter(F.trim("t") != "")
    w = Window.partitionBy("doc_id").orderBy("p")
    return rows.select("doc_id", (F.col("p") + 1).alias("i"), F.coalesce(F.length(F.lead(F.trim("t")).over(w)) < 40, F.lit(False)).alias("heading_follows"))
