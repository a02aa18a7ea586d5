"""Queries on what may be taken in or served, and on passages of statutes that are headings, definitions or neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import headings
from lexmill.operators import ranking, records
from lexmill.operators import segments as seg

from . import statutes
from .registry import Tables, query
from .statutes import LINES, STATED

_RECORDS = r"""r AS (SELECT l_orderkey * 1000 + l_linenumber * 10 + l_partkey % 10 AS place, CASE WHEN l_partkey % 11 = 0 THEN ' ' WHEN l_partkey % 13 = 0 THEN NULL ELSE 'c' || (l_partkey % 500) END AS id, CASE WHEN l_suppkey % 9 = 0 THEN chr(10) || ' ' ELSE 'isi ' || l_partkey END AS content, CASE WHEN l_suppkey % 7 = 0 THEN 'x' WHEN l_suppkey % 5 = 0 THEN '' ELSE sha256('isi ' || l_partkey) END AS h FROM lineitem),
o AS (SELECT *, CASE WHEN trim(coalesce(id, '')) = '' THEN 'empty_id' WHEN trim(regexp_replace(content, '\s+', ' ', 'g')) = '' THEN 'empty_text' WHEN h <> '' AND h <> sha256(content) THEN 'content_hash_mismatch' END AS own FROM r), t AS (SELECT id, min(place) FILTER (WHERE own IS NULL) AS taken FROM o GROUP BY id)"""


@query(f"WITH {_RECORDS} SELECT coalesce(CASE WHEN taken < place AND trim(coalesce(o.id, '')) <> '' THEN 'duplicate_id' ELSE own END, 'taken') AS reason, count(*) AS n FROM o LEFT JOIN t ON t.id IS NOT DISTINCT FROM o.id GROUP BY 1")
def src_chunk_validate(t: Tables) -> DataFrame:
    """Line items as chunks: why each is taken or skipped, counted."""
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    own = F.concat(F.lit("isi "), k)
    chunks = t.lineitem.select((F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 10 + k % 10).alias("place"), F.when(k % 11 == 0, F.lit(" ")).when(k % 13 == 0, None).otherwise(F.concat(F.lit("c"), k % 500)).alias("chunk_id"), F.when(s % 9 == 0, F.lit("\n ")).otherwise(own).alias("content"), F.when(s % 7 == 0, F.lit("x")).when(s % 5 == 0, F.lit("")).otherwise(F.sha2(own, 256)).alias("content_hash"))
    return records.chunk_reasons(chunks, "place").groupBy(F.coalesce("reason", F.lit("taken")).alias("reason")).agg(F.count("*").alias("n"))


@query(r"""WITH f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'a.txt' WHEN p_partkey % 7 = 1 THEN NULL ELSE 'a.PDF' END AS name, p_partkey % 5 = 0 AS bad, p_size - 1 AS size, p_partkey % 11 = 0 AS encrypted, p_partkey % 4 AS pages, p_partkey % 90 AS characters FROM part)
SELECT k, NOT coalesce(name NOT ILIKE '%.pdf' OR name IS NULL OR bad OR size = 0 OR encrypted OR pages = 0, false) AS eligible, CASE WHEN name IS NULL OR name NOT ILIKE '%.pdf' THEN 'not_a_pdf' WHEN bad THEN 'bad_magic' WHEN size = 0 THEN 'empty_file' WHEN encrypted THEN 'encrypted' WHEN pages = 0 THEN 'no_pages' WHEN characters < 40 THEN 'no_embedded_text' END AS code FROM f""")
def src_eligibility(t: Tables) -> DataFrame:
    """Parts as files."""
    k = F.col("p_partkey")
    verdict = records.file_verdict(F.when(k % 7 == 0, "a.txt").when(k % 7 > 1, "a.PDF"), F.when(k % 5 == 0, F.lit(b"PK")).otherwise(F.lit(b"%PDF-1.7")), F.col("p_size") - 1, k % 11 == 0, k % 4, k % 90)
    return t.part.select(k.alias("k"), verdict.alias("v")).select("k", "v.*")


_VERSIONS = """v AS (SELECT o_orderkey AS version_id, CASE WHEN o_orderkey % 9 = 0 THEN 'draft' ELSE 'published' END AS p, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'verified' END AS s, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'verified' END AS r, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'completed' END AS i, CASE o_orderkey % 6 WHEN 0 THEN 'revoked' WHEN 1 THEN 'amended' ELSE 'active' END AS l,
  CASE o_orderkey % 5 WHEN 0 THEN 'https://jdih.go.id.evil.com/x' WHEN 1 THEN 'HTTPS://user@Peraturan.GO.ID:443/a?b' WHEN 2 THEN 'https://go.id' WHEN 3 THEN 'http://x.go.id/' ELSE 'https://jdih.kemnaker.go.id/a' END AS u, o_orderkey % 3 <> 0 AS c FROM orders)"""
_FIT = "p = 'published' AND s = 'verified' AND r = 'verified' AND i = 'completed' AND l IN ('active', 'amended') AND version_id % 5 IN (1, 2, 4) AND c"


def versions(t: Tables) -> DataFrame:
    """Orders as versions."""
    k = F.col("o_orderkey")
    url = F.when(k % 5 == 0, "https://jdih.go.id.evil.com/x").when(k % 5 == 1, "HTTPS://user@Peraturan.GO.ID:443/a?b").when(k % 5 == 2, "https://go.id").when(k % 5 == 3, "http://x.go.id/").otherwise("https://jdih.kemnaker.go.id/a")
    return t.orders.select(
        k.alias("version_id"), F.when(k % 9 == 0, "draft").otherwise("published").alias("publication_status"), F.when(k % 8 != 0, "verified").alias("source_verification_status"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("verified").alias("legal_review_status"),
        F.when(k % 7 == 0, "failed").otherwise("completed").alias("ingestion_status"), F.when(k % 6 == 0, "revoked").when(k % 6 == 1, "amended").otherwise("active").alias("legal_status"), url.alias("source_url"), (k % 3 != 0).alias("is_current"),
    )


@query(f"WITH {_VERSIONS} SELECT version_id, total, skipped FROM v, (SELECT count(*) AS total, count(*) FILTER (WHERE NOT coalesce({_FIT}, false)) AS skipped FROM v) WHERE {_FIT}")
def flt_governance(t: Tables) -> DataFrame:
    fit, counts = records.servable(versions(t))
    return fit.select("version_id").crossJoin(counts)  # one row of counts


@query(f"WITH {_VERSIONS} SELECT version_id, version_id % 5 IN (1, 2, 4) AS canonical FROM v")
def flt_canonical_url(t: Tables) -> DataFrame:
    return versions(t).select("version_id", records.official_host(F.col("source_url")).alias("canonical"))


_HEADING = rf"""regexp_matches(trim({{0}}, ' .:;-—'), '(?i)^(bab\s+[ivxlcdm]+|bagian\s+(ke\S+|[ivxlcdm]+)|pasal\s+\d+[a-z]?)\b') AND len(regexp_extract_all(lower({{0}}), '[\p{{{{L}}}}\p{{{{N}}}}_-]+')) <= 12 AND NOT list_has_any(regexp_extract_all(lower({{0}}), '[\p{{{{L}}}}\p{{{{N}}}}_-]+'), [{", ".join(f"'{w}'" for w in headings.RULING)}])"""


@query(f"WITH {LINES} SELECT document_id, page, CAST(line_no AS INTEGER) AS line_no, {_HEADING.format('line')} AS heading FROM lines WHERE line <> ''")
def tx_heading_only(t: Tables) -> DataFrame:
    lines = seg.page_lines(statutes.pages(t)).filter("line <> ''")
    return lines.select("document_id", "page", "line_no", headings.heading_only(F.col("line")).alias("heading"))


@query(f"WITH {LINES}, h AS (SELECT document_id AS query_id, page, CAST(line_no AS INTEGER) AS line_no, {_HEADING.format('line')} AS bad FROM lines WHERE line <> '' AND page <= 2), n AS (SELECT *, count(*) FILTER (WHERE NOT bad) OVER (PARTITION BY query_id) AS n FROM h) SELECT query_id, page, line_no FROM n WHERE NOT bad OR n = 0")
def r_heading_drop(t: Tables) -> DataFrame:
    """Lines of each statute's first two pages as the passages ranked for a query."""
    lines = seg.page_lines(statutes.pages(t).filter("page <= 2")).filter("line <> ''")
    return ranking.keep_unless_empty(lines.withColumnRenamed("document_id", "query_id"), headings.heading_only(F.col("line"))).select("query_id", "page", "line_no")


#: Segments of statutes ranked for twenty queries by a hash, the first ten of each.
_RANKED = f"""{LINES}, {STATED}, k AS (SELECT *, document_id % 20 AS query_id, row_number() OVER (PARTITION BY document_id % 20 ORDER BY md5(segment_id)) AS rank FROM found), ranked AS (SELECT *, 1 / rank AS score FROM k WHERE rank <= 10)"""


def _ranked(t: Tables) -> tuple[DataFrame, DataFrame]:
    passages = seg.segments(statutes.pages(t)).withColumnRenamed("segment_id", "passage_id")
    order = Window.partitionBy("query_id").orderBy(F.md5("passage_id"))
    own = passages.withColumn("query_id", F.col("document_id") % 20).withColumn("rank", F.row_number().over(order)).filter("rank <= 10")
    return own.withColumn("score", 1 / F.col("rank")), passages


@query(rf"""WITH {_RANKED} SELECT query_id, segment_id AS passage_id, regexp_matches(coalesce(chapter, '') || ' ' || coalesce(section, ''), '(?i)(^|[^a-z])bab\s+i([^a-z]|$)|ketentuan\s+umum') AND query_id % 4 <> 0 AS demoted, CASE WHEN regexp_matches(coalesce(chapter, '') || ' ' || coalesce(section, ''), '(?i)(^|[^a-z])bab\s+i([^a-z]|$)|ketentuan\s+umum') AND query_id % 4 <> 0 THEN round(greatest(0, score - 0.12), 6) ELSE score END AS score FROM ranked""")
def r_definition(t: Tables) -> DataFrame:
    """Every fourth query asks for a meaning."""
    rows = _ranked(t)[0].withColumn("asked", F.when(F.col("query_id") % 4 == 0, "apa itu upah").otherwise("berapa upah"))
    return ranking.demoted_definitions(rows, "asked").select("query_id", "passage_id", "demoted", "score")


@query(f"""WITH {_RANKED}, n AS (SELECT segment_id, document_id, place, article, {_HEADING.format("text")} AS heading FROM found), c AS (SELECT r.query_id, b.segment_id, r.rank, b.place - a.place AS side, r.score FROM ranked r JOIN n a ON a.segment_id = r.segment_id JOIN n b ON b.document_id = a.document_id AND b.place IN (a.place - 1, a.place + 1) AND b.article = a.article AND NOT b.heading WHERE r.rank <= 3),
f AS (SELECT query_id, segment_id, min(rank * 10 + side) AS o, arg_min(score, rank * 10 + side) AS score FROM c WHERE NOT EXISTS (SELECT 1 FROM ranked x WHERE x.query_id = c.query_id AND x.segment_id = c.segment_id) GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS n FROM f)
SELECT query_id, segment_id AS passage_id, score, false AS added FROM ranked UNION ALL SELECT query_id, segment_id, round(score * 0.85, 6), true FROM t WHERE n <= 4""")
def r_expand(t: Tables) -> DataFrame:
    return ranking.expanded(*_ranked(t))


@query(r"""WITH l AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents), h AS (SELECT *, substr(t, 1, 257) AS h, regexp_extract(substr(t, 1, 257), '(?s)^(.*[.!?]\s)', 1) AS e FROM l) SELECT doc_id, CASE WHEN length(t) <= 260 THEN t ELSE rtrim(CASE WHEN length(e) > 86 THEN e ELSE h END) || '...' END AS quote FROM h""")
def g_compact(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", headings.compact(F.col("text")).alias("quote"))
