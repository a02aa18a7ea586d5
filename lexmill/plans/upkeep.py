"""Queries on pages and their upkeep: quality, margins, kept results, consistency of releases, provenance of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import quality
from lexmill.operators import consistency, margins
from lexmill.sources import page_cache, shared

from .registry import Tables, query
from .statutes import LINES
from .statutes import pages as statute_pages

_SPACE = r"[ \t\n\x0B\f\r\x1c-\x1f\x{85}\x{a0}]"
_SHARES = rf"""s AS (SELECT *, length(text) AS n0, length(regexp_replace(text, '{_SPACE}+', '', 'g')) AS n, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM t),
c AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE 1 - length(regexp_replace(regexp_replace(text, '{_SPACE}+', '', 'g'), '[^\p{{C}}\p{{Z}}]+', '', 'g')) / n END AS readable, CASE WHEN n = 0 THEN 0 ELSE length(regexp_replace(text, '[^\p{{L}}\p{{N}}]+', '', 'g')) / n END AS alnum, CASE WHEN n = 0 THEN 0 ELSE length(regexp_replace(text, '[^�]+', '', 'g')) / n END AS replaced,
  CASE WHEN len(l) < 10 THEN 0 ELSE len(list_filter(l, lambda x: len(string_split(x, ' ')) <= 2)) / len(l) END AS fragments FROM s),
q AS (SELECT *, 0.25 * least(1, n0 / 120) + 0.35 * readable + 0.35 * least(1, alnum / 0.7) + 0.05 * greatest(0, 1 - 20 * replaced) AS raw FROM c),
j AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN n0 < 40 OR fragments > 0.6 THEN round(least(raw, 0.6) + 1e-9, 4) ELSE round(least(1, raw) + 1e-9, 4) END AS score, concat_ws(',', CASE WHEN n0 < 40 THEN 'insufficient_text' END, CASE WHEN n = 0 THEN 'empty_page' END, CASE WHEN n > 0 AND readable < 0.97 THEN 'control_or_unreadable_characters' END, CASE WHEN n > 0 AND alnum < 0.55 THEN 'low_alphanumeric_ratio' END, CASE WHEN n > 0 AND replaced > 0.005 THEN 'replacement_glyphs' END, CASE WHEN n > 0 AND fragments > 0.6 THEN 'missing_word_spaces' END) AS flags FROM q)"""


@query(f"WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {_SHARES} SELECT doc_id, CAST(score AS DOUBLE) AS score, flags FROM j")
def tx_quality(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", quality.page_quality(F.col("text")).alias("q")).select("doc_id", "q.score", F.array_join("q.flags", ",").alias("flags"))


_PLAIN = r"coalesce(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')), '')"


def _plain(html: Column) -> Column:
    """What is left of a page without its tags, in one line."""
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"[ \t\n\x0B\f\r]+", " ")), F.lit(""))


@query(f"WITH t AS (SELECT page_id, html, {_PLAIN} AS text FROM pages), {_SHARES}, k AS (SELECT *, CASE WHEN length(trim(text)) >= 40 THEN 'text' WHEN html LIKE '%<img%' THEN 'scanned' ELSE 'empty' END AS kind FROM j) SELECT page_id, kind, kind <> 'empty' AND (score < 0.65 OR kind = 'scanned') AS read_again FROM k")
def tx_needs_ocr(t: Tables) -> DataFrame:
    """Pages that must be read from their image; a page has images if its source has."""
    rows = t.pages.select("page_id", F.col("html").contains("<img").alias("images"), _plain(F.col("html")).alias("text"))
    told = rows.select("page_id", quality.page_kind(F.col("text"), F.col("images")).alias("kind"), quality.page_quality(F.col("text"))["score"].alias("score"))
    return told.select("page_id", "kind", quality.needs_reading(F.col("kind"), F.col("score")).alias("read_again"))


def edged_pages(t: Tables) -> DataFrame:
    """Statutes with headers and footers."""
    first = F.when(F.col("page") % 4 == 0, F.lit("PRESIDEN REPUBLIK INDONESIA")).otherwise(F.concat(F.lit("Lembar "), "page"))
    return statute_pages(t).withColumn("text", F.concat(first, F.lit("\n"), "text", F.lit("\n- "), "page", F.lit(" -")))


_EDGED = f"""{LINES}, e AS (SELECT document_id, page, -1 AS line_no, CASE WHEN page % 4 = 0 THEN 'PRESIDEN REPUBLIK INDONESIA' ELSE 'Lembar ' || page END AS line FROM o UNION ALL SELECT document_id, page, line_no, line FROM lines UNION ALL SELECT document_id, page, 100000, '- ' || page || ' -' FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY line_no) - 1 AS place, count(*) OVER (PARTITION BY document_id, page) AS n FROM e WHERE line <> ''),
g AS (SELECT *, place < 3 OR place >= n - 3 AS edge, CASE WHEN NOT regexp_matches(line, '(?i)^\\s*(BAB\\s+[IVXLCDM]+|Bagian\\b|Paragraf\\b|Pasal\\s*\\d+|Ayat\\b)') THEN regexp_replace(lower(line), '\\d+', '#', 'g') END AS sig FROM p),
r AS (SELECT document_id, sig FROM g JOIN (SELECT document_id, count(*) AS pages FROM o GROUP BY 1) z USING (document_id) WHERE edge AND sig IS NOT NULL GROUP BY document_id, sig, pages HAVING count(DISTINCT page) >= greatest(3, ceil(pages * 0.3))),
d AS (SELECT g.*, CASE WHEN edge AND g.sig IS NOT NULL THEN CASE WHEN regexp_matches(line, '(?i)^\\s*(PRESIDEN\\s+REPUBLIK\\s+INDONESIA|SK\\s+No\\.|-?\\s*\\d+\\s*-?)\\s*$') THEN 'known_pattern' WHEN r.sig IS NOT NULL THEN 'repeated_margin' END END AS reason FROM g LEFT JOIN r ON r.document_id = g.document_id AND r.sig = g.sig)"""


@query(f"WITH {_EDGED} SELECT document_id, page, CAST(place AS INTEGER) AS place, line, reason FROM d WHERE reason IS NOT NULL")
def tx_margin_noise(t: Tables) -> DataFrame:
    return margins.margin_lines(edged_pages(t))[1]


@query(f"WITH {_EDGED} SELECT document_id, page, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE reason IS NULL), '')) AS text FROM d GROUP BY document_id, page")
def tx_margin_clean(t: Tables) -> DataFrame:
    return margins.margin_lines(edged_pages(t))[0].withColumn("text", F.sha2("text", 256))


@query(f"SELECT page_id, CASE WHEN bool_or(page_id % 3 <> 0) OVER (PARTITION BY html) THEN 1 ELSE 2 END AS run, length({_PLAIN}) AS characters FROM pages WHERE html IS NOT NULL")
def src_page_cache(t: Tables) -> DataFrame:
    """Pages by the digest of their source: a first run over two thirds, then all; the second does what is new alone."""
    path = shared.scratch(t.pages.sparkSession, "cache")
    work = t.pages.select("page_id", F.sha2("html", 256).alias("sha"), F.lit("plain-v1").alias("profile"), "html")
    run = lambda k: lambda todo: todo.select("sha", "profile", F.lit(k).alias("run"), F.length(_plain(F.col("html"))).cast("long").alias("characters"))
    page_cache.cached(work.filter("page_id % 3 <> 0"), path, ("sha", "profile"), run(1))
    rows, _ = page_cache.cached(work, path, ("sha", "profile"), run(2))
    return work.select("page_id", "sha").join(rows, "sha").select("page_id", "run", "characters")


@query(r"""WITH e AS (SELECT doc_id AS d, doc_id % 4 AS v, doc_id || '-v' || (doc_id % 4) AS i FROM documents WHERE doc_id % 10 < 8), r AS (SELECT doc_id AS d, doc_id % 4 + CASE WHEN doc_id % 50 = 3 THEN 1 ELSE 0 END AS v FROM documents WHERE doc_id % 10 BETWEEN 1 AND 8),
h AS (SELECT item_id AS k FROM benchmark), l AS (SELECT doc_id AS k, bool_and(coalesce(quality = 1 AND toxic = 0, false)) AS fit FROM labels GROUP BY 1)
SELECT CASE WHEN r.d IS NULL THEN 'not_released' WHEN e.d IS NULL THEN 'not_eligible' ELSE 'other_version' END AS finding, CAST(coalesce(e.d, r.d) AS VARCHAR) AS name FROM e FULL JOIN r ON r.d = e.d WHERE r.d IS NULL OR e.d IS NULL OR r.v <> e.v
UNION ALL SELECT 'build_missing', i FROM e WHERE d % 7 = 0 UNION ALL SELECT CASE WHEN fit IS NULL THEN 'historical_missing' ELSE 'historical_unfit' END, CAST(h.k AS VARCHAR) FROM h LEFT JOIN l ON l.k = h.k WHERE fit IS NULL OR NOT fit UNION ALL SELECT 'relations_changed', 'old'""")
def flt_release_consistency(t: Tables) -> DataFrame:
    """Labelled documents stand for versions, benchmark items for what serves history."""
    d, own = F.col("doc_id"), t.documents.select("doc_id")
    eligible = own.filter("doc_id % 10 < 8").select(d.alias("document_id"), (d % 4).alias("version"), F.concat(d, F.lit("-v"), d % 4).alias("version_id"))
    released = own.filter("doc_id % 10 between 1 and 8").select(d.alias("document_id"), (d % 4 + F.when(d % 50 == 3, 1).otherwise(0)).alias("version"))
    builds = eligible.filter("document_id % 7 <> 0").select("version_id")
    good = F.col("quality") == 1
    versions = t.labels.select(d.cast("string").alias("version_id"), F.when(good, "published").otherwise("draft").alias("publication_status"), F.lit("verified").alias("source_verification_status"), F.when(F.col("toxic") == 0, "verified").otherwise("pending").alias("legal_review_status"), F.lit("completed").alias("ingestion_status"))
    relations = t.nation.select(F.col("n_name").alias("source"), F.col("n_regionkey").cast("string").alias("target"), F.lit("in").alias("kind"))
    old = t.region.limit(1).select(F.lit("old").alias("hash"))
    return consistency.release_findings(eligible, released, builds, t.benchmark.select(F.col("item_id").cast("string").alias("version_id")), versions, relations, old, F.lit(True))


_CHUNKS = r"""c AS (SELECT l_orderkey AS owner, l_orderkey + CASE WHEN l_partkey % 29 = 0 THEN 1 ELSE 0 END AS document_id, l_linenumber - 1 AS place, CAST(CASE WHEN l_partkey % 31 = 0 THEN 1 ELSE l_linenumber END AS VARCHAR) AS chunk_id, l_linenumber AS page_start, CASE WHEN l_partkey % 17 = 0 THEN l_linenumber - 1 ELSE l_linenumber + 1 END AS page_end, ' isi ' || l_partkey || chr(13) || chr(10) AS content,
  CASE WHEN l_partkey % 13 = 0 THEN 'x' ELSE sha256('isi ' || l_partkey) END AS content_hash, CASE WHEN l_linenumber > 1 THEN CASE WHEN l_partkey % 19 = 0 THEN 'none' ELSE '1' END END AS parent, l_partkey AS k FROM lineitem), n AS (SELECT owner, chunk_id, count(*) AS n FROM c GROUP BY 1, 2)"""


@query(rf"""WITH {_CHUNKS} SELECT c.document_id, c.chunk_id, c.place, concat_ws(',', CASE WHEN n > 1 THEN 'repeated_chunk_id' END, CASE WHEN parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n m WHERE m.owner = c.owner AND m.chunk_id = c.parent) THEN 'unknown_parent' END, CASE WHEN page_start > 7 OR page_end > 7 OR page_end < 1 THEN 'unknown_page' END,
  CASE WHEN c.document_id <> c.owner THEN 'document_id' END, CASE WHEN page_start > page_end THEN 'page_order' END, CASE WHEN content_hash <> sha256('isi ' || k) THEN 'content_hash' END,
  CASE WHEN k % 23 = 0 THEN 'schema_version' ELSE nullif(concat_ws(',', CASE WHEN k % 37 = 0 THEN 'missing_year' END, CASE WHEN k % 41 = 0 THEN 'source_missing' END, CASE WHEN k % 43 = 0 THEN 'file_hash' END, CASE WHEN k % 47 = 0 THEN 'chunk_index' END, CASE WHEN k % 53 = 0 THEN 'metadata_section_path' END, CASE WHEN k % 59 = 0 THEN 'missing_embedding_model' END, CASE WHEN k % 61 = 0 THEN 'created_at_form' END, CASE WHEN k % 67 = 0 AND k % 61 <> 0 THEN 'updated_before_created' END, 'metadata_hash'), '') END) AS issues
FROM c JOIN n ON n.owner = c.owner AND n.chunk_id = c.chunk_id""")
def tx_provenance_check(t: Tables) -> DataFrame:
    """Line items as chunks of their order; no one has hashed their metadata, other faults follow the part's number."""
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    broken = lambda m, bad, good: F.when(k % m == 0, bad).otherwise(good)
    base = t.lineitem.select(
        F.col("l_orderkey").alias("owner"), (F.col("l_orderkey") + broken(29, F.lit(1), F.lit(0))).alias("document_id"), (n - 1).alias("place"), broken(31, F.lit("1"), n.cast("string")).alias("chunk_id"), n.alias("page_start"), broken(17, n - 1, n + 1).alias("page_end"),
        F.concat(F.lit(" isi "), k, F.lit("\r\n")).alias("content"), broken(13, F.lit("x"), F.sha2(F.concat(F.lit("isi "), k), 256)).alias("content_hash"), F.when(n > 1, broken(19, F.lit("none"), F.lit("1"))).alias("parent_chunk_id"), F.array(F.lit("Pasal 1")).alias("section_path"), k.alias("k"),
    )
    k = F.col("k")
    document = F.struct(F.col("owner").alias("document_id"), F.lit("UU").alias("document_type"), F.lit("1").alias("document_number"), broken(37, F.lit(None).cast("int"), F.lit(2020)).alias("year"), F.lit("T").alias("document_title"), F.lit("active").alias("regulation_status"), broken(43, F.lit("abc"), F.sha2(F.lit("f"), 256)).alias("file_hash"), broken(41, F.lit(""), F.lit("https://x")).alias("source_url"), F.lit(None).cast("string").alias("source_file"))
    structure = F.struct("page_start", "page_end", broken(53, F.array(F.lit("x")), F.col("section_path")).alias("section_path"))
    chunk = F.struct("chunk_id", broken(47, F.lit(99), F.col("place")).alias("chunk_index"), "content_hash", "parent_chunk_id", F.lit("unknown").alias("metadata_hash"))
    ingestion = F.struct(F.lit("p").alias("parser_version"), F.lit("c").alias("chunker_version"), broken(59, F.lit(""), F.lit("e")).alias("embedding_model"), broken(61, F.lit("2024-01-01T00:00:00"), F.lit("2024-01-01T00:00:00+00:00")).alias("created_at"), broken(67, F.lit("2023-12-31T23:59:59Z"), F.lit("2024-01-01T08:00:00+07:00")).alias("updated_at"))
    chunks = base.withColumn("metadata", F.struct(broken(23, F.lit("v0"), F.lit(consistency.SCHEMA_VERSION)).alias("schema_version"), document.alias("document"), structure.alias("structure"), chunk.alias("chunk"), ingestion.alias("ingestion")))
    pages = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("page")).distinct()
    return consistency.provenance_issues(chunks, pages).select("document_id", "chunk_id", "place", F.array_join("issues", ",").alias("issues"))


