"""Queries on filters, stored artifacts, builds, vectors and conflicting records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import filters
from lexmill.operators import conflicts
from lexmill.sources import artifacts, builds, shared, vector_store

from .registry import Tables, query

_FACETS = """f AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'Pasal ' || (doc_id % 20) END AS article, CASE WHEN doc_id % 7 <> 0 THEN CAST(1990 + doc_id % 35 AS INTEGER) END AS year, lang AS legal_status, source AS publication_status, strftime(DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER), '%Y-%m-%d') AS effective_date, [lang, source] AS topics_chunk FROM documents)"""
FILTERS = {
    "article": filters.filter_document(article="Pasal 3", year=0),
    "years": {"year": {"$gte": 2000, "$lte": 2010}},
    "statuses": filters.filter_document(legal_statuses=["en", "de"], article="Pasal 7"),
    "effective": filters.filter_document(effective_on="2021-06-30"),
    "topics": filters.filter_document(topics=["en", "src3"]),
    "no_year": {"year": {"$eq": None}},
    "plain": {"year": 2001, "unknown": None},
    "text_is_no_number": {"year": {"$eq": "2001"}},
    "some": {"year": {"$in": [2001, None, "x"]}, "publication_status": {"$in": ["src1", "src2"], "$gte": "src2"}},
    "unknown": {"segment_kind": {"$in": ["explanation"]}},
    "nothing": {},
}
#: The same in SQL, written by hand. A list equals no text, so `topics` finds nothing.
FILTERS_SQL = {
    "article": "article = 'Pasal 3'", "years": "year >= 2000 AND year <= 2010", "statuses": "legal_status IN ('en', 'de') AND article = 'Pasal 7'", "effective": "effective_date <= '2021-06-30'", "topics": "false", "no_year": "year IS NULL",
    "plain": "year = 2001", "text_is_no_number": "false", "some": "(year = 2001 OR year IS NULL) AND publication_status IN ('src1', 'src2') AND publication_status >= 'src2'", "unknown": "false", "nothing": "true",
}


def facets(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.select(
        "doc_id", F.when(d % 5 != 0, F.concat(F.lit("Pasal "), d % 20)).alias("article"), F.when(d % 7 != 0, (1990 + d % 35).cast("int")).alias("year"), F.col("lang").alias("legal_status"), F.col("source").alias("publication_status"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (d % 1000).cast("int")), "yyyy-MM-dd").alias("effective_date"), F.array("lang", "source").alias("topics_chunk"),
    )


@query(f"WITH {_FACETS} " + " UNION ALL ".join(f"SELECT '{k}' AS filter, doc_id FROM f WHERE {v}" for k, v in FILTERS_SQL.items()))
def flt_backend(t: Tables) -> DataFrame:
    return filters.matched(facets(t), FILTERS, "doc_id")


@query(f"WITH {_FACETS} SELECT 'topics' AS filter, doc_id FROM f WHERE list_has_any(topics_chunk, ['en', 'src3']) UNION ALL SELECT 'years', doc_id FROM f WHERE year >= 2000 AND year <= 2010")
def flt_backend_overlap(t: Tables) -> DataFrame:
    return filters.matched(facets(t), {k: FILTERS[k] for k in ("topics", "years")}, "doc_id", overlap=True)


_ASKED = """q AS (SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'apa isi pasal ' || (o_orderkey % 50) || 'a menurut pp no. ' || (o_orderkey % 90) || ' tahun ' || (1990 + o_orderkey % 40) WHEN 1 THEN 'aturan cipta kerja yang terbaru' WHEN 2 THEN 'berlaku sejak ' || (1990 + o_orderkey % 40)
  WHEN 3 THEN 'penjelasan pasal ' || (o_orderkey % 9) || ' tahun 2003' WHEN 4 THEN 'permenaker ' || (o_orderkey % 30) || ' sudah dicabut' WHEN 5 THEN 'uu ketenagakerjaan masih berlaku' ELSE 'apakah upah dibayar' END AS q FROM orders)"""


def questions(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    said = (
        F.when(k % 7 == 0, F.concat(F.lit("apa isi pasal "), k % 50, F.lit("a menurut pp no. "), k % 90, F.lit(" tahun "), 1990 + k % 40)).when(k % 7 == 1, F.lit("aturan cipta kerja yang terbaru")).when(k % 7 == 2, F.concat(F.lit("berlaku sejak "), 1990 + k % 40))
        .when(k % 7 == 3, F.concat(F.lit("penjelasan pasal "), k % 9, F.lit(" tahun 2003"))).when(k % 7 == 4, F.concat(F.lit("permenaker "), k % 30, F.lit(" sudah dicabut"))).when(k % 7 == 5, F.lit("uu ketenagakerjaan masih berlaku")).otherwise(F.lit("apakah upah dibayar"))
    )
    return t.orders.select(k.alias("k"), said.alias("q"))


@query(rf"""WITH {_ASKED}, p AS (SELECT k, q, nullif(regexp_extract(q, 'pasal\s+([0-9]+[a-z]?)', 1), '') AS a, nullif(regexp_extract(q, '\b(19[0-9]{{2}}|20[0-9]{{2}})\b', 1), '') AS y, nullif(regexp_extract(q, '\b(uu|pp|permenaker|perpres)\s*(?:nomor|no\.?\s*)?(\d+)\b', 1), '') AS r, nullif(regexp_extract(q, '\b(uu|pp|permenaker|perpres)\s*(?:nomor|no\.?\s*)?(\d+)\b', 2), '') AS n FROM q)
SELECT k, 'Pasal ' || upper(a) AS article, CAST(CASE WHEN r IS NOT NULL THEN y WHEN q LIKE '%cipta kerja%' THEN '2023' WHEN q LIKE '%uu ketenagakerjaan%' THEN '2003' WHEN a IS NOT NULL THEN y END AS INTEGER) AS year,
  CASE r WHEN 'pp' THEN 'PP' WHEN 'permenaker' THEN 'Permenaker' ELSE CASE WHEN q LIKE '%cipta kerja%' OR q LIKE '%uu ketenagakerjaan%' THEN 'UU' END END AS regulation_type, CAST(CASE WHEN r IS NOT NULL THEN n WHEN q LIKE '%cipta kerja%' THEN '6' WHEN q LIKE '%uu ketenagakerjaan%' THEN '13' END AS INTEGER) AS number,
  CASE WHEN q LIKE '%dicabut%' THEN 'revoked' END AS legal_status, CASE WHEN q LIKE '%penjelasan%' THEN 'explanation' END AS segment_kind, CASE WHEN q LIKE '%terbaru%' OR q LIKE '%masih berlaku%' THEN 'fresh' END AS freshness FROM p""")
def q_filters(t: Tables) -> DataFrame:
    asked = questions(t).withColumn("f", filters.asked_filters(F.col("q")))
    return asked.select("k", *[F.col(f"f.{x}").alias(x) for x in ("article", "year", "regulation_type", "number", "legal_status")], F.col("f.segment_kinds")[0].alias("segment_kind"), F.col("f.freshness_states")[0].alias("freshness"))


_FILES = """a AS (SELECT '/store/documents/u' || user_id || '/v' || (event_id % 3) || CASE WHEN event_type = 'view' THEN '' ELSE '/builds/b' || (event_id % 5) END AS owner, 'u' || user_id AS document_id, CAST(event_id % 3 AS INTEGER) AS version, CASE WHEN event_type <> 'view' THEN 'b' || (event_id % 5) END AS build_id, max(ts) AS modified FROM events GROUP BY ALL)"""


@query(f"""WITH {_FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY modified DESC, build_id IS NULL, version DESC, owner) AS r FROM a) SELECT document_id, version, build_id, owner FROM r WHERE r = 1""")
def src_artifacts(t: Tables) -> DataFrame:
    """The newest files of all documents. Events stand for files: what is written is the last event of each path."""
    e, kind = F.col("event_id"), F.col("event_type")
    owner = F.concat(F.lit("/store/documents/u"), "user_id", F.lit("/v"), e % 3, F.when(kind == "view", F.lit("")).otherwise(F.concat(F.lit("/builds/b"), e % 5)))
    files = t.events.groupBy(F.concat(owner, F.lit("/processed/chunks.json")).alias("path")).agg(F.max(F.col("ts").cast("timestamp")).alias("modified"))
    return artifacts.newest_artifacts(artifacts.artifact_files(files)).select("document_id", "version", "build_id", "owner")


@query(r"""SELECT 'b-' || source AS build_id, CAST(doc_id AS VARCHAR) AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_index, sha256(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS content_hash, CAST(len(embedding) AS INTEGER) AS dimensions, 'reused' AS again FROM documents JOIN embeddings ON vec_id = doc_id""")
def sink_persist_build(t: Tables) -> DataFrame:
    """Builds of all sources, stored and prepared once more; the second run finds them as they are."""
    spark, root = t.documents.sparkSession, shared.scratch(t.documents.sparkSession, "store")
    both = t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id")).select("*", F.concat(F.lit("b-"), "source").alias("build_id"), F.col("doc_id").cast("string").alias("chunk_id"))
    own = both.select("build_id", F.col("source").alias("document_id"), F.concat("source", F.lit("-v1")).alias("version_id"), F.sha2("source", 256).alias("source_sha256"), F.lit("c").alias("config_hash"), F.lit("m").alias("metadata_hash"), F.lit("completed").alias("status"), F.lit("{}").alias("manifest")).distinct()
    chunks = both.select("build_id", F.col("doc_id").alias("place"), "chunk_id", F.col("source").alias("document_id"), "text", F.lit(None).cast("string").alias("retrieval_text"))
    vectors = both.select("build_id", "chunk_id", "embedding", F.lit("m1").alias("model"), F.lit("r1").alias("revision"))
    builds.persist_builds(spark, root, own, chunks, vectors)
    again = builds.persist_builds(spark, root, own, chunks, vectors).withColumnRenamed("disposition", "again")
    return builds.read_chunks(spark, root).join(builds.read_embeddings(spark, root).select("build_id", "chunk_id", "dimensions"), ["build_id", "chunk_id"]).join(again, "build_id").select("build_id", "chunk_id", "chunk_index", "content_hash", "dimensions", "again")


@query("""SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dimensions, count(*) OVER () AS verified FROM embeddings""")
def sink_verified_write(t: Tables) -> DataFrame:
    """All vectors, every one of them compared after it was written."""
    root = shared.scratch(t.embeddings.sparkSession, "vectors")
    report = vector_store.write_verified(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("values")), root, "all", "1", sample=None)
    return vector_store.read_vectors(t.embeddings.sparkSession, root, "all").select("id", F.size("values").alias("dimensions"), F.lit(report.verified).cast("long").alias("verified"))


def _json_size(**fields: str) -> str:
    return "1 + " + " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE strlen(CAST(to_json({x}) AS VARCHAR)) + {len(name) + 4} END" for name, x in fields.items())


@query(f"""WITH a AS (SELECT doc_id, text AS p, text AS t, substr(text, 1, 1500) AS q FROM documents), b AS (SELECT *, {_json_size(doc_id="doc_id", parent_text="p", text="t", quote="q")} > 3000 AND p IS NOT NULL AS d FROM a),
c AS (SELECT * EXCLUDE (p), CASE WHEN NOT d THEN p END AS p FROM b), e AS (SELECT *, list_filter(list_transform(range(0, 41), lambda k: CAST(floor(length(c.t) / pow(2, k)) AS BIGINT)), lambda n: n <= 100 OR {_json_size(doc_id="c.doc_id", parent_text="c.p", text="substr(c.t, 1, n)", quote="c.q")} <= 3000)[1] AS n, {_json_size(doc_id="doc_id", parent_text="p", text="t", quote="q")} > 3000 AND length(t) > 100 AS cut FROM c),
f AS (SELECT * EXCLUDE (t), CASE WHEN cut THEN substr(t, 1, n) ELSE t END AS t FROM e), g AS (SELECT *, list_filter(list_transform(range(0, 41), lambda k: CAST(floor(length(f.q) / pow(2, k)) AS BIGINT)), lambda m: m <= 100 OR {_json_size(doc_id="f.doc_id", parent_text="f.p", text="f.t", quote="substr(f.q, 1, m)")} <= 3000)[1] AS m, {_json_size(doc_id="doc_id", parent_text="p", text="t", quote="q")} > 3000 AND length(q) > 100 AS cut_q FROM f)
SELECT doc_id, concat_ws(',', CASE WHEN d THEN 'parent_text' END, CASE WHEN cut THEN 'text' END, CASE WHEN cut_q THEN 'quote' END) AS shed, length(t) AS text_length, CASE WHEN cut_q THEN m ELSE length(q) END AS quote_length FROM g""")
def sink_fit_metadata(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.struct("doc_id", F.col("text").alias("parent_text"), "text", F.substring("text", 1, 1500).alias("quote")).alias("metadata"))
    fitted = vector_store.fit_metadata(rows, "metadata", 3000)
    return fitted.select("doc_id", F.array_join("shed", ",").alias("shed"), F.length("metadata.text").cast("long").alias("text_length"), F.length("metadata.quote").cast("long").alias("quote_length"))


_RECORDS = """r AS (SELECT CAST(l_partkey AS VARCHAR) AS document_id, l_orderkey * 1000 + l_linenumber AS place, CAST(l_suppkey % 3 AS VARCHAR) AS sha, CAST(l_returnflag = 'A' AS INTEGER) AS verified, CASE WHEN l_linenumber = 5 THEN 0 ELSE l_linenumber % 3 / 10 END AS trust, CASE WHEN CAST(l_quantity AS BIGINT) % 5 <> 0 THEN l_shipdate END AS date FROM lineitem)"""


@query(f"""WITH RECURSIVE {_RECORDS}, o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY place, sha, verified, trust, date NULLS FIRST) AS i FROM r),
w AS (SELECT document_id, i, place, place AS kept_place, CAST(NULL AS BIGINT) AS lost_place, CAST(NULL AS VARCHAR) AS rule, sha, verified, trust, date FROM o WHERE i = 1 UNION ALL
  SELECT document_id, i, place, CASE WHEN wins THEN place ELSE kept_place END, CASE WHEN wins THEN kept_place ELSE place END, rule, CASE WHEN wins THEN s2 ELSE s1 END, CASE WHEN wins THEN v2 ELSE v1 END, CASE WHEN wins THEN t2 ELSE t1 END, CASE WHEN wins THEN d2 ELSE d1 END
  FROM (SELECT *, CASE rule WHEN 'verified_status' THEN v2 > v1 WHEN 'source_trust' THEN t2 > t1 WHEN 'newer_verification' THEN true ELSE false END AS wins
    FROM (SELECT o.document_id, o.i, o.place, w.kept_place, w.sha AS s1, w.verified AS v1, w.trust AS t1, w.date AS d1, o.sha AS s2, o.verified AS v2, o.trust AS t2, o.date AS d2,
      CASE WHEN w.sha = o.sha THEN 'identical_content' WHEN w.verified <> o.verified THEN 'verified_status' WHEN w.trust <> o.trust THEN 'source_trust' WHEN o.date IS NOT NULL AND (w.date IS NULL OR o.date > w.date) THEN 'newer_verification' ELSE 'stability' END AS rule
    FROM w JOIN o ON o.document_id = w.document_id AND o.i = w.i + 1)))
SELECT document_id, place, kept_place, lost_place, rule FROM w""")
def tx_conflict(t: Tables) -> DataFrame:
    """Line items as records of their part, lines of an order as sources."""
    n = F.col("l_linenumber")
    records = t.lineitem.select(F.col("l_partkey").cast("string").alias("document_id"), (F.col("l_orderkey") * 1000 + n).alias("place"), (F.col("l_suppkey") % 3).cast("string").alias("sha256"), F.when(F.col("l_returnflag") == "A", "verified").otherwise("unverified").alias("verification_status"), n.cast("string").alias("source_id"), F.when(F.col("l_quantity").cast("long") % 5 != 0, F.col("l_shipdate")).alias("last_verified_at"))
    sources = t.lineitem.select(n.cast("string").alias("source_id"), (n % 3 / 10).alias("trust"), (n != 5).alias("enabled")).distinct()
    return conflicts.folded_records(records, sources)
