"""Whether a release is what may be served, and whether chunks say the truth about where they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a version that serves history must be.
STATUSES = {"publication_status": "published", "source_verification_status": "verified", "legal_review_status": "verified", "ingestion_status": "completed"}


def release_findings(eligible: DataFrame, release: DataFrame, builds: DataFrame, historical: DataFrame, versions: DataFrame, relations: DataFrame, relations_hash: DataFrame, official: Column) -> DataFrame:
    """(finding, name) of all that keeps a release from being consistent; none if it is.

    eligible (document_id, version, version_id) against the release's (document_id, version): not_released, not_eligible,
    other_version. builds (version_id): build_missing for an eligible version. historical (version_id) against versions (version_id,
    STATUSES, and what `official` looks at): historical_missing, historical_unfit. relations_hash (one row, hash): relations_changed
    if it isn't that of relations (source, target, kind). Both maps meet in one full outer join; repeated rows are one.
    """
    own, other = eligible.select("document_id", "version", F.lit(True).alias("e")).distinct(), release.select("document_id", F.col("version").alias("released"), F.lit(True).alias("r")).distinct()
    both = own.join(other, "document_id", "full_outer")
    code = F.when(F.col("r").isNull(), "not_released").when(F.col("e").isNull(), "not_eligible").when(~F.col("version").eqNullSafe(F.col("released")), "other_version")
    row = lambda df, finding, name: df.select((F.lit(finding) if isinstance(finding, str) else finding).alias("finding"), F.col(name).cast("string").alias("name"))
    maps = row(both, code, "document_id").filter("finding is not null")
    unbuilt = row(eligible.select("version_id").distinct().join(builds.select("version_id"), "version_id", "left_anti"), "build_missing", "version_id")
    fit = F.lit(True)
    for column, wanted in STATUSES.items():
        fit = fit & F.coalesce(F.col(column) == wanted, F.lit(False))
    known = versions.groupBy("version_id").agg(F.min(fit & F.coalesce(official, F.lit(False))).alias("fit"))
    past = historical.select("version_id").distinct().join(known, "version_id", "left")
    lost = row(past.filter("fit is null"), "historical_missing", "version_id")
    unfit = row(past.filter("not fit"), "historical_unfit", "version_id")
    now = relations.agg(relation_hash().alias("now")).crossJoin(relations_hash.select("hash").limit(1))
    changed = now.filter("hash <> now").select(F.lit("relations_changed").alias("finding"), F.col("hash").alias("name"))
    return maps.unionByName(unbuilt).unionByName(lost).unionByName(unfit).unionByName(changed).distinct()


def relation_hash() -> Column:
    """An aggregate over relations (source, target, kind): their number and sum of hashes, whatever their order; repeats count."""
    one = F.conv(F.substring(F.md5(F.concat_ws("\x1f", "source", "target", "kind")), 1, 8), 16, 10).cast("decimal(38,0)")
    return F.concat_ws("-", F.count("*").cast("string"), F.coalesce(F.sum(one), F.lit(0).cast("decimal(38,0)")).cast("string"))


#: What every chunk must say of its document, and how it names its form.
SCHEMA_VERSION, DOCUMENT_FIELDS, MAKERS = "chunk-provenance-v1", ("document_type", "document_number", "year", "document_title", "regulation_status", "file_hash"), ("parser_version", "chunker_version", "embedding_model")
OFFSET = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})$"


def content_hash(text: Column) -> Column:
    """SHA-256 of text with its line ends made line feeds and its ends stripped."""
    return F.sha2(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), r"(?U)^\s+|\s+$", ""), 256)


def metadata_hash(metadata: Column) -> Column:
    """SHA-256 of the metadata as JSON, without metadata.chunk.metadata_hash; null fields have no part in it."""
    bare = metadata.withField("chunk", metadata["chunk"].withField("metadata_hash", F.lit(None).cast("string")))
    return F.sha2(F.to_json(bare), 256)


def provenance_issues(chunks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(document_id, chunk_id, place, issues) of chunks whose word about themselves isn't true, every issue named, in this order.

    chunks: document_id, owner (the document that is stored), place (from 0), chunk_id, page_start, page_end, content,
    content_hash, parent_chunk_id, section_path, metadata (document, structure, chunk, ingestion, schema_version). pages:
    (document_id, page); without it the range of pages isn't tested. What refers to other chunks (repeated ids, parents) is found
    by joins within the owner, the rest on the row. Metadata of another form is one issue, and nothing else of it is read.
    """
    m = F.col("metadata")
    said = lambda field, own: ~m[field.split(".")[0]][field.split(".")[1]].eqNullSafe(own)
    blank = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    times = {x: m["ingestion"][x] for x in ("created_at", "updated_at")}
    parsed = {k: F.when(v.rlike(OFFSET), F.try_to_timestamp(F.regexp_replace(v, ",", "."))) for k, v in times.items()}
    own = {
        "document_id": ~F.col("document_id").eqNullSafe(F.col("owner")),
        "page_order": F.col("page_start") > F.col("page_end"),
        "content_hash": ~F.col("content_hash").eqNullSafe(content_hash(F.col("content"))),
    }
    told = {
        "metadata_document_id": said("document.document_id", F.col("owner")),
        **{f"missing_{x}": blank(m["document"][x]) for x in DOCUMENT_FIELDS},
        "source_missing": blank(m["document"]["source_url"]) & blank(m["document"]["source_file"]),
        "file_hash": ~F.coalesce(m["document"]["file_hash"].rlike(r"(?i)^[0-9a-f]{64}\z"), F.lit(False)),
        "metadata_chunk_id": said("chunk.chunk_id", F.col("chunk_id")),
        "chunk_index": said("chunk.chunk_index", F.col("place").cast("int")),
        "metadata_content_hash": said("chunk.content_hash", F.col("content_hash")),
        "metadata_parent": said("chunk.parent_chunk_id", F.col("parent_chunk_id")),
        "metadata_page_start": said("structure.page_start", F.col("page_start")),
        "metadata_page_end": said("structure.page_end", F.col("page_end")),
        "metadata_section_path": said("structure.section_path", F.col("section_path")),
        **{f"missing_{x}": blank(m["ingestion"][x]) for x in MAKERS},
        **{f"{x}_form": parsed[x].isNull() for x in times},
        "updated_before_created": parsed["updated_at"] < parsed["created_at"],
        "metadata_hash": ~m["chunk"]["metadata_hash"].eqNullSafe(metadata_hash(m)),
    }
    list_of = lambda rules: F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))
    known = F.coalesce(m["schema_version"] == SCHEMA_VERSION, F.lit(False))
    inner = F.concat(list_of(own), F.when(known, list_of(told)).otherwise(F.array(F.lit("schema_version"))))
    counted = chunks.groupBy("owner", "chunk_id").agg(F.count("*").alias("_n"))
    parents = counted.select("owner", F.col("chunk_id").alias("parent_chunk_id"), F.lit(True).alias("_parent"))
    rows = chunks.withColumn("_inner", inner).join(counted, ["owner", "chunk_id"], "left").join(parents, ["owner", "parent_chunk_id"], "left")
    outer = {"repeated_chunk_id": F.col("_n") > 1, "unknown_parent": ~blank(F.col("parent_chunk_id")) & F.col("_parent").isNull()}
    if pages is not None:
        some = pages.groupBy("document_id").agg(F.collect_set("page").alias("_pages")).select(F.col("document_id").alias("owner"), "_pages")
        rows = rows.join(some, "owner", "left")
        outer["unknown_page"] = F.col("_pages").isNotNull() & ~(F.array_contains("_pages", F.col("page_start")) & F.array_contains("_pages", F.col("page_end")))
    out = rows.select("document_id", "chunk_id", "place", F.concat(list_of(outer), "_inner").alias("issues"))
    return out.filter(F.size("issues") > 0)
