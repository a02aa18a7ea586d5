"""Builds of documents as stored tables: written once, verified ever after.

Below a root stand chunks/, embeddings/ and builds/, each partitioned by build_id. A build's row in builds/ is written last, so
chunks without one are what a crash has left: nobody reads them, and the next run replaces them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import exists, stored

#: Builds in these states are never written again.
FINAL = ("completed", "review_required")
IDENTITY = ("document_id", "version_id", "source_sha256", "config_hash", "metadata_hash")
BUILD = "build_id string, document_id string, version_id string, source_sha256 string, config_hash string, metadata_hash string, status string, manifest string"
CHUNKS = "chunk_id string, document_id string, chunk_index long, text string, retrieval_text string, content_hash string, build_id string"
EMBEDDINGS = "chunk_id string, embedding array<double>, dimensions int, vector_norm double, model string, revision string, text_hash string, build_id string"


class BuildConflict(ValueError):
    """What was prepared contradicts what is stored, or itself; nothing was written."""


def _read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    path = f"{root}/{name}"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_builds(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "builds", BUILD)


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of builds that were stored to the end."""
    return _read(spark, root, "chunks", CHUNKS).join(read_builds(spark, root).select("build_id"), "build_id", "left_semi")


def read_embeddings(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "embeddings", EMBEDDINGS).join(read_builds(spark, root).select("build_id"), "build_id", "left_semi")


def _write(rows: DataFrame, path: str) -> None:
    """Replaces the partitions that the rows have and no others."""
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("build_id").parquet(path)


def prepared_chunks(chunks: DataFrame) -> DataFrame:
    """Rows (build_id, place, chunk_id, document_id, text, retrieval_text) as CHUNKS: numbered from 0 by place within a build."""
    text = F.coalesce("text", F.lit(""))
    index = F.row_number().over(Window.partitionBy("build_id").orderBy("place", "chunk_id")) - 1
    return chunks.select("chunk_id", "document_id", index.cast("long").alias("chunk_index"), text.alias("text"), F.coalesce(F.nullif("retrieval_text", F.lit("")), text).alias("retrieval_text"), F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256).alias("content_hash"), "build_id")


def prepared_embeddings(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (build_id, chunk_id, embedding, model, revision) as EMBEDDINGS, with the hash of the text that was embedded."""
    hashes = chunks.select("build_id", "chunk_id", F.sha2("retrieval_text", 256).alias("text_hash"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    own = embeddings.select("build_id", "chunk_id", F.col("embedding").cast("array<double>").alias("embedding"), "model", "revision").join(hashes, ["build_id", "chunk_id"], "left")
    return own.select("chunk_id", "embedding", F.size("embedding").alias("dimensions"), norm.alias("vector_norm"), "model", "revision", "text_hash", "build_id")


def _both_ways(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Builds whose rows differ: build_id of what either side has more often."""
    a, b = left.select("build_id", *columns), right.select("build_id", *columns)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("build_id").distinct()


def _named(df: DataFrame, conflict: str) -> DataFrame:
    return df.select("build_id", F.lit(conflict).alias("conflict"))


def build_conflicts(builds: DataFrame, chunks: DataFrame, embeddings: DataFrame, stored_builds: DataFrame, stored_chunks: DataFrame, stored_embeddings: DataFrame) -> DataFrame:
    """(build_id, conflict) of prepared builds that must not be stored. Of all: repeated chunk ids, chunks of another document or
    of no build, a source that belongs to another document, a version with another source, embeddings that aren't the chunks'. Of
    builds that are stored: another identity; of those in a FINAL state also another state, manifest, chunks or embeddings.
    """
    repeated = chunks.groupBy("build_id", "chunk_id").agg(F.count("*").alias("n")).filter("n > 1")
    own = builds.select("build_id", F.col("document_id").alias("owner"))
    foreign = chunks.join(own, "build_id", "left").filter("owner is null or owner <> document_id")
    everything = builds.select(*BUILD_COLUMNS).unionByName(stored_builds.select(*BUILD_COLUMNS))
    sources = everything.groupBy("source_sha256").agg(F.min("document_id").alias("a"), F.max("document_id").alias("b")).filter("a <> b").select("source_sha256")
    versions = everything.groupBy("version_id").agg(F.min("source_sha256").alias("a"), F.max("source_sha256").alias("b")).filter("a <> b").select("version_id")
    pairs = ["build_id", "chunk_id"]
    unmatched = chunks.select(*pairs).distinct().join(embeddings.select(*pairs), pairs, "left_anti").unionByName(embeddings.select(*pairs).distinct().join(chunks.select(*pairs), pairs, "left_anti"))
    before = stored_builds.select("build_id", *[F.col(c).alias(f"old_{c}") for c in BUILD_COLUMNS if c != "build_id"])
    both = builds.join(before, "build_id")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    final = both.filter(F.col("old_status").isin(*FINAL))
    ids = final.select("build_id")
    of_final = lambda df: df.join(ids, "build_id", "left_semi")
    found = [
        _named(repeated, "repeated chunk ids"), _named(foreign, "chunks of another document"), _named(unmatched, "embedding membership"),
        _named(builds.join(sources, "source_sha256", "left_semi"), "source of another document"), _named(builds.join(versions, "version_id", "left_semi"), "version identity"),
        *[_named(both.filter(differs(c)), name) for c, name in (("document_id", "document"), ("version_id", "version"), ("source_sha256", "source identity"), ("config_hash", "pipeline configuration"), ("metadata_hash", "document metadata"))],
        _named(final.filter(differs("status")), "terminal status"), _named(final.filter(differs("manifest")), "artifact manifest"),
        _named(_both_ways(of_final(chunks), of_final(stored_chunks), ["chunk_id", "chunk_index", "content_hash"]), "chunk materialization"),
        _named(_both_ways(of_final(embeddings), of_final(stored_embeddings), ["chunk_id", "model", "revision", "dimensions", "text_hash"]), "embedding materialization"),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


BUILD_COLUMNS = [x.split()[0] for x in BUILD.split(", ")]


def persist_builds(spark: SparkSession, root: str, builds: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Stores builds (BUILD) with their chunks and embeddings (as prepared_* take them); returns (build_id, disposition).

    stored: written and read back; reused: it was there in a FINAL state and equals what was prepared, its files stay untouched.
    Builds in another state are replaced. Any conflict raises BuildConflict for all, before anything is written. Builds of other
    ids are never touched. Repeated runs are safe: only the last step, the row in builds/, makes a build visible.
    """
    builds = stored(builds.select(*BUILD_COLUMNS), "builds")
    chunks = stored(prepared_chunks(chunks), "chunks")
    embeddings = stored(prepared_embeddings(embeddings, chunks), "embeddings")
    before = read_builds(spark, root)
    bad = build_conflicts(builds, chunks, embeddings, before, read_chunks(spark, root), read_embeddings(spark, root)).orderBy("build_id", "conflict")
    first = bad.limit(20).collect()
    if first:
        raise BuildConflict("not stored: " + "; ".join(f"{x.build_id}: {x.conflict}" for x in first))
    reused = before.filter(F.col("status").isin(*FINAL)).select("build_id")
    disposed = stored(builds.select("build_id").join(reused.withColumn("disposition", F.lit("reused")), "build_id", "left").select("build_id", F.coalesce("disposition", F.lit("stored")).alias("disposition")), "dispositions")
    new = disposed.filter("disposition = 'stored'").select("build_id")
    fresh = [df.join(new, "build_id", "left_semi") for df in (chunks, embeddings)]
    for rows, name, schema in ((fresh[0], "chunks", CHUNKS), (fresh[1], "embeddings", EMBEDDINGS)):
        _write(rows, f"{root}/{name}")
        lost = _both_ways(rows, _read(spark, root, name, schema).join(new, "build_id", "left_semi"), [c for c in rows.columns if c != "build_id"])
        if lost.limit(1).count():
            raise RuntimeError(f"{name} read back differ from what was written")
    _write(builds.join(new, "build_id", "left_semi"), f"{root}/builds")
    return disposed
