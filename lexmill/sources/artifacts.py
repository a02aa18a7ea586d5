"""Chunks of documents in folders: document, version and build stand in the path, the newest file counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PATH = r"/documents/([^/]+)/v(\d+)(?:/builds/([^/]+))?/processed/chunks\.json$"
CHUNK = "chunk_id string, document_id string, text string, retrieval_text string, build_id string, chapter string, section string, article string, paragraph string, page_start int, page_end int, token_count int, topics array<string>, legal_status string, source_url string, parent_text string, char_start int, char_end int"
EMBEDDING = "chunk_id string, embedding_model string, embedding array<double>"
METADATA = "title string, year int, number int, regulation_type string, publication_status string, legal_review_status string, verification_status string"


def artifact_files(files: DataFrame) -> DataFrame:
    """Files (path, modified) that are artifacts, as (path, owner, document_id, version, build_id, modified). The path's pattern is
    PATH; a version that is no number makes no artifact. owner: the folder of the version or build.
    """
    part = lambda k: F.regexp_extract("path", PATH, k)
    own = files.filter(F.col("path").rlike(PATH))
    return own.select("path", F.regexp_replace("path", r"/processed/chunks\.json$", "").alias("owner"), part(1).alias("document_id"), part(2).try_cast("int").alias("version"), F.nullif(part(3), F.lit("")).alias("build_id"), "modified").filter("version is not null")


def newest_artifacts(files: DataFrame, versions: DataFrame | None = None, builds: DataFrame | None = None) -> DataFrame:
    """One file of artifact_files for each document: the newest of each (document, version), then of each document.

    With versions (document_id, version) these alone count, all of them. With builds (version_id, build_id), version_id being
    document-vN, a file must be of the build named; a version that isn't named must have no build. Of equally new files those of
    a build, then the later version, then the smaller path win.
    """
    own = files
    if versions is not None:
        own = own.join(versions.select("document_id", "version").distinct(), ["document_id", "version"], "left_semi")
    if builds is not None:
        named = builds.select(F.col("version_id").alias("_v"), F.col("build_id").alias("_b"))
        own = own.join(named, F.concat("document_id", F.lit("-v"), "version") == F.col("_v"), "left").filter(F.col("_b").eqNullSafe(F.col("build_id"))).drop("_v", "_b")
    rank = F.struct(F.lit(0) - F.unix_micros("modified"), F.col("build_id").isNull(), F.lit(0) - F.col("version"), "path")
    newest = lambda *c: [F.max("modified").alias("modified"), F.min_by(F.struct(*c, "path", "owner", "build_id"), rank).alias("f")]
    per_version = own.groupBy("document_id", "version").agg(*newest()).select("document_id", "version", "modified", "f.*")
    if versions is not None:
        return per_version
    return per_version.groupBy("document_id").agg(*newest("version")).select("document_id", "f.version", "modified", "f.path", "f.owner", "f.build_id")


def _read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Rows of all files of this name below the root, each file one JSON value, with its path. Spark lists and reads them."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root).withColumn("path", F.col("_metadata.file_path"))


def list_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """All artifacts below the root with the times of their files; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "chunks.json").load(root)
    return artifact_files(files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified")))


def artifact_counts(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, chunks): the chunks of the newest file of each version, summed over the versions."""
    listed = list_artifacts(spark, root)
    newest = newest_artifacts(listed, versions=listed)
    counted = _read(spark, root, "chunks.json", CHUNK).groupBy("path").agg(F.count("chunk_id").alias("n"))
    return newest.join(counted, "path", "left").groupBy("document_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


def _or(column: str, other: Column) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), other)


def read_artifacts(spark: SparkSession, root: str, versions: DataFrame | None = None, builds: DataFrame | None = None) -> DataFrame:
    """The chunks of newest_artifacts with their embeddings and their document's metadata, as documents for retrieval.

    embeddings.json stands beside chunks.json, metadata/document.json beside processed/; either may be missing. Missing values:
    retrieval_text is the text, the build that of the path, the law's status needs_verification, publication published, review verified, places in the text 0.
    """
    files = newest_artifacts(list_artifacts(spark, root), versions, builds)
    chosen = files.select("path", "owner", F.col("document_id").alias("path_document"), "version", F.col("build_id").alias("path_build"))
    chunks = _read(spark, root, "chunks.json", CHUNK).join(chosen, "path").drop("path")
    folder = lambda df, tail: df.withColumn("owner", F.regexp_replace("path", tail, "")).drop("path")
    embedded = folder(_read(spark, root, "embeddings.json", EMBEDDING), r"/processed/embeddings\.json$").dropDuplicates(["owner", "chunk_id"])
    described = folder(_read(spark, root, "document.json", METADATA), r"/metadata/document\.json$").select("owner", F.struct("title", "year", "number", "regulation_type").alias("metadata"), "publication_status", "legal_review_status", "verification_status")
    rows = chunks.join(embedded, ["owner", "chunk_id"], "left").join(described, "owner", "left")
    return rows.select(
        "chunk_id", "document_id", "text", _or("retrieval_text", F.col("text")).alias("retrieval_text"), F.coalesce("path_build", "build_id").alias("build_id"), "chapter", "section", "article", "paragraph", "page_start", "page_end", "token_count",
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), F.coalesce("legal_status", F.lit("needs_verification")).alias("legal_status"), F.coalesce("source_url", F.lit("")).alias("source_url"), "embedding_model", "embedding", "metadata",
        F.col("version").alias("document_version"), F.coalesce("publication_status", F.lit("published")).alias("publication_status"), F.coalesce("legal_review_status", "verification_status", F.lit("verified")).alias("verification_status"),
        F.lit(True).alias("is_current"), "parent_text", F.coalesce("char_start", F.lit(0)).alias("char_start"), F.coalesce("char_end", F.lit(0)).alias("char_end"),
    )
