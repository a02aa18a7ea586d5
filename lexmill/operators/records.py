"""Which records may be taken in: chunks, files, and versions that may be served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First bytes of a file, the shortest text that counts as embedded, and statuses in force.
MAGIC, SHORTEST, IN_FORCE = b"%PDF-", 40, ("active", "amended")


def chunk_reasons(chunks: DataFrame, order: str, verify: bool = True) -> DataFrame:
    """Chunks (chunk_id, content, content_hash, ...) with `reason`, why each is skipped (null: it is taken): empty_id,
    duplicate_id (an earlier chunk of this id was taken), empty_text, content_hash_mismatch (if a hash is given).

    What is wrong with a chunk itself comes first but for a duplicate: of one id the first sound chunk is taken, later ones are
    duplicates whatever is wrong with them, earlier ones name their own fault.
    """
    blank = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")) == ""
    id_, content, given = F.col("chunk_id"), F.col("content"), F.col("content_hash")
    wrong_hash = F.lit(verify) & (F.coalesce(given, F.lit("")) != "") & (given != F.sha2(content, 256))
    own = F.when(blank(id_), "empty_id").when(blank(content), "empty_text").when(wrong_hash, "content_hash_mismatch")
    rows = chunks.withColumn("_own", own)
    taken = F.min(F.when(F.col("_own").isNull(), F.col(order))).over(Window.partitionBy("chunk_id"))
    rows = rows.withColumn("_taken", F.when(~blank(id_), taken))
    return rows.withColumn("reason", F.when(F.col("_taken") < F.col(order), "duplicate_id").otherwise(F.col("_own"))).drop("_own", "_taken")


def file_verdict(name: Column, head: Column, size: Column, encrypted: Column, pages: Column, characters: Column) -> Column:
    """(eligible, code) of a file: not_a_pdf by its name, bad_magic by its first bytes, empty_file, encrypted, no_pages, which all
    shut it out, or no_embedded_text, which doesn't; the first that holds. Unknown pages and characters count as none."""
    fatal = F.when(~F.lower(F.coalesce(name, F.lit(""))).endswith(".pdf"), "not_a_pdf").when(~F.coalesce(F.substring(head, 1, len(MAGIC)) == F.lit(MAGIC), F.lit(False)), "bad_magic").when(F.coalesce(size, F.lit(0)) == 0, "empty_file").when(F.coalesce(encrypted, F.lit(False)), "encrypted").when(F.coalesce(pages, F.lit(0)) == 0, "no_pages")
    return F.struct(fatal.isNull().alias("eligible"), F.coalesce(fatal, F.when(F.coalesce(characters, F.lit(0)) < SHORTEST, "no_embedded_text")).alias("code"))


def official_host(url: Column, domain: str = "go.id") -> Column:
    """Whether an https address lies on the domain or below it, whatever user, port or letter case it names. Null: no."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^https://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return (host == domain) | host.endswith(f".{domain}")


def servable(version: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions that may be served, and one row (total, skipped). A version must be current, published, verified at its source and
    by review, completely taken in, of a status in force and of an official address; null is none of these."""
    fit = F.lit(True)
    for column, wanted in (("publication_status", "published"), ("source_verification_status", "verified"), ("legal_review_status", "verified"), ("ingestion_status", "completed")):
        fit = fit & F.coalesce(F.col(column) == wanted, F.lit(False))
    fit = fit & F.coalesce(F.col("legal_status").isin(*IN_FORCE), F.lit(False)) & official_host(F.col("source_url")) & F.coalesce(F.col("is_current"), F.lit(False))
    return version.filter(fit), version.agg(F.count("*").alias("total"), F.count_if(~fit).alias("skipped"))
