"""The corpus pipeline: each stage works on all that the one before it kept, and its decisions take effect.

Stages take (spark, docs, sf_dir) and return the columns of documents; the last returns the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.jaccard_join import jaccard_components
from lexmill.llm.language_id import UNKNOWN, identify_language, language_model
from lexmill.llm.line_dedup import line_dedup
from lexmill.llm.mixing import measured, mix_sources
from lexmill.llm.packing import best_fit_packing, document_pieces
from lexmill.llm.queries import vocabulary
from lexmill.llm.slots import has_slot, slots_of
from lexmill.llm.tables import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language has a posterior below one half, go; lang becomes the language found."""
    found = identify_language(docs, language_model(docs), keep=("doc_id", "text", "source", "n_chars"))
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= 0.5))
    return kept.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, exact copies of short ones too, and documents that have lost all their words so; n_chars follows."""
    found = line_dedup(docs, keep=("lang", "source"))
    kept = found.filter((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    found = stored(jaccard_components(docs).filter("doc_id <> component_id").select("doc_id").distinct(), "later")
    may_go = has_slot("doc_id", slots_of(found, "doc_id"))
    docs = docs.select(*COLUMNS)
    return docs.filter(~may_go).unionByName(docs.filter(may_go).join(found, "doc_id", "left_anti"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them, rows equal in all alike; those it doesn't take go."""
    mixed = mix_sources(measured(docs)).filter("taken > 0")
    times = mixed.groupBy(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("digest").alias("x")).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("times"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.xxhash64("text") == F.col("x"))
    return docs.join(times, same).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of at most 1024 tokens."""
    return best_fit_packing(stored(document_pieces(docs, vocabulary()), "pieces"))


STAGES = [("language_id", language), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("mixing", mixing), ("best_fit_packing", packing)]

#: Hashing, sampling keys and greedy packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
