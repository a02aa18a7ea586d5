"""The registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_to_every
from .fill_in_middle import fill_in_middle, restored
from .filter_audit import filter_audit
from .jaccard_join import jaccard_components
from .language_id import identified
from .line_dedup import line_dedup
from .mixing import measured, mix_sources
from .packing import best_fit_packing, document_pieces
from .progressive_jpeg import media_digests
from .substring_dedup import substring_dedup
from .tables import stored
from .token_counts import token_counts
from .token_files import token_file_digests
from .toxicity import toxicity


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The tokenizer file of the queries; the operators take any."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(_table(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(measured(_table(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(_table(spark, sf_dir), vocabulary())


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_to_every(_table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(_table(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = stored(document_pieces(_table(spark, sf_dir), vocabulary()), "pieces")
    return best_fit_packing(pieces)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir))
    again = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), again.alias("restored_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir), vocabulary("word_bpe_49k.json"))


QUERIES = (op1_line_dedup, op2_substring_dedup, op3_progressive_jpeg, op4_toxicity, op5_jaccard_join, op6_mixing, op7_token_files, op8_nearest, op9_language_id, op10_best_fit_packing, op11_fill_in_middle, op12_filter_audit, op13_token_counts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return dict(ORACLES)
