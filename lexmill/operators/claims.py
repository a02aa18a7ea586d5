"""Claims of answers against the passages that they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.claims import allowed, content_words, numbers, support


def verified(claims: DataFrame, citations: DataFrame, keys: list[str], least: float = 0.35, relink_from: float = 0.65) -> DataFrame:
    """Each claim (keys, claim_id, claim, cited) with the passage that supports it best.

    citations: keys, citation_id and quote. A claim is supported if its cited passage has `least` of its words and all its numbers
    and qualifiers; if not, the first passage of the same keys that has the most words, `relink_from` at least and more than the
    cited one, takes its place. A claim that cites nothing known is unsupported unless such a passage is found. Words are made
    once for each passage; a claim meets only passages of its own answer.
    """
    said = claims.withColumn("words", content_words(F.col("claim"))).withColumn("said", numbers(F.col("claim")))
    shown = citations.select(*keys, "citation_id", content_words(F.col("quote")).alias("has"), numbers(F.col("quote")).alias("known"))
    met = said.join(shown, keys, "left")
    has, known = F.coalesce("has", F.array().cast("array<string>")), F.coalesce("known", F.array().cast("array<string>"))
    met = met.withColumn("score", support(F.col("words"), has)).withColumn("ok", allowed(F.col("words"), F.col("said"), has, known))
    own = F.max(F.when(F.col("citation_id") == F.col("cited"), F.struct("score", "ok", "citation_id")))
    able = F.when(F.col("ok") & (F.col("score") >= relink_from) & F.col("citation_id").isNotNull(), F.struct("score", (-F.col("citation_id")).alias("minus")))
    seen = met.groupBy(*keys, "claim_id").agg(F.first("claim").alias("claim"), own.alias("own"), F.max(able).alias("best"))
    score = F.coalesce("own.score", F.lit(0.0))
    stands = F.coalesce(F.col("own.ok") & (score >= least), F.lit(False))
    moved = ~stands & F.coalesce(F.col("best.score") > score, F.lit(False))
    out = seen.withColumn("moved", moved).withColumn("supported", stands | moved)
    cited = F.when(F.col("moved"), -F.col("best.minus")).otherwise(F.col("own.citation_id"))
    return out.select(*keys, "claim_id", "claim", cited.alias("cited"), "moved", "supported", F.round(F.when(F.col("moved"), F.col("best.score")).otherwise(score), 4).alias("support_score"))


def faithfulness(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Per answer: the mean support of its claims, unsupported ones as 0, and the share of unsupported ones."""
    held = F.when(F.col("supported"), F.col("support_score")).otherwise(0.0)
    return claims.groupBy(*keys).agg(F.count("*").alias("claims"), F.round(F.avg(held), 6).alias("faithfulness"), F.round(F.avg((~F.col("supported")).cast("double")), 6).alias("unsupported_rate"))


def coverage(answers: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """Per answer (keys, answer): the share of its content words that some claim (keys, claim) has, supported or not; 0 without
    words or claims. Answers and claims meet word by word, within their keys."""
    said = answers.select(*keys, F.explode_outer(F.array_distinct(content_words(F.col("answer")))).alias("word"))
    told = claims.select(*keys, F.explode(content_words(F.col("claim"))).alias("word")).distinct().withColumn("told", F.lit(1))
    met = said.join(told, [*keys, "word"], "left")
    return met.groupBy(*keys).agg(F.coalesce(F.round(F.count("told") / F.nullif(F.count("word"), F.lit(0)), 4), F.lit(0.0)).alias("coverage"))
