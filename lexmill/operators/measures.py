"""Aggregations of observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.numbers import LATENCY_BOUNDS, bucket_midpoint, latency_bucket, ratio


def percentiles(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles, count and sum for each key. Null values take no part."""
    return df.groupBy(*keys).agg(*(F.round(F.expr(f"percentile({value}, {q})"), 6).alias(name) for name, q in at.items()), F.count(value).alias("n"), F.round(F.sum(value), 4).alias("total"))


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Percentiles that are values of the data."""
    return df.groupBy(*keys).agg(*(F.expr(f"percentile_disc({q}) within group (order by {value})").alias(name) for name, q in at.items()), F.count(value).alias("n"))


def histogram(df: DataFrame, keys: Sequence[str], value: Column, bounds: tuple[int, ...] = LATENCY_BOUNDS) -> DataFrame:
    """Counts by closed upper bound: (keys, bucket, count)."""
    return df.filter(value.isNotNull()).groupBy(*keys, latency_bucket(value, bounds).alias("bucket")).agg(F.count("*").alias("count"))


def histogram_percentile(buckets: DataFrame, keys: Sequence[str], q: float, name: str, bounds: tuple[int, ...] = LATENCY_BOUNDS) -> DataFrame:
    """The middle of the bucket that the rank ceil(q n) falls into, one decimal."""
    middle = bucket_midpoint(F.col("bucket"), bounds)
    merged = buckets.groupBy(*keys, middle.alias("_middle")).agg(F.sum("count").alias("_n"))
    running = merged.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_middle"))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    reached = running.filter(F.col("_upto") >= F.greatest(F.lit(1), F.ceil(F.col("_all") * q)))
    return reached.groupBy(*keys).agg(F.round(F.min("_middle"), 1).alias(name))


def minute_buckets(df: DataFrame, time: str, keys: Sequence[str], failed: Column, latency: Column) -> DataFrame:
    """Per minute and key: count, error_count and the latency sum."""
    return df.groupBy(F.date_trunc("minute", time).alias("minute"), *keys).agg(F.count("*").alias("count"), F.sum(failed.cast("int")).alias("error_count"), F.round(F.sum(latency), 4).alias("sum_latency"))


def daily_series(facts: DataFrame, days: DataFrame, time: str, measures: dict[str, Column]) -> DataFrame:
    """A row for each day of `days` (one row: first_day, last_day), zero where nothing happened."""
    spine = days.select(F.explode(F.sequence("first_day", "last_day")).alias("day"))
    grouped = facts.groupBy(F.to_date(time).alias("day")).agg(*(c.alias(name) for name, c in measures.items()))
    return spine.join(grouped, "day", "left").select("day", *(F.coalesce(F.col(name), F.lit(0)).alias(name) for name in measures))


def rates_by(df: DataFrame, keys: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Count of rows and the share of each flag, null flags counting as false."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(ratio(F.count_if(c), F.count("*")).alias(name) for name, c in flags.items()))


def best_threshold(scored: DataFrame) -> DataFrame:
    """The threshold (a score, 0 or 1) that tells best which rows (score, below) are below it, the largest of the best, and its
    accuracy; no row for no rows. Scores are summed in at most 4,097 bins, then within them."""
    ends = scored.limit(1).select(F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("score"), F.lit(0).alias("n"), F.lit(False).alias("below"))  # thresholds that may be no score
    scores = scored.withColumn("n", F.lit(1)).unionByName(ends)
    groups = scores.groupBy("score").agg(F.sum("n").alias("n"), F.count_if(F.col("below") & (F.col("n") == 1)).alias("bad"))  # different scores of a labelled set
    groups = groups.withColumn("bin", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")) * 4096))
    bins = groups.groupBy("bin").agg(F.sum("bad").alias("b"), F.sum(F.col("n") - F.col("bad")).alias("g"))  # 4,097 rows at most, however many scores
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    whole = bins.select("bin", (F.coalesce(F.sum("b").over(earlier), F.lit(0)) + F.coalesce(F.sum("g").over(later), F.lit(0))).alias("others"), F.sum(F.col("b") + F.col("g")).over(Window.partitionBy()).alias("every"))
    below = Window.partitionBy("bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("bin").orderBy("score").rowsBetween(0, Window.unboundedFollowing)
    correct = F.col("others") + F.coalesce(F.sum("bad").over(below), F.lit(0)) + F.coalesce(F.sum(F.col("n") - F.col("bad")).over(above), F.lit(0))
    rows = groups.join(whole, "bin").select(F.col("score").alias("threshold"), correct.alias("correct"), "every")
    return rows.orderBy(F.desc("correct"), F.desc("threshold")).limit(1).select("threshold", F.round(F.col("correct") / F.col("every"), 6).alias("accuracy"))
