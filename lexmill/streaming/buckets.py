"""Minute buckets of requests and trailing sums, for streams and for tables alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.numbers import LATENCY_BOUNDS, latency_bucket


def _histogram(latency: Column) -> list[Column]:
    found = latency_bucket(latency)
    return [F.count_if(found == name).alias(f"le_{name.strip('+').lower()}") for name in (*map(str, LATENCY_BOUNDS), "+Inf")]


def minute_buckets(requests: DataFrame, time: str, error: Column, latency: Column, keys: tuple[str, ...] = (), late: str | None = None, width: str = "1 minute") -> DataFrame:
    """Per minute and key: requests, errors, the latencies' sum and largest, and a histogram.

    On a stream, give `late`: how long after its minute a request may come; a minute's row is final once that has passed. Rows
    without a time go. Sums are combined before the shuffle, so one busy key costs a row per task and minute.
    """
    timed = requests.filter(F.col(time).isNotNull())
    if late:
        timed = timed.withWatermark(time, late)
    figures = [F.count("*").alias("requests"), F.count_if(error).alias("errors"), F.sum(latency).alias("latency_sum"), F.max(latency).alias("latency_max"), *_histogram(latency)]
    out = timed.groupBy(F.window(time, width).alias("w"), *keys).agg(*figures)
    return out.select(F.col("w.start").alias("bucket"), *keys, *[c for c in out.columns if c not in ("w", *keys)])


def trailing(requests: DataFrame, time: str, error: Column, minutes: int, late: str | None = None) -> DataFrame:
    """Per minute, its end named `until`: requests and errors of the minutes up to it, and the share of errors.

    Minutes are summed first, so only minute rows, not requests, enter the sliding windows. On a stream, give `late`.
    """
    timed = requests.filter(F.col(time).isNotNull())
    if late:
        timed = timed.withWatermark(time, late)
    per_minute = timed.groupBy(F.window(time, "1 minute").alias("m")).agg(F.count("*").alias("n"), F.count_if(error).alias("e"))
    slid = per_minute.groupBy(F.window(F.window_time("m"), f"{minutes} minutes", "1 minute").alias("w")).agg(F.sum("n").alias("requests"), F.sum("e").alias("errors"))
    return slid.select(F.col("w.end").alias("until"), "requests", "errors", F.round(F.col("errors") / F.col("requests"), 6).alias("error_rate"))


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Runs of a key's events less than the gap apart: (key, first, until, events); until is the last event's time plus the gap.

    Rows without a time or key go. On a stream, give `late`.
    """
    timed = events.filter(F.col(time).isNotNull() & F.col(key).isNotNull())
    if late:
        timed = timed.withWatermark(time, late)
    out = timed.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("until"), "events")
