"""Alert rules over trailing minutes, for every minute that has something to look back on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.numbers import latency_bucket

from .measures import histogram_percentile

#: The rules' names, severities, minutes looked back on, and thresholds.
RULES = {"error_rate_high": ("critical", 5, 0.05), "p95_latency_high": ("warning", 10, 3000.0), "service_down": ("critical", 10, None), "repeated_timeouts": ("warning", 15, 3), "rate_limit_spike": ("warning", 15, 20)}


def _looked_back_on(minutes: DataFrame, most: int) -> DataFrame:
    """Rows of minutes at each of the `most` moments (as_of, ends of minutes) that look back on them; back: how far."""
    after = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("back")
    rows = minutes.select("*", after)
    return rows.withColumn("as_of", F.timestamp_seconds(F.unix_seconds("minute") + 60 * F.col("back")))


def active_alerts(requests: DataFrame, time: str, error: Column, latency: Column, timeout: Column, limited: Column, probes: DataFrame, rules: dict[str, tuple] = RULES) -> DataFrame:
    """(as_of, rule, severity, subject) of what is alarming at each moment: more than 5 % errors of the last 5 minutes, a p95 of
    more than 3000 ms in the last 10 by the buckets' middles, a service with a probe (time, service, status) that was down in the
    last 10, 3 timeouts or 20 limited requests in the last 15. subject: the service, else null.

    Requests are summed by minute first; only minute rows look ahead to the moments that see them, so no window spans all time.
    Rows without a time go; a moment without requests has no error rate and no p95.
    """
    minute = lambda c: F.date_trunc("minute", F.col(c).cast("timestamp")).alias("minute")
    timed = requests.filter(F.col(time).isNotNull())
    summed = timed.groupBy(minute(time)).agg(F.count("*").alias("n"), F.count_if(error).alias("errors"), F.count_if(timeout).alias("timeouts"), F.count_if(limited).alias("limited"))
    within = lambda rule, c: F.sum(F.when(F.col("back") <= rules[rule][1], F.col(c)).otherwise(0))
    most = max(rules[x][1] for x in ("error_rate_high", "repeated_timeouts", "rate_limit_spike"))
    seen = _looked_back_on(summed, most).groupBy("as_of").agg(within("error_rate_high", "n").alias("n"), within("error_rate_high", "errors").alias("errors"), within("repeated_timeouts", "timeouts").alias("timeouts"), within("rate_limit_spike", "limited").alias("limited"))
    hits = {"error_rate_high": F.try_divide(F.col("errors").cast("double"), F.col("n").cast("double")) > rules["error_rate_high"][2], "repeated_timeouts": F.col("timeouts") >= rules["repeated_timeouts"][2], "rate_limit_spike": F.col("limited") >= rules["rate_limit_spike"][2]}
    counted = seen.select("as_of", F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in hits.items()]))).alias("rule"), F.lit(None).cast("string").alias("subject"))
    buckets = timed.filter(latency.isNotNull()).groupBy(minute(time), latency_bucket(latency).alias("bucket")).agg(F.count("*").alias("count"))
    slow = histogram_percentile(_looked_back_on(buckets, rules["p95_latency_high"][1]), ["as_of"], 0.95, "p95").filter(F.col("p95") > rules["p95_latency_high"][2]).select("as_of", F.lit("p95_latency_high").alias("rule"), F.lit(None).cast("string").alias("subject"))
    down = probes.filter("status = 'down' and time is not null").select(minute("time"), F.col("service").cast("string").alias("subject")).distinct()
    services = _looked_back_on(down, rules["service_down"][1]).select("as_of", F.lit("service_down").alias("rule"), "subject").distinct()
    severity = F.coalesce(*[F.when(F.col("rule") == k, F.lit(v[0])) for k, v in rules.items()])
    return counted.unionByName(slow).unionByName(services).select("as_of", "rule", severity.alias("severity"), "subject")
