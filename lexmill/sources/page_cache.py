"""Results that are kept by content and profile: what was done once is read, what is new is done."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists, stored


@dataclass(frozen=True)
class CacheReport:
    asked: int
    reused: int
    computed: int


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def cached(work: DataFrame, path: str, keys: tuple[str, ...], compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, CacheReport]:
    """compute(work) for all keys of `work`, and how many of them were new: rows of keys done before come from the path.

    compute is given one row for each new key and returns rows with the key columns; a key may have none, one or many. Below the
    path rows/ holds results and done/ the keys, written last: rows of keys that aren't done are what a crash left, and are left
    out. Keys with a null are neither asked nor kept. The result is read back, so it doesn't depend on what was computed when.
    """
    spark, names = work.sparkSession, list(keys)
    asked = stored(work.dropna(subset=names).dropDuplicates(names), "work")
    done = _read(spark, f"{path}/done")
    todo = stored(asked if done is None else asked.join(done.select(*names), names, "left_anti"), "todo")
    n, new = asked.count(), todo.count()
    if new:
        batch = F.lit((0 if done is None else done.agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0]) + 1).cast("long")
        target = f"{path}/rows"
        made = compute(todo)
        attempt = F.expr("uuid()")  # of a batch that a crash cut short, only the attempt that ended is named in done/
        name = spark.range(1).select(attempt.alias("x")).first().x
        made.withColumn("_attempt", F.lit(name)).write.mode("append").parquet(target)
        todo.select(*names).withColumn("batch", batch).withColumn("_attempt", F.lit(name)).write.mode("append").parquet(f"{path}/done")
    rows, done = _read(spark, f"{path}/rows"), _read(spark, f"{path}/done")
    if rows is None:
        made = compute(todo)
        return made, CacheReport(n, 0, 0)
    valid = rows.join(done.select(*names, "_attempt").distinct(), [*names, "_attempt"], "left_semi").drop("_attempt")
    return valid.join(asked.select(*names), names, "left_semi"), CacheReport(n, n - new, new)


def repair_list(pages: DataFrame, score: Column, flags: Column, requested: DataFrame | None = None, least: float = 0.65) -> DataFrame:
    """(document_id, page) of pages (document_id, page, ...) to be read again: unreadable ones, ones with replacement marks, and the
    requested. Requested pages that aren't there are an error, raised when the list is read.
    """
    poor = pages.filter((score < least) | F.array_contains(flags, "replacement_glyphs")).select("document_id", "page")
    if requested is None:
        return poor.distinct()
    known = pages.select("document_id", "page", F.lit(True).alias("_there")).distinct()
    checked = requested.select("document_id", "page").distinct().join(known, ["document_id", "page"], "left")
    there = checked.filter(F.when(F.col("_there"), F.lit(True)).otherwise(F.raise_error(F.format_string("page %s of %s is outside the document", F.col("page").cast("string"), F.col("document_id").cast("string"))).cast("boolean")))
    return poor.unionByName(there.select("document_id", "page")).distinct()
