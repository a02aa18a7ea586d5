"""Keyed unions, differences and duplicate groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import first_per_key


def union_override(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both; where both have a key, the other's."""
    return base.join(other.select(*keys).distinct(), list(keys), "left_anti").unionByName(other)


def latest_wins(parts: Sequence[DataFrame], keys: Sequence[str], tie: Sequence[Column]) -> DataFrame:
    """A row for each key, from the last part that has it."""
    rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        rows = p if rows is None else rows.unionByName(p)
    return first_per_key(rows, keys, [F.desc("_part"), *tie]).drop("_part")


def differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys of one side alone: (key, side), side missing or unexpected. Null keys take no part."""
    a, b = (x.select(key).where(F.col(key).isNotNull()).distinct() for x in (expected, actual))
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unexpected")))


def duplicate_groups(df: DataFrame, key: Column, id_column: str) -> DataFrame:
    """Groups of two or more rows with one key: (fingerprint, first_id, copies)."""
    groups = df.groupBy(key.alias("fingerprint")).agg(F.min(id_column).alias("first_id"), F.count("*").alias("copies"))
    return groups.filter("copies > 1 and fingerprint is not null")


def integer_gaps(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Numbers between 1 and a key's largest that no row of the key has: (keys, gap). Rows of one number count once."""
    seen = df.select(*keys, F.col(number).alias("gap")).distinct()
    spine = seen.groupBy(*keys).agg(F.max("gap").alias("_most")).select(*keys, F.explode(F.sequence(F.lit(1), F.greatest("_most", F.lit(1)))).alias("gap"))
    return spine.join(seen.filter("gap is not null").withColumn("gap", F.col("gap").cast("int")), [*keys, "gap"], "left_anti")
