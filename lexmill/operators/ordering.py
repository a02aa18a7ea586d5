"""Rows chosen by rank within a key, or while a running budget lasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key in this order; `rank` names a column for their place from 1.

    The order should tell all rows of a key apart. Rows beyond n leave before the shuffle (Spark's group limit).
    """
    out = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, start: int = 1) -> DataFrame:
    """Rows numbered within each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + (start - 1))


def while_budget_lasts(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cost: Column, budget: float) -> DataFrame:
    """Rows in order up to the first at which the running cost exceeds the budget; that one and all later ones go."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_sum", F.sum(cost).over(w)).withColumn("_over", F.max((F.col("_sum") > budget).cast("int")).over(w)).filter("_over = 0").drop("_sum", "_over")


def capped(df: DataFrame, caps: Sequence[tuple[Sequence[str], int]], order: Sequence[Column]) -> DataFrame:
    """At most n rows for each of several keys, one after the other: what an earlier cap refuses does not count for a later one."""
    out = df
    for keys, n in caps:
        out = first_per_key(out, keys, order, n)
    return out


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """One page; the limit is held between 1 and `most`, a negative offset is 0."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))
