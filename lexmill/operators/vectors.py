"""Operators over arrays of numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 for missing vectors, other lengths and zero vectors."""
    length = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length), F.lit(0.0))


def vector_problem(v: Column, size: int) -> Column:
    """wrong_dimension before anything else, then non_finite, zero_vector; null if there is none."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNull() | (F.size(v) != size), "wrong_dimension").when(bad, "non_finite").when(norm(v) == 0, "zero_vector")


def norm_statistics(df: DataFrame, vector: str, keys: tuple[str, ...] = ()) -> DataFrame:
    n = norm(F.col(vector))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.round(f(n), 6).alias(f"{name}_norm") for name, f in (("mean", F.avg), ("least", F.min), ("most", F.max))))


def _first_of(k: int, names: tuple[str, str, str]):
    """The k best rows of a shard for each query of a group."""
    query_id, row_id, vector = names

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        queries, ids = asked[query_id].to_numpy(), rows[row_id].to_numpy()
        wanted, own = (np.stack(x[vector].combine_chunks().values.to_numpy(zero_copy_only=False).reshape(x.num_rows, -1)) if x.num_rows else np.zeros((0, 0)) for x in (asked, rows))
        out = []
        if len(wanted) and len(own) and wanted.shape[1] == own.shape[1]:
            lengths = np.sqrt((own * own).sum(1))
            order = np.argsort(ids, kind="stable")  # ties go to the smaller id
            own, ids, lengths = own[order], ids[order], lengths[order]
            for q in range(0, len(wanted), 64):
                some = wanted[q : q + 64]
                length = np.sqrt((some * some).sum(1))[:, None] * lengths[None, :]
                score = np.divide(some @ own.T, length, out=np.zeros_like(length), where=length > 0)
                close = np.round(score, 9)
                for i in range(len(some)):
                    if len(ids) > k:
                        least = np.partition(close[i], len(ids) - k)[len(ids) - k]
                        above, ties = np.flatnonzero(close[i] > least), np.flatnonzero(close[i] == least)
                        best = np.r_[above, ties[: k - len(above)]]
                    else:
                        best = np.arange(len(ids))
                    out.append((np.full(len(best), queries[q + i]), ids[best], score[i, best]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=[query_id, row_id, "score"])

    return run


def nearest(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, vector: str, k: int, group: int = 1024, shard: int = 50_000) -> DataFrame:
    """(query_id, row_id, score): candidates that hold each query's k largest cosines over all rows, at most k from each shard.

    Queries are dealt into groups of about `group`, rows into shards of about `shard`, both by a hash of the id and apart by the
    vector's length, and every group meets every shard of its length in a task of its own. Null vectors take no part, zero vectors
    score 0; a null within a vector counts as 0.
    """
    numbers = F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias(vector)
    asked = queries.filter(F.col(query_id).isNotNull() & (F.size(vector) > 0)).select(F.col(query_id).cast("long").alias(query_id), numbers)
    known = rows.filter(F.col(row_id).isNotNull() & (F.size(vector) > 0)).select(F.col(row_id).cast("long").alias(row_id), numbers)
    groups, shards = (max(1, -(-x.count() // each)) for x, each in ((asked, group), (known, shard)))
    parts = lambda df, own, i, n, other, m: df.select("*", F.size(vector).alias("_n"), F.pmod(F.xxhash64(i), F.lit(n)).alias(own)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    keys = ("_n", "_group", "_shard")
    left = parts(asked, "_group", query_id, groups, "_shard", shards).groupBy(*keys)
    right = parts(known, "_shard", row_id, shards, "_group", groups).groupBy(*keys)
    return left.cogroup(right).applyInArrow(_first_of(k, (query_id, row_id, vector)), f"{query_id} long, {row_id} long, score double")
