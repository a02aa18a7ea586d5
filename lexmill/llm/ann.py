"""Nearest neighbours by cosine: a vantage-point tree for each shard of vectors, searched by blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

NEAR = "query_id long, vec_id long, score double"
NEAR_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
LEAF = 256
#: Room for rounding when a bound decides what to skip, and when equal scores are told apart.
SLACK = 1e-9


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors of length one; the largest component goes first, so that no square overflows."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, in one order of sums wherever the rows stand."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


class Tree:
    """A vantage-point tree over unit vectors; leaves of about LEAF points. Nodes are (vantage point, radius, near child, far child)."""

    def __init__(self, unit: np.ndarray) -> None:
        self.unit, self.nodes, self.leaves = unit, [], []
        self.root = self._build(np.arange(len(unit)))

    def _build(self, at: np.ndarray) -> int:
        if len(at) <= LEAF:
            self.leaves.append(at)
            return -len(self.leaves)
        point = self.unit[at[0]]
        apart = np.sqrt(np.maximum(0, 2 - 2 * (self.unit[at] @ point)))
        radius = float(np.median(apart))
        near = apart <= radius
        if near.all() or not near.any():  # all at one distance: halves are as good
            near = np.arange(len(at)) < len(at) // 2
            own = len(self.nodes)
            self.nodes.append(None)
            self.nodes[own] = (None, 0.0, self._build(at[near]), self._build(at[~near]))
            return own
        own = len(self.nodes)
        self.nodes.append(None)
        self.nodes[own] = (point, radius, self._build(at[near]), self._build(at[~near]))
        return own

    def search(self, queries: np.ndarray, k: int, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries and points whose product may be among the k largest: a child is skipped where factor times its least
        distance exceeds the distance of the k-th best so far. Factor 1 skips nothing that counts."""
        best = np.full((len(queries), k), -np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(node: int, who: np.ndarray) -> None:
            if not len(who):
                return
            if node < 0:
                at = self.leaves[-node - 1]
                products = queries[who] @ self.unit[at].T
                merged = np.concatenate([best[who], products], 1)
                best[who] = -np.partition(-merged, k - 1, axis=1)[:, :k]
                q, p = np.nonzero(products >= best[who].min(1)[:, None] - SLACK)
                found.append((who[q], at[p], products[q, p]))
                return
            point, radius, near, far = self.nodes[node]
            if point is None:
                visit(near, who)
                visit(far, who)
                return
            apart = np.sqrt(np.maximum(0, 2 - 2 * (queries[who] @ point)))
            reach = lambda x: np.sqrt(np.maximum(0, 2 - 2 * np.maximum(best[x].min(1), -1))) + SLACK
            inner = apart <= radius
            visit(near, who[inner])
            visit(far, who[~inner])
            visit(far, who[inner][factor * (radius - apart[inner]) <= reach(who[inner])])
            visit(near, who[~inner][factor * (apart[~inner] - radius) <= reach(who[~inner])])

        visit(self.root, np.arange(len(queries)))
        least = best.min(1)
        for who, at, products in found:
            keep = products >= least[who] - SLACK
            yield who[keep], at[keep], products[keep]


def _layer(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries, ids and scores of what may be among the k best of rows that have each id once, in the order of ids."""
    # equal vectors share a point of the tree, which keeps the k + 1 smallest ids: one of them may be the query itself
    _, first, member = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
    by_point = np.argsort(member, kind="stable")
    bounds = np.searchsorted(member[by_point], np.arange(len(first) + 1))
    tree = Tree(_scaled(vectors[first]))
    for i in range(0, len(queries), block):
        part = queries[i : i + block]
        for who, at, _ in tree.search(_scaled(part), k + 1, factor):
            n = np.minimum(bounds[at + 1] - bounds[at], k + 1)
            rows = by_point[np.repeat(bounds[at], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            who, point = np.repeat(who, n), np.repeat(at, n)
            other = ids[rows] != query_ids[i + who]
            who, rows, point = who[other], rows[other], point[other]
            yield query_ids[i + who], ids[rows], cosine(part[who], vectors[first[point]])


def _search(k: int, factor: float, block: int):
    """The k best ids of a shard for each query. An id's first vectors make one tree, its second ones another, and so on: a tree
    has each id once, so its k best points are k ids, and who is among a query's k best ids is so in the tree of its best vector."""

    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        if not shard.num_rows or not asked.num_rows:
            return NEAR_ARROW.empty_table()
        vectors = _matrix(shard["vector"])
        order = np.lexsort((*vectors.T[::-1], shard["vec_id"].to_numpy()))
        ids, vectors = shard["vec_id"].to_numpy()[order], vectors[order]
        once = np.r_[True, (ids[1:] != ids[:-1]) | (vectors[1:] != vectors[:-1]).any(1)]
        ids, vectors = ids[once], vectors[once]
        place = np.arange(len(ids)) - np.searchsorted(ids, ids)
        query_ids, queries = asked["vec_id"].to_numpy(), _matrix(asked["vector"])
        out = [x for layer in range(int(place.max()) + 1) for x in _layer(ids[place == layer], vectors[place == layer], query_ids, queries, k, factor, block)]
        if not out:
            return NEAR_ARROW.empty_table()
        query, vec, score = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((-score, vec, query))
        query, vec, score = query[order], vec[order], score[order]
        best = np.r_[True, (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])] if len(query) else np.zeros(0, bool)
        query, vec, score = query[best], vec[best], score[best]
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < k
        return pa.table([pa.array(query[keep]), pa.array(vec[keep]), pa.array(score[keep])], schema=NEAR_ARROW)

    return run


def valid_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, vector (doubles), of rows with an id whose vector isn't null, empty or zero and has only finite components."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    return rows.filter("vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and x > double('-Infinity') and x < double('Infinity')) and exists(vector, x -> x <> 0)")


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, shard_rows: int = 16384, block: int = 1024, group: int = 8192) -> DataFrame:
    """Of valid_vectors tables: query_id, rank (from 1), vec_id, score (cosine), k rows a query or all candidates if fewer.

    A query's own id is no candidate; vectors of another length are none either. Ties go to the smaller vec_id; of rows that
    repeat an id the one of the largest score counts once. Factor 1 is exact; larger factors skip more. Candidates fall into
    shards of about shard_rows by hash, queries into groups of about `group`; each shard meets each group in a task of its own.
    """
    n, q = candidates.count(), queries.count()
    shards, groups = max(1, -(-n // shard_rows)), max(1, -(-q // group))
    dealt = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    size = F.size("vector").alias("size")
    left = candidates.select("vec_id", "vector", size, dealt("vec_id", shards).alias("shard"), every(groups).alias("group"))
    right = queries.dropDuplicates(["vec_id", "vector"]).select("vec_id", "vector", size, every(shards).alias("shard"), dealt("vec_id", groups).alias("group"))
    by = ["size", "shard", "group"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda a, b: _search(k, factor, block)(a, b), NEAR)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_to_every(embeddings: DataFrame, every: int = 50, k: int = 5, factor: float = 1.0) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by `every`; all other rows are candidates. Rows without an id or a valid
    vector take no part, an empty table gives an empty one; repeated rows count as `nearest` says."""
    rows = stored(valid_vectors(embeddings), "vectors")
    return nearest(rows, rows.filter(F.col("vec_id") % every == 0), k, factor)
