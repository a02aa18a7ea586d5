"""Joins to the newest, to names and to neighbours; sets of rows; states of jobs and requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.words import tokens


def children_of_newest(parents: DataFrame, children: DataFrame, keys: Sequence[str], newest: Sequence[str], parent_id: str) -> DataFrame:
    """Per key: its newest parent and how many children that has. Only ids of newest parents meet the children."""
    last = parents.groupBy(*keys).agg(F.max_by(parent_id, F.struct(*newest)).alias(parent_id))
    counted = children.groupBy(parent_id).agg(F.count("*").alias("n"))
    return last.join(counted, parent_id, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def adjacency(edges: DataFrame, node: str, neighbour: str, order: Sequence[str]) -> DataFrame:
    """Per node: its different neighbours in order of first appearance. Each neighbour comes once to the list, by its first place."""
    first = edges.groupBy(node, neighbour).agg(F.min(F.struct(*order)).alias("_at"))
    return first.groupBy(node).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", neighbour))), lambda x: x[neighbour]).alias("neighbours"))


def snapshot_hash(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key: a hash of its rows that doesn't depend on their order. Rows are written as text, sorted and hashed."""
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("hash"))


def named_page(page: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of one page (already limited) with the name of their key, null if there is none."""
    return page.join(names.select(key, name), key, "left")


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], id_column: str, same: str) -> DataFrame:
    """Each row with the rows before and after it within its keys, where they have the same non-null `same`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    other = lambda f: F.when(f(same).over(w) == F.col(same), f(id_column).over(w))
    return df.select(id_column, other(F.lag).alias("previous"), other(F.lead).alias("following"))


def unresumed(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that no checkpoint holds under the same keys (id, model, revision, hash of the text)."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def replays(requests: DataFrame, keys: Sequence[str], order: Sequence[str], fingerprint: str) -> DataFrame:
    """Requests of one key: the first runs, later ones replay it if their fingerprint is its, or else conflict."""
    first = requests.groupBy(*keys).agg(F.min(F.struct(*order, F.col(fingerprint).alias("_f"))).alias("_first"))
    own = F.struct(*order)
    rows = requests.join(first, list(keys))
    is_first = own == F.struct(*(F.col(f"_first.{c}") for c in order))
    return rows.withColumn("outcome", F.when(is_first, "run").when(F.col(fingerprint).eqNullSafe(F.col("_first._f")), "replay").otherwise("conflict")).drop("_first")


def error_class(status: Column, code: Column) -> Column:
    """Class of a request's outcome from its status and error code; the first that fits."""
    text = F.lower(F.coalesce(code, F.lit("")))
    client = F.when(status.isin(401, 403), "auth").when(status.isin(400, 404, 422), "validation").otherwise("client")
    named = F.when(text.contains("timeout"), "timeout").when((status == 429) | text.contains("rate_limit"), "rate_limited").when((status == 503) & text.contains("rag_"), "provider")
    return named.when(status.isNull(), "unknown").when((status >= 400) & (status < 500), client).when(status >= 500, "server").otherwise("ok")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of the token sets of two texts; 0 if both are empty."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    every = F.size(F.array_union(x, y))
    return F.when(every > 0, F.size(F.array_intersect(x, y)) / every).otherwise(0.0)


def sparse_vector(text: Column) -> Column:
    """Map of token index (first four bytes of its SHA-256) to weight 1 + ln(1 + tf), of unit length; of tokens of one index the
    last in the text stays.
    """
    words = tokens(text)
    terms = F.array_distinct(words)
    index = lambda t: F.conv(F.substring(F.sha2(t, 256), 1, 8), 16, 10).cast("long")
    weight = lambda t: 1 + F.log1p(F.size(F.filter(words, lambda w: w == t)).cast("double"))
    pairs = F.transform(terms, lambda t: F.struct(index(t).alias("i"), weight(t).alias("w")))
    length = F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["w"] * p["w"]))
    return F.transform(pairs, lambda p: F.struct(p["i"].alias("i"), (p["w"] / length).alias("w")))


def corruption_rate(text: Column) -> Column:
    """Share of replacement characters and control, format, surrogate, private or unassigned ones, but for line feed and tab."""
    bad = F.regexp_count(text, F.lit(r"[\x{FFFD}\p{C}&&[^\n\t]]"))
    return F.round(F.when(F.length(text) > 0, bad / F.length(text)).otherwise(0.0), 6)


def text_kind(text: Column, images: Column, least: int = 40) -> Column:
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) >= least, "text").when(images > 0, "scanned").otherwise("empty")
