"""Vectors in namespaces of a folder: batches are verified after they are written, deletions keep a copy of the ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists, on_disk

#: Bytes of metadata that a record may have, what is dropped first, what is cut next.
LIMIT, DROPPED, CUT, SHORTEST = 40_960, ("parent_text", "parent_context", "debug"), ("text", "retrieval_text", "quote"), 100


@dataclass(frozen=True)
class WriteReport:
    upserted: int
    verified: int
    worst_cosine: float
    rolled_back: bool


@dataclass(frozen=True)
class Clearance:
    namespace: str
    vectors: int
    sample_ids: tuple
    confirmed: bool
    backup: str | None = None


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a vector is zero, null where lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(size > 0, dot / size).otherwise(0.0))


def _place(root: str, namespace: str) -> str:
    return f"{root}/namespace={namespace}"


def read_vectors(spark: SparkSession, root: str, namespace: str) -> DataFrame:
    """All vectors of a namespace; of an id that several batches hold, the one of the last batch (in the order of their names)."""
    rows = spark.read.parquet(_place(root, namespace))
    last = rows.groupBy("id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["id", "batch"], "left_semi")


def write_verified(vectors: DataFrame, root: str, namespace: str, batch: str, sample: int | None = 5, least: float = 0.99, read: Callable[[str], DataFrame] | None = None) -> WriteReport:
    """Writes vectors (id, values, ...) as a batch, reads them back and takes the batch away again if they aren't what was sent.

    Checked are the number of rows and, of the `sample` smallest ids (None: of all), that each is there once with a cosine of at
    least `least` to what was sent. A batch of that name must not exist. Repeated and null ids are an error, nothing is written.
    read: how the written path is read, for stores that are slow to show what they hold.
    """
    spark = vectors.sparkSession
    path = f"{_place(root, namespace)}/batch={batch}"
    if exists(spark, path):
        raise ValueError(f"batch {batch} exists")
    wrong = vectors.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").limit(5).collect()
    if wrong:
        raise ValueError("repeated or null ids: " + ", ".join(str(x.id) for x in wrong))
    vectors.write.parquet(path)
    sent = vectors.select("id", F.col("values").alias("_sent"))
    if sample is not None:
        sent = sent.orderBy("id").limit(max(1, sample))
    back = (read or spark.read.parquet)(path)
    held = back.select("id", F.col("values").alias("_held"))
    seen = sent.join(held, "id", "left").select("id", F.coalesce(cosine(F.col("_sent"), F.col("_held")), F.lit(-1.0)).alias("c"))
    checked = seen.agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.min("c").alias("worst")).first()
    n, m = vectors.count(), back.count()
    if n == m and checked.n == checked.d and (checked.worst is None or checked.worst >= least):
        return WriteReport(n, checked.n, round(1.0 if checked.worst is None else checked.worst, 4), False)
    _delete(spark, path)
    return WriteReport(n, 0, 0.0, True)


def _delete(spark: SparkSession, path: str) -> None:
    place, files = on_disk(spark, path)
    files.delete(place, True)


def clear_namespace(spark: SparkSession, root: str, namespace: str, backup: str | None = None, confirm: bool = False) -> Clearance:
    """What a namespace holds; with confirm it is deleted, after its ids were written to the path `backup`, which must be new."""
    path = _place(root, namespace)
    if not exists(spark, path):
        return Clearance(namespace, 0, (), confirm)
    ids = read_vectors(spark, root, namespace).select("id")
    count, some = ids.count(), tuple(r.id for r in ids.orderBy("id").limit(5).collect())
    if not confirm:
        return Clearance(namespace, count, some, False)
    if backup is None:
        raise ValueError("a confirmed deletion needs a path for the ids")
    ids.write.parquet(backup)
    if spark.read.parquet(backup).count() != count:
        raise RuntimeError("the copy of the ids is not whole; nothing was deleted")
    _delete(spark, path)
    return Clearance(namespace, count, some, True, backup)


def fit_metadata(rows: DataFrame, column: str, limit: int = LIMIT) -> DataFrame:
    """Rows whose struct `column` has at most `limit` bytes as JSON (null fields have none), and `shed`, the fields that lost
    something: the fields of DROPPED go one after the other, then those of CUT are halved, none below SHORTEST characters, until
    it fits. What can't be made to fit stays as small as it became. A null struct sheds nothing.
    """
    fields = rows.schema[column].dataType.fieldNames()
    size = lambda x: F.octet_length(F.to_json(x))
    own = F.col(column)
    out = rows.withColumn("shed", F.array().cast("array<string>"))
    for name in (x for x in DROPPED if x in fields):
        over = F.coalesce(size(own) > limit, F.lit(False))
        kind = rows.schema[column].dataType[name].dataType
        out = out.withColumn("_over", over & own[name].isNotNull()).withColumn("shed", F.when(F.col("_over"), F.array_append("shed", F.lit(name))).otherwise(F.col("shed"))).withColumn(column, F.when(F.col("_over"), own.withField(name, F.lit(None).cast(kind))).otherwise(own)).drop("_over")
    for name in (x for x in CUT if x in fields and rows.schema[column].dataType[x].dataType.typeName() == "string"):
        length = F.length(own[name])
        steps = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.floor(length / F.pow(F.lit(2.0), k)).cast("int"))
        enough = F.filter(steps, lambda n: (n <= SHORTEST) | (size(own.withField(name, F.substring(own[name], F.lit(1), n))) <= limit))
        n = F.when(F.coalesce(size(own) > limit, F.lit(False)) & (length > SHORTEST), enough[0])
        out = out.withColumn("_n", n).withColumn("shed", F.when(F.col("_n") < length, F.array_append("shed", F.lit(name))).otherwise(F.col("shed"))).withColumn(column, F.when(F.col("_n") < length, own.withField(name, F.substring(own[name], F.lit(1), F.col("_n")))).otherwise(own)).drop("_n")
    return out
