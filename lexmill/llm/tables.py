"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a temporary one in local mode; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def temporary(spark: SparkSession, folder: str, name: str) -> str:
    """A new path in the folder; what is written there goes when the session ends."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there and lost executors cost nothing.

    The files go when the session ends.
    """
    spark = df.sparkSession
    path = temporary(spark, shared_folder(spark).rstrip("/"), name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes in all texts; sizes the number of buckets, never the result."""
    from pyspark.sql import functions as F

    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def buckets_for(n_bytes: int, bytes_each: int = 6 << 20, least: int = 64) -> int:
    """Buckets so that one holds the words of about bytes_each of text, however much text there is."""
    return max(least, -(-n_bytes // bytes_each))


def dealt_join(rows: DataFrame, table: DataFrame, keys: list[str], by: str, parts: int = 64) -> DataFrame:
    """Rows joined with the table on keys; rows of one key are dealt by the column `by` into parts, each with its own copy of the
    table's row, so that no key fills one task."""
    from pyspark.sql import functions as F

    salted = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)))
    copies = salted.select(*keys, "_part").distinct().join(table, keys)
    return salted.join(copies, [*keys, "_part"]).drop("_part")
