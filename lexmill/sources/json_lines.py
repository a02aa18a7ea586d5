"""JSON lines as a source and as a checked sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_lines(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """Rows of JSON lines; blank lines are none. A line that is no JSON object of this schema ends the read, or, if not strict, is
    a row of nulls with the line in `_corrupt_record`.
    """
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(StructType([*schema.fields]).add("_corrupt_record", "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def findings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """What forbids an export: (finding, key), finding missing_key, repeated_key or empty_text."""
    empty = rows.filter(F.col(text).isNull() | (F.trim(text) == "")).select(F.lit("empty_text").alias("finding"), key)
    missing = rows.filter(F.col(key).isNull()).select(F.lit("missing_key").alias("finding"), key)
    repeated = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("repeated_key").alias("finding"), key)
    return missing.unionByName(repeated).unionByName(empty)


def export_json_lines(rows: DataFrame, path: str, key: str, text: str) -> None:
    """Writes rows as JSON lines, nulls included; raises ValueError, with nothing written, if there are findings."""
    bad = findings(rows, key, text).groupBy("finding").agg(F.count("*").alias("n")).orderBy("finding").collect()
    if bad:
        raise ValueError("not exported: " + ", ".join(f"{x.finding} {x.n}" for x in bad))
    rows.write.option("ignoreNullFields", "false").json(path)
