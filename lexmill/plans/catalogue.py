"""All registered queries outside the llm subpackage, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answers, corpus, hierarchy, intake, lookups, memory, operations, ranking, release, retrieval, statutes, stores, structure, upkeep  # noqa: F401  registers their queries
from .registry import QUERIES, SQL

FLAGSHIP = "r_rrf"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
