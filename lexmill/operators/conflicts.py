"""Several records of one document: which one stands, and why."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = "document_id string, place long, kept_place long, lost_place long, rule string"
IDENTICAL = "identical_content"


def _wins(kept: tuple, coming: tuple) -> tuple[bool, str]:
    """Whether the coming record replaces the kept one, and by which rule. Records: place, sha256, verified, trust, date."""
    if kept[1] == coming[1]:
        return False, IDENTICAL
    for i, rule in ((2, "verified_status"), (3, "source_trust")):
        if kept[i] != coming[i]:
            return coming[i] > kept[i], rule
    if coming[4] is not None and (kept[4] is None or coming[4] > kept[4]):
        return True, "newer_verification"
    return False, "stability"


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by document and place: the record kept so far goes from row to row and from batch to batch."""
    own, kept = None, None
    for batch in batches:
        out = []
        for document, place, sha, verified, trust, date in batch.itertuples(index=False):
            coming = (place, sha, verified, trust, None if pd.isna(date) else date)
            if own != document or kept is None:
                own, kept, rule, lost = document, coming, None, None
            else:
                wins, rule = _wins(kept, coming)
                lost = kept[0] if wins else place
                kept = coming if wins else kept
            out.append((document, place, kept[0], lost, rule))
        yield pd.DataFrame(out, columns=["document_id", "place", "kept_place", "lost_place", "rule"]).astype({"lost_place": "Int64"})


def folded_records(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Records (document_id, place, sha256, verification_status, source_id, last_verified_at), in the order of place within a
    document, against each other: STEPS, a row for each record, with the record kept after it, the one that lost (null for a
    document's first) and the rule. Sources (source_id, trust, enabled); unknown and disabled ones have trust 0.

    Equal contents change nothing; then a verified record wins, then the more trusted source, then the later verification; else
    the kept one stays. As a rule looks at the record kept so far, records are read in order, in sorted partitions and batch by
    batch: one document may have any number. Null ids go; ties of place are read by sha256, then unverified, less trusted and earlier
    verified ones first (no date is the earliest), so that only equal records are left in any order.
    """
    trust = sources.groupBy("source_id").agg(F.max(F.when(F.col("enabled"), F.col("trust")).otherwise(0.0)).alias("trust"))
    rows = records.filter("document_id is not null").join(trust, "source_id", "left").select(
        F.col("document_id").cast("string").alias("document_id"), F.col("place").cast("long").alias("place"), F.coalesce("sha256", F.lit("")).alias("sha256"),
        F.coalesce((F.col("verification_status") == "verified").cast("int"), F.lit(0)).alias("verified"), F.coalesce("trust", F.lit(0.0)).cast("double").alias("trust"), F.unix_micros(F.col("last_verified_at").cast("timestamp")).cast("double").alias("date"),
    )
    return rows.repartition("document_id").sortWithinPartitions("document_id", "place", "sha256", "verified", "trust", F.col("date").asc_nulls_first()).mapInPandas(_folded, STEPS)


def merged_records(records: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document_id, place) of the record that stands for each document, and the audit: the steps at which contents differed."""
    steps = folded_records(records, sources)
    last = steps.groupBy("document_id").agg(F.max_by("kept_place", F.struct("place", "kept_place")).alias("place"))  # the kept place never goes back
    return last, steps.filter((F.col("rule") != IDENTICAL) & F.col("rule").isNotNull())
