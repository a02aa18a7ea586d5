"""A filter of bounded size that tells which ids may be in a table; a slot shared by chance costs a row too many, never one too few."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots: 16 for each id, from 128 KB of bits to 32 MB, the most that is broadcast. With more ids the filter passes more rows that
#: aren't in the table, up to all of them; what follows it is right with any.
LEAST, MOST = 1 << 20, 1 << 28


def _slot(column: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(slots))


def slots_of(ids: DataFrame, column: str):
    """A broadcast of the bits of the slots that the ids fall into. ids: a stored table, as it is read twice."""
    count = 16 * max(1, ids.count())
    size = min(MOST, max(LEAST, 1 << (count - 1).bit_length()))
    slots = ids.select((_slot(column, size) + 1).alias("slot"))  # bitmap buckets count from 1
    bits = bytearray(size // 8)
    for bucket, part in slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect():
        bits[(bucket - 1) * 4096 : bucket * 4096] = part
    return ids.sparkSession.sparkContext.broadcast(bytes(bits))


def has_slot(column: str, bits) -> Column:
    """Whether the id's slot is taken; false for null. Only the slots go to Python."""

    @F.arrow_udf("boolean")
    def taken(slot: pa.Array) -> pa.Array:
        at = slot.to_numpy(zero_copy_only=False)
        return pa.array((np.frombuffer(bits.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return F.col(column).isNotNull() & taken(_slot(column, len(bits.value) * 8))
