"""How filters in a row act on each other: for every order and step what is kept, removed, redundant, unique, and lost.

A row's failures are a mask of one bit for each filter. Parts are counted by mask (all rows, good ones, toxic ones: the rows of a
small integer matrix), and one product with constant incidence matrices, masks by (order, step), gives all orders at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

REPEATED = "E"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure of each filter that looks at the text alone (not null)."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def incidence(names: str) -> tuple[list[str], dict[str, np.ndarray]]:
    """All orders of the filters, and for each outcome an integer matrix: masks by (order, step), 1 where the outcome holds."""
    orders = ["".join(p) for p in permutations(names)]
    mask = np.arange(1 << len(names))[:, None]
    bits = np.array([[1 << names.index(x) for x in order] for order in orders])
    before = np.cumsum(bits, 1) - bits
    own, before = bits.reshape(1, -1), before.reshape(1, -1)
    fails, earlier = mask & own != 0, mask & before != 0
    outcomes = {"kept": mask & (before | own) == 0, "removed": fails & ~earlier, "redundant": fails & earlier, "unique_fails": mask == own}
    return orders, {k: v.astype(np.int64) for k, v in outcomes.items()}


def _audited(names: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, matrix = incidence(names)
        k, steps = len(names), len(orders) * len(names)
        letter = np.array([names.index(x) for order in orders for x in order])
        by_letter = (letter[:, None] == np.arange(k)).astype(np.int64)
        order, step = np.repeat(orders, k), np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))
        for batch in batches:
            for some in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                parts, cells = some.num_rows, some.column("cells")
                counted = cells.flatten()
                row = np.repeat(np.arange(parts), np.diff(cells.offsets.to_numpy()))
                stack = np.zeros((3, parts, 1 << k), np.int64)
                for i, kind in enumerate(("n", "good", "toxic")):
                    np.add.at(stack[i], (row, counted.field("mask").to_numpy()), counted.field(kind).to_numpy())
                removed = stack.reshape(3 * parts, -1) @ matrix["removed"]
                taken, good, toxic = removed.reshape(3, parts, steps)
                out = {"kept": stack[0] @ matrix["kept"], "removed": taken, "redundant": stack[0] @ matrix["redundant"], "unique_fails": stack[0] @ matrix["unique_fails"], "good_lost": good, "toxic_lost": toxic, "shapley": (taken @ by_letter)[:, letter]}
                part = some.column("part").take(pa.array(np.repeat(np.arange(parts), steps)))
                yield pa.RecordBatch.from_arrays([part, pa.array(np.tile(order, parts), pa.string()), pa.array(np.tile(step, parts)), *(pa.array(out[m].ravel()) for m in MEASURES)], names=["part", "filter_order", "step", *MEASURES])

    return run


def interaction_audit(masks: DataFrame, names: str) -> DataFrame:
    """Rows (part, mask, good, toxic) -> per part, order of the filters and step: MEASURES, zeros included.

    Bit i of mask says that the row fails the filter names[i]; good and toxic are booleans, null counts as false. A part is
    reduced to at most 2 ** len(names) counters before it is shuffled. At most 6 filters, as the orders are their factorial.
    """
    if not 1 <= len(names) <= 6 or len(set(names)) < len(names):
        raise ValueError("one to six different filters")
    ones = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    cells = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), ones("good").alias("good"), ones("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct(F.col("mask").cast("int").alias("mask"), "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(_audited(names), f"part string, filter_order string, step int, {', '.join(f'{m} long' for m in MEASURES)}")


def document_masks(documents: DataFrame, labels: DataFrame, filters=text_filters, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> tuple[DataFrame, str]:
    """Rows (part, mask, good, toxic) of all documents, and the filters' names: those of `filters`, then REPEATED.

    Null texts count as empty, a null part as the empty string. A row fails REPEATED if a smaller id has the same text, whatever
    the other filters say; rows of one id aren't smaller than each other, and a null id is neither smaller nor larger. Good and
    toxic: some label of the id says so (null ids have no labels). Texts are read once; what is shuffled is ids and digests.
    """
    own = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    tests = filters(F.col("text"))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(tests.values())), F.lit(0))
    rows = stored(own.select("id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "masks")
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).filter("id is not null").withColumn("is_first", F.lit(True))
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    with_id = rows.filter("id is not null").join(said, "id", "left").join(first, ["id", "digest"], "left")
    bit = 1 << len(tests)
    judged = with_id.select("part", F.when(F.col("is_first"), F.col("mask")).otherwise(F.col("mask") + bit).alias("mask"), "good", "toxic")
    without = rows.filter("id is null").select("part", "mask", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic"))
    return judged.unionByName(without), "".join(tests) + REPEATED


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """interaction_audit of the five filters over whole documents; an empty table gives an empty one, other columns aren't read."""
    return interaction_audit(*document_masks(documents, labels))
