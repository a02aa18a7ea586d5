"""Tables of nodes that name their parents: roots, depths, ancestors, cycles.

Each round doubles the steps that a node has looked upwards, so rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources.shared import stored

ROOTED, ORPHAN, CYCLE = "rooted", "orphan", "cycle"


def _parents(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, up, given): up is the parent if it is a node, given whether one is named. Of repeated nodes the smallest parent counts."""
    own = nodes.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("named"))
    known = own.select(F.col("node").alias("up"))
    return own.join(known, own.named == known.up, "left").select("node", "up", F.col("named").isNotNull().alias("given"))


def chains(nodes: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """Per node: root, depth (steps to it) and state. rooted: the chain of parents ends at a node without one (or that is named by
    none); orphan: it ends at a node whose parent isn't in the table; cycle: it never ends (root and depth are null), also for
    nodes that only lead into a cycle. Null nodes go; an empty table gives an empty one.
    """
    own = _parents(nodes, node, parent)
    open_ = F.col("up").isNotNull()
    state = stored(own.select("node", F.coalesce("up", "node").alias("top"), F.when(open_, 1).otherwise(0).cast("long").alias("depth"), open_.alias("open"), (F.col("given") & ~open_).alias("lost")), "chains")
    total, steps, left = state.count(), 1, state.filter("open").count()
    while left and steps <= total:
        upper = state.select(F.col("node").alias("n"), F.col("top").alias("t"), F.col("depth").alias("d"), F.col("open").alias("o"), F.col("lost").alias("l"))
        further = state.filter("open").join(upper, F.col("top") == F.col("n")).select("node", F.col("t").alias("top"), (F.col("depth") + F.col("d")).alias("depth"), F.col("o").alias("open"), F.col("l").alias("lost"))
        state = stored(state.filter(~F.col("open")).unionByName(further), "chains")
        steps, left = 2 * steps, state.filter("open").count()
    ended = ~F.col("open")
    return state.select("node", F.when(ended, F.col("top")).alias("root"), F.when(ended, F.col("depth")).alias("depth"), F.when(F.col("open"), CYCLE).when(F.col("lost"), ORPHAN).otherwise(ROOTED).alias("state"))


def ancestors(nodes: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, ancestor, distance) for every ancestor of every node whose chain of parents ends; a row for each, as they are many."""
    ending = chains(nodes, node, parent).filter(F.col("state") != CYCLE).select("node")
    jump = stored(_parents(nodes, node, parent).filter("up is not null").join(ending, "node", "left_semi").select("node", "up"), "jumps")
    found = ending.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    step = 1
    while jump.limit(1).count():
        lower = jump.select(F.col("node").alias("ancestor"), "up")
        found = stored(found.unionByName(found.join(lower, "ancestor").select("node", F.col("up").alias("ancestor"), (F.col("distance") + step).alias("distance"))), "ancestors")
        upper = jump.select(F.col("node").alias("m"), F.col("up").alias("further"))
        jump, step = stored(jump.join(upper, jump.up == upper.m).select("node", F.col("further").alias("up")), "jumps"), 2 * step
    return found.filter("distance > 0")


#: How deep kinds of parts may stand, for parts that nest.
LEVELS = {"bab": 1, "bagian": 2, "paragraf": 3, "pasal": 4, "ayat": 5}


def hierarchy_findings(sections: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(document_id, node_id, code) of sections (document_id, node_id, parent, type, place, page_start, page_end) that stand wrong.

    missing_parent, cycle, parent_after (it comes no earlier), outside_pages (beyond the parent's), level (not below the parent's),
    parented_document, orphan_ayat (no article above it), repeated_node; with pages (document_id, page): unknown_page.
    """
    kind = F.lower("type")
    level = lambda c: F.create_map(*[F.lit(x) for item in LEVELS.items() for x in item])[F.lower(c)]
    above = sections.select(F.col("document_id").alias("d"), F.col("node_id").alias("p"), F.col("type").alias("p_type"), F.col("place").alias("p_place"), F.col("page_start").alias("p_start"), F.col("page_end").alias("p_end"))
    both = sections.join(above, (F.col("document_id") == F.col("d")) & (F.col("parent") == F.col("p")), "left")
    named, found = F.col("parent").isNotNull(), F.col("p").isNotNull()
    codes = {
        "missing_parent": named & ~found,
        "parent_after": F.col("p_place") >= F.col("place"),
        "outside_pages": (F.col("p_start") > F.col("page_start")) | (F.col("p_end") < F.col("page_end")),
        "level": level("p_type") >= level("type"),
        "parented_document": (kind == "document") & named,
        "orphan_ayat": (kind == "ayat") & (~found | (F.lower("p_type") != "pasal")),
    }
    told = both.select("document_id", "node_id", F.explode(F.array_compact(F.array(*[F.when(v, k) for k, v in codes.items()]))).alias("code"))
    key = F.struct("document_id", F.col("node_id").alias("n"))
    repeated = sections.groupBy("document_id", "node_id").agg(F.count("*").alias("n")).filter("n > 1")
    # a chain of nodes whose parents all come earlier ends, so only documents with another node, or a repeated one, are followed
    odd = both.filter(found & ~F.coalesce(F.col("p_place") < F.col("place"), F.lit(False))).select("document_id").unionByName(repeated.select("document_id")).distinct()
    looped = chains(sections.join(odd, "document_id", "left_semi").select(key.alias("node"), F.when(named, F.struct("document_id", F.col("parent").alias("n"))).alias("parent"))).filter(F.col("state") == CYCLE)
    out = told.unionByName(looped.select("node.document_id", F.col("node.n").alias("node_id"), F.lit("cycle").alias("code"))).unionByName(repeated.select("document_id", "node_id", F.lit("repeated_node").alias("code")))
    if pages is not None:
        ends = sections.select("document_id", "node_id", F.explode(F.array_distinct(F.array("page_start", "page_end"))).alias("page"))
        out = out.unionByName(ends.join(pages.select("document_id", "page").distinct(), ["document_id", "page"], "left_anti").select("document_id", "node_id", F.lit("unknown_page").alias("code")))
    return out.distinct()


def spans(marks: DataFrame, trace: str, order: str, opens: str, name: str) -> DataFrame:
    """Starts and ends of nested spans, in order within a trace, -> one row for each start: span (its number in the trace), name,
    parent (the innermost span then open, null for none), level, begin and end (null if it never ends).

    opens: boolean, true for a start. Ends without an open span are dropped. A span of level d lies in the latest one of level
    d - 1, and ends at the next end that brings the level back to d: both are found within (trace, level), never by pairs.
    """
    time = Window.partitionBy(trace).orderBy(order)
    rows = marks.select(trace, order, F.col(opens).alias("o"), F.col(name).alias("name"))
    sums = rows.withColumn("s", F.sum(F.when(F.col("o"), 1).otherwise(-1)).over(time.rowsBetween(Window.unboundedPreceding, 0)))
    floor = F.least(F.lit(0), F.min("s").over(time.rowsBetween(Window.unboundedPreceding, 0)))  # ends that nothing was open for
    level = sums.withColumn("level", F.col("s") - floor).withColumn("stray", ~F.col("o") & (floor < F.least(F.lit(0), F.coalesce(F.min("s").over(time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))))
    known = level.filter(~F.col("stray")).withColumn("span", F.when(F.col("o"), F.sum(F.col("o").cast("long")).over(time.rowsBetween(Window.unboundedPreceding, 0))))
    # a start of level d stands among those of its own level and, as a child, among those of the level above; an end among its own
    start = F.col("o")
    both = known.select("*", F.explode(F.when(start, F.array(F.struct(F.col("level").alias("at"), F.lit(False).alias("child")), F.struct((F.col("level") - 1).alias("at"), F.lit(True).alias("child")))).otherwise(F.array(F.struct((F.col("level") + 1).alias("at"), F.lit(False).alias("child"))))).alias("e"))
    own = Window.partitionBy(trace, "e.at").orderBy(order)
    seen = both.withColumn("parent", F.last(F.when(start & ~F.col("e.child"), F.col("span")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    ended = seen.filter(~start).select(F.col(trace).alias("_t"), F.col("parent").alias("_s"), F.col(order).alias("end"))
    begun = seen.filter(start & F.col("e.child")).select(trace, "span", "name", F.when(F.col("level") > 1, F.col("parent")).alias("parent"), "level", F.col(order).alias("begin"))
    return begun.join(ended, (F.col(trace) == F.col("_t")) & (F.col("span") == F.col("_s")), "left").drop("_t", "_s")


def kept_traces(traces: DataFrame, trace: str, slow_ms: int, percent: int) -> DataFrame:
    """Traces with status and persisted: all that failed or took slow_ms, and `percent` of the others, drawn by the trace's id."""
    drawn = F.conv(F.substring(F.md5(trace), 1, 8), 16, 10).cast("long") % 100 < percent
    return traces.select(
        trace, F.col("spans").cast("long").alias("spans"), F.col("deepest").cast("long").alias("deepest"), F.col("aborted").cast("long").alias("aborted"),
        F.when(F.col("failed"), "error").otherwise("ok").alias("status"), "duration_ms", (F.col("failed") | (F.col("duration_ms") >= slow_ms) | drawn).alias("persisted"),
    )
