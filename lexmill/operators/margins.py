"""Headers and footers of pages: lines at a page's edge that many pages of its document repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segments import BREAKS

#: Lines that are known to be margins, and headings that never are.
KNOWN = r"(?i)^\s*(?:PRESIDEN\s+REPUBLIK\s+INDONESIA|SK\s+No\.|www\.peraturan\.go\.id|jdih\.|-?\s*\d+\s*-?)\s*$"
PROTECTED = r"(?i)^\s*(?:BAB\s+[IVXLCDM]+|Bagian\b|Paragraf\b|Pasal\s*\d+|Ayat\b)"
EDGE, SHARE, LEAST = 3, 0.30, 3
LINES = "array<struct<line:string,place:int,edge:boolean,signature:string>>"


def signature(line: Column) -> Column:
    """A line in lower case, white space collapsed, each number a #."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), r"(?U)\s+", " ")), r"\d+", "#")


def _edged(pages: DataFrame, edge: int) -> DataFrame:
    """Pages with `x`, their lines that aren't blank: place, whether they stand at an edge, signature (null for protected ones and within the page)."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), BREAKS), lambda v: F.regexp_replace(v, r"(?U)\s+", "") != "")
    rows = pages.withColumn("_l", lines)
    at_edge = lambda i: (i < edge) | (i >= F.size("_l") - edge)
    told = F.transform("_l", lambda v, i: F.struct(v.alias("line"), i.alias("place"), at_edge(i).alias("edge"), F.when(at_edge(i) & ~v.rlike(PROTECTED), signature(v)).alias("signature")))
    return rows.select("document_id", "page", told.alias("x"))


def margin_lines(pages: DataFrame, edge: int = EDGE, share: float = SHARE, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Pages (document_id, page, text) without their margins, and what was removed: (document_id, page, place, line, reason).

    Removed are of the first and last `edge` lines those of a known pattern, and those whose signature stands at an edge of at
    least `least` pages and `share` of the document's; headings are kept. Blank lines go from all pages. Only the lines at edges
    leave their page to be counted, once for each page and signature, so a document of any size costs six rows a page.
    """
    rows = _edged(pages, edge)
    marks = rows.select("document_id", "page", F.explode(F.array_distinct(F.transform(F.filter("x", lambda v: v["edge"] & v["signature"].isNotNull()), lambda v: v["signature"]))).alias("signature"))
    counted = marks.groupBy("document_id", "signature").agg(F.count_distinct("page").alias("n"))
    sizes = pages.groupBy("document_id").agg(F.count("*").alias("pages"))
    repeated = counted.join(sizes, "document_id").filter(F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * share))).select("document_id", "signature")
    found = marks.join(repeated, ["document_id", "signature"]).groupBy("document_id", "page").agg(F.collect_set("signature").alias("repeated"))
    both = rows.join(found, ["document_id", "page"], "left").withColumn("repeated", F.coalesce("repeated", F.array().cast("array<string>")))
    reason = lambda v: F.when(v["edge"] & v["signature"].isNotNull(), F.when(v["line"].rlike(KNOWN), F.lit("known_pattern")).when(F.array_contains("repeated", v["signature"]), F.lit("repeated_margin")))
    judged = both.select("document_id", "page", F.transform("x", lambda v: F.struct(v["line"].alias("line"), v["place"].alias("place"), reason(v).alias("reason"))).alias("x"))
    kept = F.transform(F.filter("x", lambda v: v["reason"].isNull()), lambda v: v["line"])
    clean = judged.select("document_id", "page", F.regexp_replace(F.array_join(kept, "\n"), r"(?U)^\s+|\s+$", "").alias("text"))
    gone = judged.select("document_id", "page", F.explode(F.filter("x", lambda v: v["reason"].isNotNull())).alias("v")).select("document_id", "page", "v.place", "v.line", "v.reason")
    return clean, gone
