"""Queries on the structure of statutes. Orders serve as pages of statutes, customers as statutes, line items as provisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators import legal_tree, trees
from lexmill.operators import segments as seg
from lexmill.sources.shared import stored

from .registry import Tables, query

_ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")

#: The lines of all pages: what opens a page follows its priority, what stands on it follows its items.
LINES = f"""o AS (SELECT o_custkey AS document_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page,
  list_concat(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN ['BAB ' || [{", ".join(f"'{x}'" for x in _ROMAN)}][o_orderkey % 12 + 1]] WHEN '2' THEN CASE WHEN o_orderkey % 3 = 0 THEN ['Bagian Kesatu', 'Paragraf 1'] ELSE ['Bagian Kedua'] END
    WHEN '3' THEN ['Menimbang bahwa aturan ' || o_orderkey || ' perlu'] WHEN '4' THEN CASE WHEN o_orderkey % 5 = 0 THEN ['LAMPIRAN'] ELSE [] END WHEN '5' THEN CASE WHEN o_orderkey % 4 = 0 THEN ['MEMUTUSKAN'] ELSE [] END ELSE [] END,
    ['Pasal' || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ' ' END || (o_orderkey % 900 + 1) || CASE WHEN o_orderkey % 11 = 0 THEN 'A' ELSE '' END]) AS head FROM orders),
i AS (SELECT k, list(line ORDER BY n, line) AS items FROM (SELECT l_orderkey AS k, l_linenumber AS n, CASE l_returnflag WHEN 'A' THEN '(' || l_linenumber || ') barang ' || l_partkey || ' dikirim' WHEN 'N' THEN chr(96 + l_linenumber) || '. butir ' || l_partkey
  ELSE CASE l_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Pasal ' || (l_partkey % 50 + 1) ELSE 'isi ketentuan ' || l_partkey || '.' END END AS line FROM lineitem) GROUP BY k),
lines AS (SELECT document_id, page, unnest(range(len(all_lines))) AS line_no, unnest(all_lines) AS line FROM (SELECT document_id, page, list_concat(head, coalesce(items, [])) AS all_lines FROM o LEFT JOIN i ON i.k = o.k))"""

_BIG = "'appendix', 'explanation', 'considerans', 'resolution'"
_RUN = "OVER (PARTITION BY document_id ORDER BY page, line_no ROWS UNBOUNDED PRECEDING)"


def _held(kind: str, setter: str, value: str, clearing: str) -> str:
    """SQL of the value that the last setter gave, null if a clearing mark came after it."""
    return f"struct_extract(last_value(CASE WHEN {kind} IN ('{setter}', {clearing}) THEN {{'v': CASE WHEN {kind} = '{setter}' THEN {value} END}} END IGNORE NULLS) {_RUN}, 'v')"


STATED = rf"""gaps AS (SELECT *, lead(line) OVER w = '' AS gap, lead(page) OVER w AS gap_page FROM lines WINDOW w AS (PARTITION BY document_id ORDER BY page, line_no)),
named AS (SELECT document_id, page, line_no, line, coalesce(gap, false) AS gap, gap_page, CASE WHEN line LIKE 'LAMPIRAN%' THEN 'appendix' WHEN line LIKE 'BAB %' THEN 'chapter' WHEN line LIKE 'Bagian %' THEN 'section' WHEN line LIKE 'Paragraf %' THEN 'subsection' WHEN line LIKE 'Pasal%' THEN 'article'
    WHEN regexp_matches(line, '^\(\d+\)') THEN 'paragraph' WHEN regexp_matches(line, '^[a-z]\. ') THEN 'letter' WHEN line LIKE 'Menimbang %' THEN 'considerans' WHEN line LIKE 'MEMUTUSKAN%' THEN 'resolution' END AS k0 FROM gaps WHERE line <> ''),
labelled AS (SELECT *, CASE k0 WHEN 'article' THEN 'Pasal ' || trim(substr(line, 6)) WHEN 'paragraph' THEN 'Ayat ' || regexp_extract(line, '^\(\d+\)') WHEN 'letter' THEN line[1:1] WHEN 'considerans' THEN 'Menimbang' ELSE line END AS label,
    CASE k0 WHEN 'paragraph' THEN regexp_extract(line, '^\(\d+\) (.*)$', 1) WHEN 'letter' THEN substr(line, 4) WHEN 'considerans' THEN line WHEN 'resolution' THEN line ELSE '' END AS rest, CASE WHEN k0 = 'article' AND line NOT LIKE 'Pasal %' THEN 'normalized' ELSE 'standalone' END AS provenance FROM named),
listed AS (SELECT *, coalesce(k0 = 'article' AND lead(k0 IN ('article', 'chapter', 'section', 'subsection') AND rest = '') OVER (PARTITION BY document_id ORDER BY page, line_no), false) AS toc FROM labelled),
s1 AS (SELECT * EXCLUDE (k0), CASE WHEN NOT toc THEN k0 END AS k1, coalesce(last_value(CASE WHEN NOT toc AND k0 IN ({_BIG}) THEN k0 END IGNORE NULLS) {_RUN}, 'preamble') AS part FROM listed),
s2 AS (SELECT *, CASE WHEN part = 'considerans' AND k1 IN ('article', 'paragraph', 'letter') THEN NULL ELSE k1 END AS k2 FROM s1),
s3 AS (SELECT *, {_held("k2", "article", "label", _BIG)} AS article FROM s2),
s4 AS (SELECT *, CASE WHEN k2 = 'paragraph' AND article IS NULL THEN NULL ELSE k2 END AS k3 FROM s3),
s5 AS (SELECT *, {_held("k3", "paragraph", "label", f"{_BIG}, 'chapter', 'section', 'subsection', 'article'")} AS base FROM s4),
s6 AS (SELECT *, CASE WHEN k3 = 'letter' AND (article IS NULL OR base IS NULL) THEN NULL ELSE k3 END AS kind FROM s5),
stated AS (SELECT document_id, page, line_no, gap, gap_page, toc, article, kind, CASE WHEN toc OR kind IN ('chapter', 'subsection') THEN NULL WHEN kind IS NULL OR kind IN ({_BIG}) THEN line ELSE nullif(rest, '') END AS content,
    last_value(CASE kind WHEN 'chapter' THEN label WHEN 'appendix' THEN 'LAMPIRAN' WHEN 'explanation' THEN 'PENJELASAN' END IGNORE NULLS) {_RUN} AS chapter,
    {_held("kind", "section", "label", f"{_BIG}, 'chapter'")} AS section, {_held("kind", "subsection", "label", f"{_BIG}, 'chapter', 'section'")} AS subsection,
    struct_extract(last_value(CASE WHEN kind IS NOT NULL THEN {{'v': CASE kind WHEN 'letter' THEN base || ', Huruf ' || label WHEN 'paragraph' THEN label END}} END IGNORE NULLS) {_RUN}, 'v') AS paragraph,
    coalesce(last_value(CASE WHEN kind IN ({_BIG}) THEN kind WHEN kind = 'article' AND part IN ('preamble', 'resolution') THEN 'substantive' END IGNORE NULLS) {_RUN}, 'preamble') AS state,
    coalesce(last_value(CASE WHEN kind IS NOT NULL THEN provenance END IGNORE NULLS) {_RUN}, 'none') AS source, count(kind) {_RUN} AS run FROM s6),
ends AS (SELECT *, max(CASE WHEN content IS NOT NULL THEN page * 1000 + line_no END) OVER (PARTITION BY document_id, run) AS final FROM stated),
runs AS (SELECT document_id, run, max(chapter) AS chapter, nullif(concat_ws(' / ', max(section), max(subsection)), '') AS section, max(article) AS article, max(paragraph) AS paragraph, max(state) AS kind, max(source) AS provenance, min(page) FILTER (WHERE content IS NOT NULL) AS page_start,
    coalesce(arg_min(gap_page, page * 1000 + line_no) FILTER (WHERE gap AND page * 1000 + line_no >= final), max(page) FILTER (WHERE content IS NOT NULL)) AS page_end,
    regexp_replace(regexp_replace(string_agg(coalesce(content, '') || CASE WHEN gap AND content IS NOT NULL THEN chr(10) WHEN gap THEN '' ELSE '' END, chr(10) ORDER BY page, line_no) FILTER (WHERE content IS NOT NULL OR gap), '\n{{2,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS text
  FROM ends GROUP BY document_id, run HAVING count(content) > 0),
segments AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY run) AS place FROM runs),
found AS (SELECT document_id || '-seg-' || lpad(CAST(place AS VARCHAR), 5, '0') AS segment_id, * EXCLUDE (run) FROM segments)"""


def pages(t: Tables) -> DataFrame:
    """The pages (document_id, page, text) of the statutes. Orders and their items meet first, by order and as numbers; then a
    statute's pages meet, and stay together: their texts are made where they lie."""
    k, first = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    some = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    head = (
        F.when(first == "1", F.array(F.concat(F.lit("BAB "), F.element_at(some(*_ROMAN), (k % 12 + 1).cast("int")))))
        .when((first == "2") & (k % 3 == 0), some("Bagian Kesatu", "Paragraf 1")).when(first == "2", some("Bagian Kedua"))
        .when(first == "3", F.array(F.concat(F.lit("Menimbang bahwa aturan "), k, F.lit(" perlu"))))
        .when((first == "4") & (k % 5 == 0), some("LAMPIRAN")).when((first == "5") & (k % 4 == 0), some("MEMUTUSKAN")).otherwise(some())
    )
    article = F.concat(F.lit("Pasal"), F.when(F.col("o_orderstatus") == "F", "").otherwise(" "), k % 900 + 1, F.when(k % 11 == 0, "A").otherwise(""))

    def item(x: Column) -> Column:
        n, part, flag = x["n"], x["part"], x["flag"]
        other = F.when(part % 4 == 0, F.lit("")).when(part % 4 == 1, F.concat(F.lit("Pasal "), part % 50 + 1)).otherwise(F.concat(F.lit("isi ketentuan "), part, F.lit(".")))
        return F.when(flag == "A", F.concat(F.lit("("), n, F.lit(") barang "), part, F.lit(" dikirim"))).when(flag == "N", F.concat(F.char(96 + n), F.lit(". butir "), part)).otherwise(other)

    items = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))).alias("i"))
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("document_id"), "o_orderpriority", "o_orderstatus").join(items, "o_orderkey", "left")
    page = F.row_number().over(Window.partitionBy("document_id").orderBy("o_orderkey"))
    listed = F.sort_array(F.transform("i", lambda x: F.struct(x["n"].alias("n"), item(x).alias("line"))))["line"]
    body = F.array_join(F.concat(head, F.array(article), F.coalesce(listed, some())), "\n")
    return orders.withColumn("page", page.cast("long")).select("document_id", "page", F.concat(body, F.lit("\n")).alias("text"))


#: The lines' order as one number that holds for pages of any length, and the pages of documents that have text but no segment.
_ORDERED = STATED.replace("page * 1000 + line_no", "page * 4294967296 + line_no")
_BARE = r"""bare AS (SELECT document_id, page, array_to_string(list_concat(head, coalesce(items, [])), chr(10)) || chr(10) AS text FROM o LEFT JOIN i ON i.k = o.k ANTI JOIN runs USING (document_id)),
whole AS (SELECT document_id, printf('%s-page-%05d', CAST(document_id AS VARCHAR), page) AS segment_id, row_number() OVER (PARTITION BY document_id ORDER BY page) AS place, page, text FROM bare WHERE regexp_matches(text, '\S'))"""
#: Segments of statutes, and pages of those without any.
FOUND = f"{LINES}, {_ORDERED}, {_BARE}"


@query(f"WITH {LINES}, {_ORDERED}, {_BARE} SELECT document_id, segment_id, place, chapter, section, article, paragraph, page_start, page_end, sha256(text) AS text, kind, provenance FROM found UNION ALL SELECT document_id, segment_id, place, NULL, NULL, NULL, NULL, page, page, sha256(text), 'unstructured', 'none' FROM whole")
def tx_segment(t: Tables) -> DataFrame:
    return seg.segments(pages(t)).withColumn("text", F.sha2("text", 256))


@query(f"WITH {LINES}, {STATED} SELECT document_id, CASE WHEN toc THEN 'toc' ELSE k0 END AS kind, count(*) AS lines FROM listed WHERE k0 IS NOT NULL GROUP BY ALL")
def tx_segment_report(t: Tables) -> DataFrame:
    return seg.segment_report(pages(t))


@query(rf"""WITH {LINES}, {STATED}, n AS (SELECT document_id, article, segment_id, place, CAST(regexp_extract(paragraph, '^Ayat \((\d+)\)', 1) AS BIGINT) AS n, row_number() OVER (PARTITION BY document_id, article ORDER BY place) AS i FROM found WHERE article <> '' AND regexp_matches(paragraph, '^Ayat \(\d+\)')),
j AS (SELECT document_id, arg_min(segment_id, place) AS segment_id, list(n ORDER BY place) AS n FROM n GROUP BY document_id, article)
SELECT document_id, segment_id, 'bad_article_label' AS code FROM found WHERE NOT regexp_matches(article, '^Pasal \d+[A-Z]?$') UNION ALL SELECT document_id, segment_id, 'too_short' FROM found WHERE kind = 'substantive' AND length(regexp_replace(text, '\s', '', 'g')) < 20
UNION ALL SELECT document_id, segment_id, 'ayat_duplicate' FROM j WHERE len(list_distinct(n)) < len(n) UNION ALL SELECT document_id, segment_id, 'ayat_gap' FROM j WHERE n <> range(1, list_max(n) + 1)""")
def tx_segment_issues(t: Tables) -> DataFrame:
    return seg.segment_issues(seg.segments(pages(t)))


@query()
def tx_legal_tree(t: Tables) -> DataFrame:
    return legal_tree.legal_tree(pages(t), text="sha256")


@query()
def tx_tree_findings(t: Tables) -> DataFrame:
    """What stands wrong in the trees: levels, parents, pages, repeated nodes."""
    found = stored(pages(t), "pages")
    return trees.hierarchy_findings(stored(legal_tree.tree_nodes(found), "nodes"), found.select("document_id", "page"))
