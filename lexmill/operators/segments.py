"""Pages of statutes into segments: each line sees the marks that are in force where it stands.

Spark brings a document's pages together in order, splits them and tells what each line is; what is in force is then the place of
some earlier line, found for all lines of a batch of documents at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.functions.sentences import marker
from lexmill.sources.shared import stored

#: Marks that open a part of another kind, and marks whose bare repetition is a table of contents.
OPENERS = ("appendix", "explanation", "considerans", "resolution")
LISTED = ("article", "chapter", "section", "subsection")
#: What ends a line.
BREAKS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SEGMENT = ("segment_id", "place", "chapter", "section", "article", "paragraph", "page_start", "page_end", "text", "kind", "provenance")


def stripped(line: Column) -> Column:
    """A line without white space at its ends, which most lines don't have."""
    ends = F.concat(F.substring(line, 1, 1), F.substring(line, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(line, r"(?U)^\s+|\s+$", "")).otherwise(line)


def page_lines(pages: DataFrame) -> DataFrame:
    """Pages (document_id, page, text) as lines (document_id, page, line_no, line), stripped; blank lines are empty strings."""
    kept = pages.filter("text <> ''").select("document_id", "page", F.regexp_replace("text", rf"(?:{BREAKS})\z", "").alias("text"))
    return kept.select("document_id", "page", F.posexplode(F.split("text", BREAKS)).alias("line_no", "line")).withColumn("line", stripped(F.col("line")))


def marked_lines(pages: DataFrame) -> DataFrame:
    """Lines that aren't blank with their mark (kind, label, trailing, provenance; null: none), whether a blank one follows (and
    its page), and toc: a bare article that another bare article or higher mark follows, so a table of contents.
    """
    order = Window.partitionBy("document_id").orderBy("page", "line_no")
    lines = page_lines(pages).withColumn("gap", F.lead("line").over(order) == "").withColumn("gap_page", F.lead("page").over(order)).filter("line <> ''")
    seen = lines.withColumn("m", marker(F.col("line"))).select("document_id", "page", "line_no", "line", F.coalesce("gap", F.lit(False)).alias("gap"), "gap_page", "m.*")
    bare = F.col("trailing") == ""
    after = seen.withColumn("listed", F.lead(F.col("kind").isin(*LISTED) & bare).over(order))
    return after.withColumn("toc", F.coalesce((F.col("kind") == "article") & bare & F.col("listed"), F.lit(False))).drop("listed")


def article_marks(pages: DataFrame) -> DataFrame:
    """(document_id, article) of all lines that have an article's mark, cited and listed ones too; no line needs another one."""
    lines = page_lines(pages).filter(F.col("line").rlike("(?i)pasa")).select("document_id", marker(F.col("line")).alias("m"))
    return lines.filter("m.kind = 'article'").select("document_id", F.col("m.label").alias("article"))


def ordered_lines(pages: DataFrame) -> DataFrame:
    """page_lines, one document after another and each in order within the partitions, with `first` (true at a document's first
    line) and `whole`, the page's text, at its first line. Pages are shuffled and sorted, if they don't lie so already; lines never.
    """
    sheet = F.row_number().over(Window.partitionBy("document_id").orderBy("page"))
    kept = pages.filter("text <> ''").select("document_id", "page", "text", sheet.alias("sheet"))
    lines = kept.select("document_id", "page", "sheet", "text", F.posexplode(F.split(F.regexp_replace("text", rf"(?:{BREAKS})\z", ""), BREAKS)).alias("line_no", "line"))
    begins = F.col("line_no") == 0
    return lines.select("document_id", "page", "line_no", stripped(F.col("line")).alias("line"), (begins & (F.col("sheet") == 1)).alias("first"), F.when(begins, F.col("text")).alias("whole"))


def by_documents(f: Callable[[pa.Table], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows that ordered_lines gives: f has the rows of some whole documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            begins = np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False))
            cut = begins[-1] if len(begins) else 0
            if len(begins) and (held or cut):
                yield f(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield f(pa.Table.from_batches(held))

    return run


class Documents:
    """Rows of whole documents in order: where each document starts, and which row set a value last."""

    def __init__(self, first: np.ndarray) -> None:
        self.n = len(first)
        self.rows = np.arange(self.n)
        self.number = np.cumsum(first) - 1
        self.start = np.flatnonzero(first)[self.number]

    def last(self, sets: np.ndarray, before: bool = False) -> np.ndarray:
        """The row of the same document that sets, up to each row (or before it); -1 for none."""
        row = np.maximum.accumulate(np.where(sets, self.rows, -1)) if self.n else self.rows
        if before:
            row = np.r_[-1, row[:-1]] if self.n else row
        return np.where(row >= self.start, row, -1)

    def held(self, sets: np.ndarray, clears: np.ndarray, before: bool = False) -> np.ndarray:
        """As last, but -1 if a row that clears came after it."""
        row = self.last(sets | clears, before)
        return np.where((row >= 0) & sets[row], row, -1)

    def count(self, marks: np.ndarray) -> np.ndarray:
        """How many rows of the same document are marked, up to each row."""
        total = np.cumsum(marks)
        return total - (total - marks)[self.start] if self.n else total

    def following(self, x: np.ndarray, step: int = 1, otherwise=False) -> np.ndarray:
        """Of each row the value `step` rows later in the same document."""
        at = np.minimum(self.rows + step, self.n - 1)
        return np.where((self.rows + step < self.n) & (self.number[at] == self.number), x[at], otherwise) if self.n else x


def taken(values: pa.Array, rows: np.ndarray) -> pa.Array:
    """The values at these rows, null at -1."""
    return values.take(pa.array(rows, pa.int64(), mask=rows < 0))


def joined(values: pa.Array, rows: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts of the values at these rows, a line each, from one end to the next."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), values.take(pa.array(rows))), "\n")


def _cut(t: pa.Table) -> pa.RecordBatch:
    """Marked lines of whole documents, blank ones too, into segments; pages of documents without any as unstructured ones."""
    t = t.combine_chunks()
    col = {c: t.column(c).combine_chunks() for c in t.column_names}
    every = Documents(col["first"].to_numpy(zero_copy_only=False))
    blank = pc.equal(col["line"], "").to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(~blank)
    gap = every.following(blank)[keep].astype(bool)
    d = Documents(np.r_[True, np.diff(every.number[keep]) > 0][: len(keep)])
    line, label, trailing, provenance = (col[c].take(pa.array(keep)) for c in ("line", "label", "trailing", "provenance"))
    names = ("appendix", "explanation", "considerans", "resolution", "chapter", "section", "subsection", "article", "paragraph", "letter")
    kind = pc.fill_null(pc.index_in(col["kind"], pa.array(names)), -1).to_numpy().astype(int)[keep]
    is_ = lambda *x: np.isin(kind, [names.index(i) for i in x])
    bare = pc.fill_null(pc.equal(trailing, ""), False).to_numpy(zero_copy_only=False)
    toc = is_("article") & bare & d.following(is_(*LISTED) & bare).astype(bool)
    kind[toc] = -1
    opens = is_(*OPENERS)
    part = np.where((opener := d.last(opens)) >= 0, kind[opener], -1) if d.n else kind
    kind[(part == names.index("considerans")) & is_("article", "paragraph", "letter")] = -1  # these only cite other texts
    article = d.held(is_("article"), opens)
    kind[is_("paragraph") & (article < 0)] = -1
    higher = opens | is_("chapter", "section", "subsection", "article")
    base = d.held(is_("paragraph"), higher)
    kind[is_("letter") & ((article < 0) | (base < 0))] = -1
    marked, section_clears = kind >= 0, opens | is_("chapter")
    chapter, section, subsection = d.last(is_("chapter", "appendix", "explanation")), d.held(is_("section"), section_clears), d.held(is_("subsection"), section_clears | is_("section"))
    below = d.held(is_("paragraph", "letter"), higher)
    state = d.last(opens | (is_("article") & np.isin(part, [-1, names.index("resolution")])))
    source = d.last(marked)
    # what is kept of a line, and the runs of lines under one mark
    own = ~toc & ((kind < 0) | opens)
    has = own | (~toc & ~is_("chapter", "subsection") & ~bare)
    content = pc.if_else(pa.array(own), line, trailing)
    begins = np.flatnonzero(marked | (d.rows == d.start))
    run = np.cumsum(marked | (d.rows == d.start)) - 1
    n_has = np.bincount(run[has], minlength=len(begins))
    items = np.stack([np.where(has, d.rows, -1), np.where(gap, d.n, -1)], axis=1).ravel()
    ends = np.cumsum(np.bincount(run, has.astype(int) + gap, minlength=len(begins)).astype(int))
    text = joined(pa.concat_arrays([content, pa.array([""], content.type)]), items[items >= 0], ends)
    text = pc.utf8_trim(pc.replace_substring_regex(text, r"\n{2,}", "\n\n"), "\n")
    some = np.flatnonzero(n_has)
    at, last_of = begins[some], np.r_[begins[1:], d.n] - 1
    where = np.flatnonzero(has)
    first_has, final = where[np.r_[0, np.cumsum(n_has)[:-1]][some]] if len(some) else at, where[np.cumsum(n_has)[some] - 1] if len(some) else at
    next_gap = np.minimum.accumulate(np.where(gap, d.rows, d.n)[::-1])[::-1] if d.n else d.rows  # of each row, the first gap from there on
    late = next_gap[final] if len(some) else at
    page_end = np.where(late <= last_of[some], keep[np.minimum(late, max(d.n - 1, 0))] + 1, keep[final]) if len(some) else at  # a gap's page is its blank line's
    named = lambda rows: taken(label, rows[at])
    chapters = pc.if_else(pa.array(np.isin(kind[chapter[at]], [0]) & (chapter[at] >= 0)), "LAMPIRAN", pc.if_else(pa.array(np.isin(kind[chapter[at]], [1]) & (chapter[at] >= 0)), "PENJELASAN", named(chapter)))
    lettered = (below[at] >= 0) & (kind[below[at]] == names.index("letter"))
    paragraphs = pc.if_else(pa.array(lettered), pc.binary_join_element_wise(taken(label, np.where(below[at] >= 0, base[below[at]], -1)), named(below), ", Huruf "), named(below))
    states = pa.array([*names[:4], "substantive", "preamble"]).take(pa.array(np.where(state[at] < 0, 5, np.minimum(kind[state[at]], 4))))
    found = Documents(np.r_[True, np.diff(d.number[at]) > 0][: len(at)])
    # pages of documents without a segment
    lost = ~np.isin(every.number, d.number[at]) & pc.is_valid(col["whole"]).to_numpy(zero_copy_only=False)
    lost = np.flatnonzero(lost & pc.fill_null(pc.match_substring_regex(col["whole"], r"[^\t-\r \x{85}\p{Z}]"), False).to_numpy(zero_copy_only=False))
    alone = Documents(np.r_[True, np.diff(every.number[lost]) > 0][: len(lost)])
    no = pa.nulls(len(lost), pa.string())
    rows = {
        "document_id": col["document_id"].take(pa.array(np.r_[keep[at], lost])), "place": pa.array(np.r_[found.rows - found.start, alone.rows - alone.start] + 1, pa.int64()),
        "chapter": pa.concat_arrays([chapters.cast(pa.string()), no]), "section": pa.concat_arrays([named(section), no]), "subsection": pa.concat_arrays([named(subsection), no]), "article": pa.concat_arrays([named(article), no]), "paragraph": pa.concat_arrays([paragraphs.cast(pa.string()), no]),
        "page_start": col["page"].take(pa.array(np.r_[keep[first_has], lost])), "page_end": col["page"].take(pa.array(np.r_[page_end, lost])), "text": pa.concat_arrays([text.take(pa.array(some)), col["whole"].take(pa.array(lost))]),
        "kind": pa.concat_arrays([states, pa.array(["unstructured"] * len(lost), pa.string())]), "provenance": pa.concat_arrays([pc.fill_null(taken(provenance, source[at]), "none"), pa.array(["none"] * len(lost), pa.string())]),
    }
    return pa.RecordBatch.from_pydict(rows)


def segments(pages: DataFrame) -> DataFrame:
    """Pages (document_id, page, text) -> segments (document_id and SEGMENT): the text between two marks under what is in force.

    Blank lines stay as one empty line within a segment. A document that has text but no segment gives one of kind unstructured
    for each page that isn't blank. Null and empty pages have no lines; page numbers should tell a document's pages apart. Pages
    meet by document, in one shuffle; lines are told apart by Spark, and one document's lines are held at a time (some thousand
    lines, if documents are smaller). The segments are stored, as their texts would be made again wherever they are used.
    """
    lines = ordered_lines(pages).withColumn("m", F.when(F.col("line") != "", marker(F.col("line")))).select("document_id", "page", "first", "whole", "line", "m.*")
    kinds = StructType([lines.schema["document_id"], lines.schema["page"]])
    page = kinds["page"].dataType.simpleString()
    rows = lines.mapInArrow(by_documents(_cut), f"document_id {kinds['document_id'].dataType.simpleString()}, place long, chapter string, section string, subsection string, article string, paragraph string, page_start {page}, page_end {page}, text string, kind string, provenance string")
    name = lambda form, n: F.format_string(form, F.col("document_id").cast("string"), n)
    segment_id = F.when(F.col("kind") == "unstructured", name("%s-page-%05d", F.col("page_start").cast("long"))).otherwise(name("%s-seg-%05d", F.col("place")))
    section = F.nullif(F.concat_ws(" / ", "section", "subsection"), F.lit(""))
    return stored(rows.withColumn("section", section).withColumn("segment_id", segment_id).select("document_id", *SEGMENT), "segments")


def segment_report(pages: DataFrame) -> DataFrame:
    """Per document and kind of mark: how many lines have it, those of a table of contents apart as kind toc."""
    kind = F.when(F.col("toc"), F.lit("toc")).otherwise(F.col("kind"))
    return marked_lines(pages).select("document_id", kind.alias("kind")).filter("kind is not null").groupBy("document_id", "kind").agg(F.count("*").alias("lines"))


def segment_issues(rows: DataFrame, least: int = 20) -> DataFrame:
    """Segments -> (document_id, segment_id, code): bad_article_label; too_short for substantive text of fewer than `least`
    visible characters; ayat_duplicate and ayat_gap at an article's first numbered paragraph, if a number repeats or the numbers
    in order aren't 1, 2, 3, ... A repeat is a gap too.
    """
    issue = lambda df, code: df.select("document_id", "segment_id", F.lit(code).alias("code"))
    labels = rows.filter(~F.col("article").rlike(r"^Pasal \d+[A-Z]?$"))
    short = rows.filter((F.col("kind") == "substantive") & (F.length(F.regexp_replace("text", r"(?U)\s+", "")) < least))
    number = F.regexp_extract("paragraph", r"^Ayat \((\d+)\)", 1).try_cast("bigint")
    numbered = rows.filter("article <> ''").withColumn("n", number).filter("n is not null")
    own = Window.partitionBy("document_id", "article")
    each = numbered.select("document_id", "article", "place", "segment_id", "n", F.row_number().over(own.orderBy("place")).alias("i"))
    judged = each.groupBy("document_id", "article").agg(F.min_by("segment_id", "place").alias("segment_id"), (F.count_distinct("n") < F.count("*")).alias("twice"), F.max(F.col("n") != F.col("i")).alias("out"))
    return issue(labels, "bad_article_label").unionByName(issue(short, "too_short")).unionByName(issue(judged.filter("twice"), "ayat_duplicate")).unionByName(issue(judged.filter("out"), "ayat_gap"))
