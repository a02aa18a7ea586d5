"""Pages of statutes into a tree of parts: chapters, sections, paragraphs, articles, numbered clauses, annexes.

Every line is told apart by what it looks like, then by what is in force where it stands. What is in force is always the last of
some earlier lines, so it is found for all lines of a batch of whole documents at once; no row waits for the result of another one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources.shared import stored

from .segments import Documents, by_documents, ordered_lines

#: What marks look like, what keeps a line from being one, and names of chapters that have a role.
CHAPTER = r"(?i)^BAB\s*([IVXLCDM]+[A-Z]?)(?:\s+(.+))?$"
SECTION = r"(?i)^Bagian\s+(Kesatu|Ke(?:dua|tiga|empat|lima|enam|tujuh|delapan|sembilan|sepuluh|sebelas|dua belas)|[0-9]+)(?:\s+(.+))?$"
PARAGRAPH = r"(?i)^Paragraf\s+([0-9]+[A-Z]?)(?:\s+(.+))?$"
ARTICLE = r"(?i)^[|\s]*Pasa[lI1]\s*([0-9O]+(?:\s+[0-9O]+)*[A-Z]?|I{1,3})(?:\s*[.,:]?\s*(.*))?$"
CLAUSE = r"(?i)^\(\s*([0-9]+[A-Z]?)\s*\)(?:\s+(.+))?$"
OPENING = r"(?i)^(Menimbang|Mengingat|MEMUTUSKAN|Menetapkan)\s*:?[ \t]*(.*)$"
EXPLANATION = r"(?i)^P\s*E\s*N\s*J\s*E\s*[LI1][.]?\s*A\s*S\s*A\s*N(?:\s+ATAS\b.*)?$"
ANNEX = r"(?i)^LAMPIRAN\b.*$"
ANNEX_CITED = r"(?i)^(?:yang|sebagaimana|ini|merupakan)\b"
MALFORMED = r"(?i)^(BAB|Bagian|Paragraf|Pasa[lI1])\s+[?\x{fffd}]+$"
HEADER = r"(?i)^(?:Pasa[lI1]\s*[0-9]+[A-Z]?|\(\d+\).*?)\s*(?:(?:\.\s*){2,}|…)$"
CITING_ARTICLE = r"(?i)(?:\bdimaksud\s+(?:dalam|pada)|\bPasal\b.*\b(?:dan|atau)|\bdalam)\s*$"
CITING_CLAUSE = r"(?i)\bayat\s*$"
AMENDED_ITEM = r"(?i)^(?:Angka\s*)?\d+[.)]?\s+(?:Ketentuan\s+)?Pasa[lI1]\s*[0-9]+(?:\s+[0-9]+)*[A-Z]?.*\b(?:diubah|dihapus|tetap)\b"
AMENDED_BOUND = r"(?i)^(?:Angka\s*)?\d+[.)]?\s+.*\b(?:diubah|dihapus|disisipkan|tetap)\b"
AMENDING = r"(?i)(?:\bbeberapa\s+ketentuan\s+dalam\b|\bketentuan\s+pasal\s+[0-9O]+(?:\s+[0-9O]+)*[A-Z]?.*\b(?:diubah|dihapus|disisipkan|tetap)\b)"
NUMBERED_ITEM = r"(?i)\bAngka\s*\d+\b"
ROLES = {"ketentuan umum": "ketentuan_umum", "ketentuan peralihan": "ketentuan_peralihan", "ketentuan penutup": "ketentuan_penutup"}
CONNECTORS = ("atas", "atau", "bagi", "dan", "dari", "dengan", "serta", "tentang", "yang")
#: How many lines are looked ahead for the words after an article, and for the heading that a catchword repeats.
AHEAD, CATCHWORD = 11, 9
NODE = ("node_id", "place", "type", "identifier", "parent", "title", "role", "page_start", "page_end", "amendment_scope", "source_duplicate_of", "text")


def _role(text: Column) -> Column:
    name = F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), ":+$", "")
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in ROLES.items()])


def _title_like(line: Column) -> Column:
    """No sentence end, at most 12 words, all in capitals or each with a capital, a connector or no letter first."""
    words = F.filter(F.transform(F.split(line, r"\s+"), lambda w: F.regexp_replace(w, r"^[(),.\-]+|[(),.\-]+$", "")), lambda w: w != "")
    fine = F.forall(words, lambda w: F.lower(w).isin(*CONNECTORS) | ~w.rlike(r"^\p{L}") | w.rlike(r"^\p{Lu}"))
    return ~line.rlike(r"[.;:]$") & (F.size(words).between(1, 12)) & ((F.upper(line) == line) | fine)


def _part(line: Column, pattern: str, k: int) -> Column:
    """A group of the pattern, stripped; null if it is empty."""
    return F.nullif(F.trim(F.regexp_extract(line, pattern, k)), F.lit(""))


def _flags(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [pc.fill_null(t.column(c), False).to_numpy(zero_copy_only=False).astype(bool) for c in names]


def _looked_ahead(t: pa.Table) -> pa.RecordBatch:
    """Lines of whole documents without blank ones, catchwords and headers; `first` anew, and `ahead`, for lines that look ahead."""
    t = t.combine_chunks()
    (first,) = _flags(t, "first")
    keep = np.flatnonzero(pc.not_equal(t.column("line"), "").to_numpy(zero_copy_only=False))
    number_of = (np.cumsum(first) - 1)[keep]
    t = t.take(pa.array(keep)).combine_chunks()
    d = Documents(np.r_[True, np.diff(number_of) > 0][: len(keep)])
    bare, header, looks = _flags(t, "bare", "header", "looks")
    number = pc.fill_null(t.column("number").combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(int)
    page = t.column("page").to_numpy()
    same, again = np.zeros(d.n, int), np.zeros(d.n, bool)
    for step in range(1, CATCHWORD + 1):
        beside, follows = d.following(page, step, np.nan), d.following(number, step, -1)
        same += beside == page
        again |= (beside == page + 1) & d.following(bare, step).astype(bool) & (follows == number)
    kept = np.flatnonzero(~(bare & (same <= 2) & again) & ~header)
    # up to the next article
    article = np.minimum.accumulate(np.where(number >= 0, d.rows, d.n)[::-1])[::-1] if d.n else d.rows
    end = np.r_[d.start[1:] != d.start[:-1], True][: d.n]
    last = np.minimum.accumulate(np.where(end, d.rows, d.n)[::-1])[::-1] + 1 if d.n else d.rows
    stop = np.minimum(np.minimum(np.r_[article[1:], d.n][: d.n], last), d.rows + 1 + AHEAD)[kept]
    length = np.where(looks[kept], stop - kept - 1, 0)
    ends = np.cumsum(length)
    at = np.repeat(kept + 1 - np.r_[0, ends[:-1]][: len(kept)], length) + np.arange(ends[-1] if len(kept) else 0)
    line = t.column("line").combine_chunks()
    ahead = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), line.take(pa.array(at, pa.int64()))), " ")
    begins = np.r_[True, np.diff(d.number[kept]) > 0][: len(kept)]
    out = t.take(pa.array(kept)).select(["document_id", "page", "line_no", "line", "number", "bare"])
    return out.append_column("first", pa.array(begins, pa.bool_())).append_column("ahead", ahead).combine_chunks().to_batches()[0] if len(kept) else pa.RecordBatch.from_pydict({c: out.column(c).combine_chunks() for c in out.column_names} | {"first": pa.array([], pa.bool_()), "ahead": pa.array([], pa.string())})


def told_lines(pages: DataFrame) -> DataFrame:
    """Lines that aren't blank, catchwords and running headers left out, with `look`, what they look like, and the lines ahead.

    A catchword is a bare article mark near the end of a page which the next page repeats soon.
    """
    line = F.col("line")
    initial = F.lower(F.substring(line, 1, 1))  # what a line starts with tells which patterns are worth a try
    number = F.when(initial.isin("p", "|") & line.rlike(ARTICLE), F.lower(F.regexp_extract(line, ARTICLE, 1)))
    rows = ordered_lines(pages).drop("whole").withColumn("number", number)
    rows = rows.withColumn("bare", F.col("number").isNotNull() & _part(line, ARTICLE, 2).isNull()).withColumn("header", line.rlike(r"[.…]$") & line.rlike(HEADER)).withColumn("looks", F.col("number").isNotNull() | ((initial == "l") & line.rlike(ANNEX)))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("document_id", "page")}
    kept = rows.mapInArrow(by_documents(_looked_ahead), f"document_id {kinds['document_id']}, page {kinds['page']}, line_no int, line string, number string, bare boolean, first boolean, ahead string")
    cited = F.coalesce(_part(line, r"(?is)^.{8}(.*)$", 1), F.col("ahead")).rlike(ANNEX_CITED)
    look = (
        F.when(line.rlike(EXPLANATION), "penjelasan").when(line.rlike(ANNEX), F.when(cited, "cited").otherwise("lampiran")).when(line.rlike(CHAPTER), "bab").when(line.rlike(SECTION), "bagian")
        .when(line.rlike(PARAGRAPH), "paragraf").when(F.col("bare"), "pasal").when(F.col("number").isNotNull(), "cited").when(line.startswith("(") & line.rlike(CLAUSE), "ayat").otherwise("text")
    )
    look = F.when(F.col("bare"), "pasal").when(F.col("number").isNotNull(), "cited").when(initial.isin("p", "l", "b"), look).when(line.startswith("(") & line.rlike(CLAUSE), "ayat").otherwise("text")
    return kept.select("document_id", "page", "line_no", "first", "line", "number", "ahead", look.alias("look"), F.when(initial == "m", F.lower(_part(line, OPENING, 1))).alias("opening"))


EVENTS = ("menimbang", "mengingat", "memutuskan", "menetapkan", "penjelasan", "lampiran", "bab", "bagian", "paragraf", "pasal", "ayat", "cited", "text", "named", "malformed", "title", "content", "list_item", "unstructured")


def _place(t: pa.Table) -> pa.RecordBatch:
    """Told lines of whole documents with `event`, what each line does: it opens a part of that type, names the part before it
    (title) or is content; `place` (of the part that a line opens, from 1), `path` (the places of the part that it belongs to and
    of all parts above, the document's 0 first), `parent` (a place), `unnamed` (such parts so far) and `explained`.
    """
    t = t.combine_chunks()
    first, role, title_like, untitled, citing_article, citing_clause = _flags(t, "first", "has_role", "title_like", "untitled", "citing_article", "citing_clause")
    d = Documents(first)
    code = lambda c: pc.fill_null(pc.index_in(t.column(c), pa.array(EVENTS)), -1).to_numpy().astype(int)
    look, opening = code("look"), code("opening")
    is_ = lambda x, *names: np.isin(x, [EVENTS.index(n) for n in names])
    broken_kind = t.column("malformed").combine_chunks()
    broken_like = pc.is_valid(broken_kind).to_numpy(zero_copy_only=False)
    before = lambda x: np.r_[False, x[:-1]][: d.n] & (d.rows > d.start)  # noqa: E731  of the line before
    in_body = d.last(is_(look, "penjelasan", "lampiran", "bab", "pasal"), True) >= 0
    look = np.where((opening >= 0) & ~in_body, opening, look)
    scopes, headed, text = is_(look, "penjelasan", "lampiran"), is_(look, "bab", "bagian", "paragraf"), is_(look, "text")
    opens_text = is_(look, *EVENTS[:4])
    role, title_like = role & text, title_like & text
    scope_before = d.last(scopes, True)
    annex = (scope_before >= 0) & is_(look[scope_before], "lampiran")
    clause_cited = before(citing_clause)
    ends = is_(look, "ayat") & ~annex & ~clause_cited
    # a part that waits for its title goes on waiting over titles, citations and annex items
    row = d.last(headed | opens_text | scopes | is_(look, "pasal") | ends | (text & ~title_like), True)
    waiting = (row >= 0) & headed[row] & untitled[row]
    event = look.copy()
    event[text] = EVENTS.index("content")
    event[title_like & waiting] = EVENTS.index("title")
    event[text & broken_like & ~role & ~(title_like & waiting)] = EVENTS.index("malformed")
    event[role & ~waiting] = EVENTS.index("named")
    # of the article marks since the last higher part the first always opens one; later ones may continue a citation
    within = d.held(is_(event, "pasal"), is_(event, "named", "malformed") | opens_text | scopes | headed, True) >= 0
    cited, item = is_(event, "pasal") & within & before(citing_article), is_(event, "ayat") & ~within & annex
    event[item] = EVENTS.index("list_item")
    event[cited | (is_(look, "ayat") & clause_cited)] = EVENTS.index("cited")
    # text before any part is a part of its own
    event[is_(event, "content") & (d.last(~is_(event, "cited", "title"), True) < 0)] = EVENTS.index("unstructured")
    e = lambda *names: is_(event, *names)
    opens = ~e("cited", "title", "content")
    place = d.count(opens)
    named = lambda x: e("malformed") & pc.fill_null(pc.equal(broken_kind, x), False).to_numpy(zero_copy_only=False)
    # the line that opened the part of each level that is open before a line, -1 for none
    or_ = lambda a, b: np.where(a >= 0, a, b)
    higher = e(*EVENTS[:6]) | named("bab")
    scope, decision = d.last(e("penjelasan", "lampiran"), True), d.last(e("memutuskan"), True)
    in_chapter = or_(d.held(e("bab"), higher, True), scope)
    higher = higher | e("bab", "named") | named("bagi")
    in_section = or_(d.held(e("bagian"), higher, True), in_chapter)
    higher = higher | e("bagian") | named("para")
    in_paragraph = or_(d.held(e("paragraf"), higher, True), in_section)
    in_article = or_(d.held(e("pasal"), higher | e("paragraf", "malformed"), True), in_paragraph)
    above = np.select(
        [e("menetapkan"), e(*EVENTS[:6]) | e("unstructured"), e("bab", "list_item") | named("bab"), e("bagian", "named") | named("bagi"), e("paragraf") | named("para"), e("pasal", "malformed"), e("ayat")],
        [decision, np.full(d.n, -1), scope, in_chapter, in_section, in_paragraph, in_article], -1,
    )
    # a title belongs to the part that waited for it, all other lines to the part opened last
    moved = np.where(opens, d.rows, np.where(e("title"), d.last(e("bab", "bagian", "paragraf"), True), -1))
    owner = d.last(moved >= 0)
    owner = np.where(owner >= 0, moved[owner], -1)
    steps = [owner]
    while len(steps[-1]) and (steps[-1] >= 0).any():
        steps.append(np.where(steps[-1] >= 0, above[steps[-1]], -1))
    chain = np.stack(steps[::-1], axis=1)
    chain[:, 0] = d.rows  # the document's 0 comes first
    places = np.where(np.arange(chain.shape[1]) == 0, 0, place[chain])
    some = chain >= 0
    path = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(some.sum(axis=1))], pa.int32()), pa.array(places[some], pa.int32()))
    explained = opens & (scope >= 0) & is_(event[scope], "penjelasan") & (above == scope)
    new = {
        "event": pa.array(EVENTS).take(pa.array(event)), "opens": pa.array(opens), "place": pa.array(place, pa.int32()), "path": path,
        "parent": pa.array(np.where(above >= 0, place[above], 0), pa.int32(), mask=~opens), "unnamed": pa.array(d.count(e("malformed", "unstructured")), pa.int64()), "explained": pa.array(explained),
    }
    return pa.RecordBatch.from_pydict({c: t.column(c).combine_chunks() for c in KEPT} | new)


KEPT = ("document_id", "page", "line_no", "line", "number", "own_title", "role", "amending", "numbered", "amended", "bound", "item")


def _placed(pages: DataFrame) -> DataFrame:
    """told_lines with what _place finds, and for opened parts `type` and `identifier`."""
    line, look, event = F.col("line"), F.col("look"), F.col("event")
    own_title = F.when(look == "bab", _part(line, CHAPTER, 2)).when(look == "bagian", _part(line, SECTION, 2)).when(look == "paragraf", _part(line, PARAGRAPH, 2))
    article = look == "pasal"
    said = F.concat_ws(" ", line, F.col("ahead"))
    initial, end = F.lower(F.substring(line, 1, 1)), F.lower(F.substring(line, -3, 3))
    digit = initial.isin(*"0123456789a")
    flags = {
        "amending": article & said.rlike(AMENDING), "numbered": article & F.col("ahead").rlike(NUMBERED_ITEM), "amended": digit & line.rlike(AMENDED_ITEM), "bound": digit & line.rlike(AMENDED_BOUND), "item": (initial == "a") & line.rlike(NUMBERED_ITEM.replace(r"\b", "^", 1)),
        "citing_article": end.isin("lam", "ada", "dan", "tau") & line.rlike(CITING_ARTICLE), "citing_clause": (end == "yat") & line.rlike(CITING_CLAUSE),
    }
    rows = told_lines(pages).withColumn("own_title", own_title).withColumn("role", F.when((look == "text") & (initial == "k"), _role(line)))
    malformed = F.when((look == "text") & initial.isin("b", "p") & line.rlike(MALFORMED), F.lower(F.substring(F.regexp_extract(line, MALFORMED, 1), 1, 4)))
    rows = rows.select(
        "document_id", "page", "line_no", "first", "line", "number", "look", "opening", "own_title", "role", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()], malformed.alias("malformed"),
        F.col("role").isNotNull().alias("has_role"), ((look == "text") & (F.col("role").isNotNull() | _title_like(line))).alias("title_like"), F.col("own_title").isNull().alias("untitled"),
    )
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in KEPT)
    rows = rows.mapInArrow(by_documents(_place), f"{kinds}, event string, opens boolean, place int, path array<int>, parent int, unnamed long, explained boolean")
    unnamed = event.isin("malformed", "unstructured")
    article = F.concat(F.lit("Pasal "), F.translate(F.upper(F.regexp_replace(F.col("number"), r"\s+", "")), "O", "0"))
    name = (
        F.when(event == "bab", F.concat(F.lit("BAB "), F.upper(F.regexp_extract(line, CHAPTER, 1)))).when(event == "bagian", F.concat(F.lit("Bagian "), F.regexp_extract(line, SECTION, 1))).when(event == "paragraf", F.concat(F.lit("Paragraf "), F.upper(F.regexp_extract(line, PARAGRAPH, 1))))
        .when(event == "pasal", article).when(event == "ayat", F.concat(F.lit("Ayat ("), F.upper(F.regexp_extract(line, CLAUSE, 1)), F.lit(")"))).when(event == "list_item", F.regexp_extract(line, CLAUSE, 1))
        .when(event == "named", line).when(unnamed, F.concat(F.lit("Unstructured "), "unnamed")).otherwise(F.initcap(event))
    )
    kind = F.when(unnamed, "unstructured").when(event == "named", F.col("role")).otherwise(event)
    own = [((event == "pasal") & F.col(c)).alias(c) for c in ("amending", "numbered")]
    return rows.select("document_id", "page", "line_no", "line", *own, "amended", "bound", "item", "event", "opens", "place", "path", kind.alias("type"), name.alias("identifier"), "parent", "own_title", "role", "explained")


def _amendments(rows: DataFrame) -> DataFrame:
    """Opened articles with `explicit`: the place of the article whose amendments they belong to, their own if they amend.

    An amending article quotes the next article; each item that says so lets it quote one more. Two articles in a row without an
    item, an explanation or an annex end that.
    """
    order = Window.partitionBy("document_id").orderBy("page", "line_no")
    event = F.col("event")
    explains = F.col("type_of_scope") == "penjelasan"
    owner = (event == "pasal") & (F.col("amending") | (explains & F.col("numbered")))
    scope = F.last(F.when(event.isin("penjelasan", "lampiran"), event), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.filter(event.isin("pasal", "penjelasan", "lampiran") | F.col("amended"))
    rows = rows.select("document_id", "page", "line_no", "event", "place", "identifier", "amending", "numbered", "amended").withColumn("type_of_scope", F.coalesce(scope, F.lit("")))
    step = F.when(owner, "owner").when(event == "pasal", "article").when(event.isin("penjelasan", "lampiran"), "end").when(F.col("amended"), "item")
    steps = rows.withColumn("step", step).filter("step is not null").withColumn("lag", F.lag("step").over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("owned", F.last(F.when(F.col("step") == "owner", F.struct(F.col("place").alias("p"), F.lower("identifier").alias("n"))).when(F.col("step") == "end", F.struct(F.lit(None).cast("int").alias("p"), F.lit(None).cast("string").alias("n"))), ignorenulls=True).over(so_far)).withColumn("turn", F.sum(F.col("step").isin("owner", "end").cast("int")).over(so_far))
    double = (F.col("step") == "article") & (F.col("lag") == "article")
    dead = F.max(double).over(Window.partitionBy("document_id", "turn").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0))
    quoted = (F.col("step") == "article") & F.col("lag").isin("owner", "item") & ~F.coalesce(dead, F.lit(False))
    return steps.filter("event = 'pasal'").select("document_id", "place", F.when((F.col("step") == "owner") | quoted, F.col("owned.p")).alias("explicit"), F.col("owned.n").alias("owner_name"), (F.col("step") == "owner").alias("amends")).filter("explicit is not null")


def _node_id(place: Column) -> Column:
    return F.format_string("%s:legal:%05d", F.col("document_id").cast("string"), place)


def tree_nodes(pages: DataFrame) -> DataFrame:
    """What legal_tree says of where its parts stand: document_id, node_id, place, type, parent, page_start, page_end. Texts,
    titles, amendments and repeats, which take most of its work, are not made."""
    rows = _placed(pages).select("document_id", "page", "opens", "place", "type", "parent", F.explode("path").alias("node"))
    opened = F.col("opens") & (F.col("place") == F.col("node"))
    parts = rows.groupBy("document_id", "node").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.max(F.when(opened, F.struct("type", "parent"))).alias("x")).filter("node > 0")
    parts = parts.select("document_id", F.col("node").alias("place"), "x.type", "x.parent", "page_start", "page_end")
    roots = pages.groupBy("document_id").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    roots = roots.select("document_id", F.lit(0).alias("place"), F.lit("document").alias("type"), F.lit(None).cast("int").alias("parent"), "page_start", "page_end")
    nodes = roots.unionByName(parts)
    return nodes.select("document_id", _node_id(F.col("place")).alias("node_id"), "place", "type", F.when(F.col("parent").isNotNull(), _node_id(F.col("parent"))).alias("parent"), "page_start", "page_end")


def legal_tree(pages: DataFrame, titles: DataFrame | None = None, text: str = "whole") -> DataFrame:
    """Pages (document_id, page, text) -> the parts of each document (document_id and NODE), place by place, the document first.

    A part's text holds its own lines and those of all parts below, its pages are theirs. amendment_scope: the node of the
    amending article, or the item of the parent that announces the amendment. source_duplicate_of: of two articles in a row that
    repeat an earlier such pair (same parent, name, scope and text but for case and white space), the part each repeats. Titles
    (document_id, title) name the documents. A document without lines has its document part alone; null texts have no lines.
    All windows run over one document's lines in one order; what is gathered is the lines of one part. `text` is what is kept of the
    texts: whole, sha256 (in hex) or none (no such column). A line is in the texts of all parts above it, so texts are made where
    the document's lines lie, are written once, and whole ones meet the other columns last; nothing else carries them.
    """
    node = _node_id
    rows = stored(_placed(pages), "lines")
    spread = rows.repartition("document_id").select("document_id", "page", "line_no", "line", "bound", "item", "event", "place", "parent", F.explode("path").alias("node"))  # grouped and sorted below without another shuffle
    article = F.max((F.col("event") == "pasal") & (F.col("place") == F.col("node")))
    texts = spread.groupBy("document_id", "node").agg(F.min("page").alias("first"), F.max("page").alias("last"), article.alias("article"), F.array_join(F.sort_array(F.collect_list(F.struct("page", "line_no", "line")))["line"], "\n").alias("text"))
    plain = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    kept = {"whole": [F.col("text")], "sha256": [F.unhex(F.sha2("text", 256)).alias("digest")], "none": []}[text]
    texts = stored(texts.select("document_id", "node", "first", "last", F.when(F.col("article"), F.unhex(F.md5(plain))).alias("said"), (F.col("article") & F.col("text").rlike(AMENDING)).alias("text_amends"), *kept), "texts")
    named = rows.filter("event = 'title'").select("document_id", F.element_at("path", -1).alias("node"), F.struct("page", "line_no", "line", "role").alias("t")).groupBy("document_id", "node").agg(F.sort_array(F.collect_list("t")).alias("t"))
    parts = rows.filter("opens").select("document_id", F.col("place").alias("node"), "type", "identifier", "parent", "explained", F.when(F.col("event") == "named", F.col("line")).otherwise(F.col("own_title")).alias("own_title"))
    whole = pages.groupBy("document_id").agg(F.min("page").alias("from_page"), F.max("page").alias("to_page"))
    if titles is not None:
        whole = whole.join(titles.select("document_id", "title"), "document_id", "left")
    else:
        whole = whole.withColumn("title", F.lit(None).cast("string"))
    roots = whole.select("document_id", F.lit(0).alias("node"), F.lit("document").alias("type"), F.col("document_id").cast("string").alias("identifier"), F.lit(None).cast("int").alias("parent"), F.col("title").alias("own_title"), "from_page", "to_page")
    nodes = roots.unionByName(parts, allowMissingColumns=True).join(texts.drop("text"), ["document_id", "node"], "left").join(named, ["document_id", "node"], "left")
    named_by = F.array_join(F.transform("t", lambda x: x["line"]), " ")
    nodes = nodes.select(
        "document_id", "node", "type", "identifier", "parent", "explained", F.nullif(F.concat_ws(" ", "own_title", named_by), F.lit("")).alias("title"), F.when(F.col("t").isNotNull(), F.element_at("t", -1)["role"]).otherwise(_role(F.col("own_title"))).alias("role"),
        F.coalesce("from_page", "first").alias("page_start"), F.coalesce("to_page", "last").alias("page_end"), "said", "text_amends", *(["digest"] if text == "sha256" else []),
    )
    # the last line of the parent, before an article, that announces an amendment
    inside = Window.partitionBy("document_id", "node").orderBy("page", "line_no")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    index = F.row_number().over(inside)
    lines = spread.drop("line").withColumn("i", index).withColumn("bound", F.last(F.when(F.col("bound"), F.col("i")), ignorenulls=True).over(earlier)).withColumn("item", F.last(F.when(F.col("item"), F.col("i")), ignorenulls=True).over(earlier))
    announced = lines.filter("event = 'pasal' and node = parent and (bound is not null or item is not null)").select("document_id", F.col("place").alias("node"), "bound", "item")
    scoped = nodes.join(_amendments(rows).withColumnRenamed("place", "node"), ["document_id", "node"], "left").join(announced, ["document_id", "node"], "left")
    implied = F.when(F.col("explained") & F.col("item").isNotNull(), F.concat(node(F.col("parent")), F.lit(":penjelasan-item:"), "item")).when(F.col("bound").isNotNull(), F.concat(node(F.col("parent")), F.lit(":amendment-item:"), "bound"))
    stands = F.col("explicit").isNotNull() & (F.col("text_amends") | F.col("amends") | (F.col("owner_name") != F.lower("identifier")))
    explicit = F.when(F.col("explicit").isNotNull(), node(F.col("explicit")))
    scoped = scoped.withColumn("amendment_scope", F.when(stands | (F.col("type") != "pasal"), explicit).otherwise(F.coalesce(implied, explicit)))
    # pairs of articles that repeat an earlier pair
    key = F.when(F.col("type") == "pasal", F.unhex(F.md5(F.concat_ws("\x00", F.coalesce("parent", F.lit(-1)).cast("string"), F.lower("identifier"), F.coalesce("amendment_scope", F.lit("")), F.hex("said")))))
    own = Window.partitionBy("document_id").orderBy("node")
    pairs = scoped.withColumn("key", key).withColumn("next", F.lead("key").over(own))
    both = F.col("key").isNotNull() & F.col("next").isNotNull()
    first = F.min(F.when(both, F.col("node"))).over(Window.partitionBy("document_id", "key", "next"))
    pairs = pairs.withColumn("first", F.when(both & (first < F.col("node")), first)).withColumn("before", F.lag("first").over(own))
    out = pairs.select(
        "document_id", node(F.col("node")).alias("node_id"), F.col("node").alias("place"), "type", "identifier", F.when(F.col("parent").isNotNull(), node(F.col("parent"))).alias("parent"), "title", "role",
        "page_start", "page_end", "amendment_scope", F.when(F.coalesce("first", F.col("before") + 1).isNotNull(), node(F.coalesce("first", F.col("before") + 1))).alias("source_duplicate_of"),
        *([F.coalesce(F.lower(F.hex("digest")), F.sha2(F.lit("").cast("binary"), 256)).alias("text")] if text == "sha256" else []),
    )
    if text != "whole":
        return out
    return out.join(texts.select("document_id", F.col("node").alias("place"), "text"), ["document_id", "place"], "left").select("document_id", *NODE[:-1], F.coalesce("text", F.lit("")).alias("text"))
