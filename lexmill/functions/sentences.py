"""Sentences, paragraphs and structural markers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import collapsed, token_count

#: Abbreviations whose dot ends no sentence.
ABBREVIATIONS = (
    r"No", r"UU", r"PP", r"UUD", r"Rp", r"Dr", r"Drs", r"H", r"Hj", r"Ir", r"Br",
    r"S\.H", r"M\.H", r"dkk", r"dll", r"dsb", r"dst", r"sda",
    r"yth", r"an", r"d\.a", r"u\.b", r"u\.p",
)
#: How glued or misread article marks are mended, in this order; and what tells a citation from a heading.
REPAIRS = (
    (r"(?i)\bPasa[l1i][l1i]([0-9]+[A-Z]?)\b", "Pasal 1$1"),
    (r"(?i)\bPasa[1i]([0-9]+[A-Z]?)\b", "Pasal $1"),
    (r"\bPasal([0-9]+[A-Z]?)\b", "Pasal $1"),
)
CITED = r"(?i:Undang-Undang|Peraturan|Nomor\s+\d|Tahun\s+\d{4}|dimaksud dalam|sebagaimana)"
PREPOSITIONS = "dalam pada di ke dari dengan tentang menurut sesuai berdasarkan sebagaimana untuk atas oleh sebagai".split()
#: Private characters: a masked dot, and the place where a sentence ends.
DOT, END = "\ue000", "\ue001"


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, stripped; empty ones go."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def sentences(text: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """Sentences of a paragraph with its white space collapsed: they end at . ! or ? (a quote may follow) before white space and
    a capital, digit, quote or parenthesis, never at an abbreviation. Null and blank text: none.
    """
    known = "|".join(sorted(abbreviations, key=len, reverse=True))
    masked = F.regexp_replace(collapsed(F.coalesce(text, F.lit(""))), rf"(?U)\b({known})\.", f"$1{DOT}")
    ended = F.regexp_replace(masked, '([.!?]+[”"]?)\\s+(?=[A-Z0-9“"(])', f"$1{END}")
    return F.filter(F.split(F.replace(ended, F.lit(DOT), F.lit(".")), END), lambda x: x != "")


def visible(text: Column) -> Column:
    """Whether a text holds more than white space. Null: no."""
    return F.coalesce(text.rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))


def estimated_tokens(text: Column) -> Column:
    """Words and other visible characters; at least 1 for text that isn't blank, else 0."""
    return F.when(visible(text), F.greatest(F.lit(1), token_count(text))).otherwise(0)


def marker_line(line: Column) -> Column:
    """A line with white space collapsed and glued marks mended."""
    flat = collapsed(line)
    fixed = flat
    for pattern, to in REPAIRS:
        fixed = F.regexp_replace(fixed, pattern, to)
    chapter = F.regexp_extract(flat, r"^(?i:BAB)((?i:[IVXLCDM]+[A-Z]?))\b", 1)
    glued = F.when(chapter != "", F.concat(F.lit("BAB "), F.upper(chapter), F.substring(fixed, F.length(chapter) + 4, F.length(fixed)))).otherwise(fixed)
    return F.when(flat.rlike("(?i)pasa|^bab"), glued).otherwise(flat)  # most lines have nothing to mend


def marker(line: Column, most: int = 999) -> Column:
    """The structural mark that a line starts with: (kind, label, trailing, provenance), null where it has none.

    The first that matches of appendix, explanation, chapter, section, subsection, article (up to `most`, no citation of another
    text), paragraph, letter, considerans, resolution, and an article that follows a sentence's end within the line. provenance:
    normalized if the line was mended, else standalone or inline.
    """
    mended = F.transform(F.array(F.struct(marker_line(line).alias("fixed"), collapsed(line).alias("flat"))), lambda x: _marker(x["fixed"], x["fixed"] != x["flat"], most))  # the line is mended once
    return F.when(line.rlike(r"(?i)^\s*(?:\(|[a-z]\.|lampiran|penjelasan|bab|bagian|paragraf|menimbang|mengingat|memutuskan|menetapkan)|pasa"), mended[0])  # what any of them needs


def _marker(fixed: Column, changed: Column, most: int) -> Column:
    part = lambda pattern, k: F.regexp_extract(fixed, pattern, k)
    bare = lambda x: F.regexp_replace(x, r"^[ .:]+|[ .:]+$", "")
    found = lambda kind, label, trailing, otherwise="standalone": F.struct(F.lit(kind).alias("kind"), label.alias("label"), trailing.alias("trailing"), F.when(changed, "normalized").otherwise(otherwise).alias("provenance"))
    chapter, section, subsection = r"^(?i:BAB)\s+((?i:[IVXLCDM]+[A-Z]?))\b\s*(.*)$", r"^(?i:Bagian)\s+(.+)$", r"^(?i:Paragraf)\s+(.+)$"
    article, paragraph, letter = r"^Pasal\s+(\d+)([A-Z])?(?![a-z])(.*)$", r"^\(([0-9]+)\)\s*(.*)$", r"^([A-Za-z])\.\s+(.+)$"
    names = "|".join(PREPOSITIONS)
    inline = rf"^.{{9,}}?(?<!(?:^|\s)(?i:{names})\s?)[.?!]\s?Pasal\s+(0*\d{{1,3}})([A-Z])?(?![a-z0-9])(?!.*{CITED})(.*)$"
    number = lambda pattern: F.concat(F.lit("Pasal "), part(pattern, 1), F.upper(part(pattern, 2)))
    first_word = F.split(fixed, " ")[0]
    heading = fixed.rlike(article)
    refused = (part(article, 1).try_cast("bigint") > most) | part(article, 1).try_cast("bigint").isNull() | part(article, 3).rlike(CITED)
    empty = F.lit("")
    inner = F.when(fixed.contains("Pasal") & fixed.rlike(inline), found("article", number(inline), bare(part(inline, 3)), "inline"))
    named = (
        F.when(fixed.rlike(r"^(?i:LAMPIRAN)\b"), found("appendix", F.lit("LAMPIRAN"), empty))
        .when(fixed.rlike(r"^(?i:PENJELASAN)\b"), found("explanation", F.lit("PENJELASAN"), empty))
        .when(fixed.rlike(chapter), found("chapter", F.concat(F.lit("BAB "), F.upper(part(chapter, 1))), F.trim(part(chapter, 2))))
        .when(fixed.rlike(section), found("section", F.concat(F.lit("Bagian "), F.trim(part(section, 1))), empty))
        .when(fixed.rlike(subsection), found("subsection", F.concat(F.lit("Paragraf "), F.trim(part(subsection, 1))), empty))
        .when(heading & refused, None)
        .when(heading, found("article", number(article), bare(part(article, 3))))
        .when(fixed.rlike(r"^(?i:Menimbang|Mengingat)\b"), found("considerans", first_word, fixed))
        .when(fixed.rlike(r"^(MEMUTUSKAN|Menetapkan)\b"), found("resolution", F.upper(first_word), fixed))
        .otherwise(inner)
    )
    # the first characters tell which marks a line may have
    return (
        F.when(fixed.isNull() | (fixed == ""), None)
        .when(fixed.startswith("("), F.when(fixed.rlike(paragraph), found("paragraph", F.concat(F.lit("Ayat ("), part(paragraph, 1), F.lit(")")), F.trim(part(paragraph, 2)))).otherwise(inner))
        .when(F.substring(fixed, 2, 1) == ".", F.when(fixed.rlike(letter), found("letter", F.lower(part(letter, 1)), F.trim(part(letter, 2)))).otherwise(inner))
        .when(F.substring(fixed, 1, 1).isin(*"LlPpBbMm"), named)
        .otherwise(inner)
    )
