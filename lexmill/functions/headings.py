"""Passages that only name a part of a statute or define its words, and text cut to a length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a heading looks like, words of a rule, where definitions stand, and questions that ask for one.
HEADING = r"(?i)^(?:bab\s+[ivxlcdm]+|bagian\s+(?:ke\S+|[ivxlcdm]+)|pasal\s+\d+[a-z]?)\b"
RULING = (
    "berhak berlaku dapat diberikan dibayarkan dikenai dilarang ditetapkan harus melakukan membayar menerima mengatur "
    "memperoleh wajib applies entitled must prohibited required shall"
).split()
GENERAL_PART = r"(?i)(^|[^a-z])bab\s+i([^a-z]|$)|ketentuan\s+umum"
ASKS_MEANING = r"(?i)(^|[^a-z])(definisi|pengertian|arti|makna|dimaksud\s+dengan|apa\s+itu|apa\s+yang\s+dimaksud|pasal\s+1)([^a-z]|$)"
WORDS = 12


def heading_only(text: Column) -> Column:
    """Whether a passage is a heading of at most twelve words without one that rules anything. Null and blank: no."""
    line = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), r"^[ .:;\-—]+|[ .:;\-—]+$", "")
    words = F.regexp_extract_all(F.lower(line), F.lit(r"(?U)[\w-]+"), F.lit(0))
    return line.rlike(HEADING) & (F.size(words) <= WORDS) & ~F.arrays_overlap(words, F.array(*map(F.lit, RULING)))


def general_part(chapter: Column, section: Column) -> Column:
    """Whether a passage stands in the first chapter or the general provisions, where words are defined."""
    return F.concat_ws(" ", F.coalesce(chapter, F.lit("")), F.coalesce(section, F.lit(""))).rlike(GENERAL_PART)


def asks_meaning(question: Column) -> Column:
    return F.coalesce(question, F.lit("")).rlike(ASKS_MEANING)


def compact(text: Column, limit: int = 260) -> Column:
    """Text in one line of at most `limit` characters: what is longer ends with ..., after the last whole sentence if that is
    longer than a third of the limit."""
    line = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    head = F.substring(line, 1, limit - 3)
    ended = F.regexp_extract(head, r"(?s)^(.*[.!?]\s)", 1)
    kept = F.when(F.length(ended) > limit // 3, ended).otherwise(head)
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.rtrim(kept), F.lit("...")))
