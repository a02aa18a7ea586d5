"""Guards over text: folded views, patterns of injected instructions, secrets and personal numbers."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters that look like others, and the ones they stand for.
LOOKALIKE = "аеорсхіјѕһкмтвуԝԛԁαεορςικμτχβνυζη"
PLAIN = "aeopcxijshkmtbywqdaeopsikmtxbvuzn"
#: Patterns in questions, in passages, of secrets, and of personal numbers.
QUESTION = (
    r"(?i)\babaikan (semua )?(instruksi|aturan|perintah)( sebelumnya| di atas| ini)?\b",
    r"(?i)\blupakan (semua )?(instruksi|aturan|perintah)\b",
    r"(?i)\bignore (all )?(previous|prior|your|the) (instructions?|rules?)\b",
    r"(?i)^\s*(kamu|anda|kau|you)\s+(sekarang\s+)?(adalah|bertindak)\s+sebagai\b",
    r"(?i)\b(ungkap|tampilkan|cetak|bocorkan|beberkan|bongkar|spill|leak|reveal).{0,24}\b(system prompt|developer message)\b",
    r"(?i)\b(api[- ]?key|access token|password|credential).{0,20}\b(ungkap|tampilkan|beri|bocorkan|spill|leak)\b",
    r"(?i)\b(jailbreak|do anything now|developer mode|act as|roleplay)\b",
)
PASSAGE = (
    r"(?i)\b(ignore|disregard|override|replace)\b.{0,30}\b(system|instructions?|rules?|prompt)\b",
    r"(?i)\b(you are|act as|pretend to be|roleplay as)\b.{0,20}\b(a |an |the )?(assistant|ai|bot|model)\b",
    r"(?i)\b(ungkap|tampilkan|bocorkan|beberkan|spill|leak|reveal)\b.{0,24}\b(system prompt|developer message|konfigurasi|instruksi)\b",
    r"(?i)\b(api[- ]?key|access token|password|credential|secret)\b.{0,20}\b(ungkap|tampilkan|beri|bocorkan|spill|leak|reveal|send|return|print)\b",
)
SECRETS = (
    r"\bgsk_[A-Za-z0-9]+",
    r"\bsk-(?:proj-)?[A-Za-z0-9\-_]{8,}",
    r"\bxox[bpars]-[A-Za-z0-9\-]+",
    r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]{8,})?",
    r"(?i)\b(api[_-]?key|secret[_-]?key|access[_-]?token)\s*[:=]\s*['\"]?\S+",
)
PERSONAL = (r"\b\d{16}\b", r"\b(?:\+62|62|0)8[1-9][\d\s-]{7,12}\b", r"\b\d{2}\.\d{3}\.\d{3}\.\d{1}-\d{3}\.\d{3}\b")


@F.pandas_udf(StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility form of a text; Spark has no function for it. ASCII texts go through it unchanged."""
    return _nfkc(text)


def folded(text: Column) -> Column:
    """The view that patterns are sought in: compatibility form, no invisible characters, lookalike letters replaced."""
    return F.translate(F.regexp_replace(nfkc(text), "[\\u200b-\\u200d\\ufeff]", " "), LOOKALIKE, PLAIN)


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern is found; false for null."""
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return F.coalesce(found, F.lit(False))


def asks_to_break_rules(question: Column) -> Column:
    """Whether a question holds injected instructions, plainly or in base64."""
    flat = F.trim(F.regexp_replace(question, r"\s+", " "))
    spans = F.filter(F.regexp_extract_all(question, F.lit(r"\b[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/=])"), F.lit(0)), lambda x: F.length(x) % 4 == 0)
    hidden = F.array_join(F.filter(F.transform(spans, lambda x: F.try_validate_utf8(F.try_to_binary(x, F.lit("base64")).cast("string"))), lambda x: x.isNotNull()), "\n")
    return matches_any(folded(flat), QUESTION) | matches_any(folded(hidden), tuple(p.replace("(?i)", "(?im)") for p in QUESTION))


def redacted(text: Column, patterns: tuple[str, ...], mark: str) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, mark)
    return text


def normalised(text: Column) -> Column:
    """Compatibility form; no invisible characters; a line that ends with a hyphen joined to one that starts in lower case, the
    hyphen kept; white space collapsed in each line; runs of blank lines as one. Null stays null.
    """
    plain = F.regexp_replace(nfkc(text), "[\\u200b-\\u200d\\ufeff]", "")
    joined = F.regexp_replace(plain, r"(?<=[^\s])-[ \t]*\r?\n[ \t]*(?=\p{Ll})", "-")
    lines = F.transform(F.split(joined, r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\n+|\n+$", "")
