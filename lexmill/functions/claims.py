"""Words, numbers and qualifiers that tell whether evidence supports a claim."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content, words of one meaning, number words, and qualifiers that evidence must have too.
STOP = (
    "adalah atau dan dari dengan di ini itu ke pada yang untuk baik bila "
    "karena maupun sebagaimana sebesar serta the and or of to in"
).split()
SAME = {"dilakukan": "laku", "melakukan": "laku", "mengalami": "alami", "kerugian": "rugi", "penutupan": "tutup"}
UNITS = "nol satu dua tiga empat lima enam tujuh delapan sembilan".split()
NUMBERS = {w: str(i) for i, w in enumerate(UNITS)}
NUMBERS |= {"sepuluh": "10", "sebelas": "11", "seratus": "100", "seribu": "1000", "setengah": "0.5"}
NUMBERS |= {f"{w} belas": str(10 + i) for i, w in enumerate(UNITS) if i > 1} | {f"{w} puluh": str(10 * i) for i, w in enumerate(UNITS) if i > 1}
QUALIFIERS = "berkelanjutan berturut maksimal minimal paling sebelum setelah tanpa tidak".split()
PHRASES = ((r"\bpemutusan\s+hubungan\s+kerja\b", "phk"), (r"\btidak\s+diikuti(?:\s+dengan)?\s+penutupan\b", "tanpa penutupan"))


def content_words(text: Column) -> Column:
    """Different words of more than two letters or digits that carry content, words of one meaning as one. Null: none."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in PHRASES:
        lower = F.regexp_replace(lower, pattern, to)
    same = F.create_map(*[F.lit(x) for pair in SAME.items() for x in pair])
    kept = F.filter(F.regexp_extract_all(lower, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*STOP))
    return F.array_distinct(F.transform(kept, lambda w: F.coalesce(F.try_element_at(same, w), w)))


def numbers(text: Column) -> Column:
    """Different numbers of a text, number words as digits, with a dot before decimals."""
    words = sorted(NUMBERS, key=len, reverse=True)
    text = F.coalesce(text, F.lit(""))
    digits = text
    for w in words:
        digits = F.regexp_replace(digits, rf"(?i)\b{w}\b", NUMBERS[w])
    spelled = F.when(text.rlike(rf"(?i)\b({'|'.join(words)})\b"), digits).otherwise(text)
    return F.array_distinct(F.transform(F.regexp_extract_all(spelled, F.lit(r"\b\d+(?:[.,]\d+)?\b"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("."))))


def support(claim_words: Column, evidence_words: Column) -> Column:
    """Share of the claim's words that the evidence has; 0 without words."""
    return F.when(F.size(claim_words) == 0, 0.0).otherwise(F.size(F.array_intersect(claim_words, evidence_words)) / F.size(claim_words))


def allowed(claim_words: Column, claim_numbers: Column, evidence_words: Column, known_numbers: Column) -> Column:
    """Whether the evidence has all numbers and qualifiers of the claim."""
    qualifiers = F.array_intersect(claim_words, F.array(*map(F.lit, QUALIFIERS)))
    return (F.size(F.array_except(claim_numbers, known_numbers)) == 0) & (F.size(F.array_except(qualifiers, evidence_words)) == 0)
