"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Words that are no key terms.
STOP_WORDS = (
    "adalah atau dan dari dengan di ini itu ke pada yang untuk baik bila "
    "karena maupun sebagaimana sebesar serta sebagai bahwa dalam oleh pada "
    "agar setiap orang telah sudah akan dapat harus wajib the and or of to "
    "in on at for with by from this that these those not no a an"
).split()


def collapsed(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores (ASCII)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def token_count(text: Column) -> Column:
    """Runs of letters, digits and underscores, and each other visible character."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def word_list(text: Column) -> Column:
    return F.filter(F.split(collapsed(text), " "), lambda w: w != "")


def fingerprint(text: Column) -> Column:
    """SHA-256 of the text in lower case with white space collapsed."""
    return F.sha2(F.lower(collapsed(text)), 256)


def key_terms(text: Column, most: int = 32, stop: tuple[str, ...] | list[str] = STOP_WORDS) -> Column:
    """The first `most` different terms of more than 3 characters that are no stop words, in order; then all other numbers."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    long = F.filter(F.regexp_extract_all(lower, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 3) & ~w.isin(*stop))
    numbers = F.transform(F.regexp_extract_all(lower, F.lit(r"\b\d+(?:[.,]\d+)?\b"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")))
    return F.array_distinct(F.concat(F.slice(F.array_distinct(long), 1, most), numbers))
