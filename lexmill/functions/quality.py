"""How readable a page's text is, and whether it must be read from its image."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shortest text of a page, the score below which it is read again, and what lines are fragments.
SHORTEST, READ_AGAIN, FRAGMENT_WORDS, FRAGMENT_SHARE, FRAGMENT_LINES = 40, 0.65, 2, 0.6, 10
REPLACEMENT = "�"


def _share(kept: Column, whole: Column) -> Column:
    return F.when(whole > 0, kept / whole).otherwise(0.0)


def fragment_share(text: Column) -> Column:
    """Share of lines that aren't blank and hold at most two words; 0 with fewer than ten such lines."""
    stripped = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    lines = F.filter(stripped, lambda x: x != "")
    short = F.size(F.filter(lines, lambda x: F.size(F.split(x, " ")) <= FRAGMENT_WORDS))
    return F.when(F.size(lines) < FRAGMENT_LINES, 0.0).otherwise(short / F.size(lines))


def page_quality(text: Column, shortest: int = SHORTEST) -> Column:
    """(score, flags) of a page: length, readable and alphanumeric characters and replacement marks, weighed .25, .35, .35, .05.

    Short texts and ones of fragments get at most .6. Null counts as empty; text without visible characters scores 0.
    """
    whole = F.coalesce(text, F.lit(""))
    compact = F.regexp_replace(whole, r"(?U)\s+", "")
    n = F.length(compact)
    parts = F.struct(
        F.length(whole).alias("length"), n.alias("n"), _share(n - F.length(F.regexp_replace(compact, r"[^\p{C}\p{Z}]+", "")), n).alias("readable"),
        _share(F.length(F.regexp_replace(compact, r"[^\p{L}\p{N}]+", "")), n).alias("alnum"), _share(n - F.length(F.replace(compact, F.lit(REPLACEMENT), F.lit(""))), n).alias("replaced"), fragment_share(whole).alias("fragments"),
    )

    def told(p: Column) -> Column:
        short, broken = p["length"] < shortest, p["fragments"] > FRAGMENT_SHARE
        names = {"insufficient_text": short, "control_or_unreadable_characters": p["readable"] < 0.97, "low_alphanumeric_ratio": p["alnum"] < 0.55, "replacement_glyphs": p["replaced"] > 0.005, "missing_word_spaces": broken}
        flags = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in names.items()]))
        score = 0.25 * F.least(F.lit(1.0), p["length"] / max(1, 3 * shortest)) + 0.35 * p["readable"] + 0.35 * F.least(F.lit(1.0), p["alnum"] / 0.7) + 0.05 * F.greatest(F.lit(0.0), 1 - 20 * p["replaced"])
        capped = F.when(short | broken, F.least(score, F.lit(0.6))).otherwise(score)
        nothing = F.array_compact(F.array(F.when(short, F.lit("insufficient_text")), F.lit("empty_page")))
        return F.struct(F.when(p["n"] == 0, 0.0).otherwise(F.round(F.least(F.greatest(capped, F.lit(0.0)), F.lit(1.0)) + 1e-9, 4)).alias("score"), F.when(p["n"] == 0, nothing).otherwise(flags).alias("flags"))

    return F.transform(F.array(parts), told)[0]  # the shares are taken once


def page_kind(text: Column, has_images: Column, shortest: int = SHORTEST) -> Column:
    """text; else scanned if the page has images, else empty."""
    return F.when(F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")) >= shortest, "text").when(F.coalesce(has_images, F.lit(False)), "scanned").otherwise("empty")


def needs_reading(kind: Column, score: Column, least: float = READ_AGAIN) -> Column:
    """Whether a page must be read from its image: scanned ones and unreadable text, never empty pages."""
    return (kind != "empty") & ((score < least) | (kind == "scanned"))
