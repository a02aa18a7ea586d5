"""What of a conversation may be remembered: redaction, and questions that point back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .questions import normal_question, topics

#: What is taken out of remembered text, in this order, with what stands for it; and words that point back.
REDACTED = (
    (r"(?U)(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+(?![\w.-])", "[REDACTED_EMAIL]"),
    (r"(?<!\d)\d{16}(?!\d)", "[REDACTED_ID]"),
    (r"(?U)(?<![\w\d])(?:\+62|62|0)[\s.-]?(?:\d[\s.-]?){8,13}\d(?![\w\d])", "[REDACTED_PHONE]"),
    (r"(?i)\b(bearer|api[ _-]?key|access[ _-]?token|refresh[ _-]?token|token)\s*[:=]?\s*([A-Za-z0-9._~+/=-]{8,})", "$1 [REDACTED_SECRET]"),
)
POINTS_BACK = r"(?i)\b(yang tadi|yang itu|ketentuannya|bagaimana dengan|gimana dengan|what about|how about|that rule|the previous)\b"
AMBIGUOUS = r"(?i)\b(yang tadi|yang itu|the previous)\b"


def redacted_memory(text: Column) -> Column:
    """Text without addresses, identity numbers, telephone numbers and secrets, as a struct (text, redactions). Null: null, 0."""
    out, count = text, F.lit(0)
    for pattern, to in REDACTED:
        count = count + F.coalesce(F.regexp_count(out, F.lit(pattern)), F.lit(0))
        out = F.regexp_replace(out, pattern, to)
    return F.struct(out.alias("text"), count.cast("int").alias("redactions"))


def remembered_context(question: Column, turns: Column) -> Column:
    """What a question that points back is about: of the last of `turns` (array of structs question, topics, document_ids, articles,
    titles, source) its words, topics, documents and articles. Null unless the question points back, names no topic itself, there
    is a turn, and, where it is ambiguous, the last two turns share their topics or documents.
    """
    last, before = F.element_at(turns, -1), F.when(F.size(turns) > 1, F.element_at(turns, -2))
    same = lambda field: F.array_sort(F.array_distinct(F.coalesce(last[field], F.array().cast("array<string>")))) == F.array_sort(F.array_distinct(F.coalesce(before[field], F.array().cast("array<string>"))))
    unclear = question.rlike(AMBIGUOUS) & (F.size(turns) > 1) & ~same("topics") & ~same("document_ids")
    usable = question.rlike(POINTS_BACK) & (F.size(topics(normal_question(question))) == 0) & (F.size(turns) > 0) & ~F.coalesce(unclear, F.lit(False))
    said = redacted_memory(F.concat_ws(" ", last["question"], last["titles"]))["text"]
    return F.when(usable, F.struct(F.substring(said, 1, 400).alias("text"), last["topics"].alias("topics"), last["document_ids"].alias("document_ids"), last["articles"].alias("articles"), last["source"].alias("source")))
