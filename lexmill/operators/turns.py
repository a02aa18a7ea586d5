"""Turns of conversations: questions with their answers, what of them goes into prompts, and summaries of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.memory import redacted_memory
from lexmill.functions.questions import normal_question, topics

#: Turns that a summary keeps, and lengths within it.
KEPT, QUESTION, NAME, TITLE, EACH = 8, 240, 80, 120, 3
OLDER = "Ringkasan topik terdahulu, bukan sumber hukum"
TURN = "struct<source:string,question:string,topics:array<string>,document_ids:array<string>,articles:array<string>,titles:array<string>>"


def turn_pairs(messages: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """(key, question_at, answer_at, question, answer): each assistant's message with the user's message just before it.

    Messages of other roles don't count; of several questions in a row the last is the one answered; an answer without a question
    makes no pair. Null keys go. A conversation's messages are sorted and read in a stream.
    """
    own = messages.filter(F.col(key).isNotNull() & F.col(role).isin("user", "assistant")).select(key, F.col(order).alias("at"), F.col(role).alias("r"), F.coalesce(text, F.lit("")).alias("x"))
    seen = own.withColumn("before", F.lag(F.struct("at", "r", "x")).over(Window.partitionBy(key).orderBy("at")))
    return seen.filter("r = 'assistant' and before.r = 'user'").select(key, F.col("before.at").alias("question_at"), F.col("at").alias("answer_at"), F.col("before.x").alias("question"), F.col("x").alias("answer"))


def history(pairs: DataFrame, key: str, most: int = 2, cited: Column | None = None, allowed: Column | None = None) -> DataFrame:
    """The newest pairs of each conversation that may stand in a prompt: (key, place from 1, question, answer).

    Left out are pairs without citation, ones that a guard has stopped, blank ones, and all that hold anything to be redacted.
    """
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    rows = pairs.withColumn("question", strip(F.col("question"))).withColumn("answer", strip(F.col("answer")))
    clean = lambda c: redacted_memory(F.col(c))["redactions"] == 0
    fine = (F.col("question") != "") & (F.col("answer") != "") & clean("question") & clean("answer")
    for more in (cited, allowed):
        fine = fine if more is None else fine & F.coalesce(more, F.lit(False))
    newest = Window.partitionBy(key).orderBy(F.desc("answer_at"))
    kept = rows.filter(fine).withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= max(1, most))
    place = F.row_number().over(Window.partitionBy(key).orderBy("answer_at"))
    return kept.select(key, place.alias("place"), "question", "answer")


def summary_turn(question: Column, source: Column, citations: Column) -> Column:
    """A cited turn as TURN, everything cut to its length; null without citations (structs document_id, article, title)."""
    first = lambda field, length: F.slice(F.array_distinct(F.filter(F.transform(citations, lambda c: F.substring(c[field], 1, length)), lambda x: x != "")), 1, EACH)
    clean = redacted_memory(question)["text"]
    turn = F.struct(F.substring(source, 1, TITLE).alias("source"), F.substring(clean, 1, QUESTION).alias("question"), F.slice(topics(normal_question(question)), 1, EACH).alias("topics"), first("document_id", NAME).alias("document_ids"), first("article", NAME).alias("articles"), first("title", TITLE).alias("titles"))
    return F.when(F.size(citations) > 0, turn)


def summaries(cited_turns: DataFrame, key: str, order: str, most: int = KEPT) -> DataFrame:
    """(key, turns): the last `most` turns (column turn, TURN) of each conversation, oldest first. Null turns don't count."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    last = cited_turns.filter("turn is not null").withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= most)
    return last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "turn"))).alias("t")).select(key, F.col("t.turn").alias("turns"))


def older_line(turns: Column, most: int = 2) -> Column:
    """One line on the turns of a summary before the last `most`: at most four, each its question and titles; null if there is none."""
    older = F.slice(turns, 1, F.greatest(F.size(turns) - max(1, most), F.lit(0)))
    some = F.slice(older, F.greatest(F.size(older) - 3, F.lit(1)), 4)
    told = F.transform(some, lambda x: F.concat(F.substring(F.coalesce(x["question"], F.lit("")), 1, 160), F.lit(" ("), F.substring(F.array_join(x["titles"], ", "), 1, 120), F.lit(")")))
    return F.when(F.size(older) > 0, F.substring(F.array_join(told, "; "), 1, 500))
