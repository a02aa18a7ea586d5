"""Queries on the structure of texts: sentences, marks, chunks, normal forms and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import guards, sentences
from lexmill.functions.words import lines
from lexmill.operators import chunking
from lexmill.operators.segments import segments

from . import statutes
from .registry import Tables, query

_KNOWN = "|".join(sorted(sentences.ABBREVIATIONS, key=len, reverse=True))


def sentences_sql(column: str) -> str:
    """SQL of the sentences of a text: masked twice, as matches here take the character before the abbreviation too."""
    text = rf"trim(regexp_replace(coalesce({column}, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
    for _ in range(2):
        text = rf"regexp_replace({text}, '(^|[^\p{{L}}\p{{N}}_])({_KNOWN})\.', '\1\2' || chr(57344), 'g')"
    ended = rf"""regexp_replace({text}, '([.!?]+[”"]?)[ ]+([A-Z0-9“"(])', '\1' || chr(57345) || '\2', 'g')"""
    return f"list_filter(list_transform(string_split({ended}, chr(57345)), lambda x: replace(x, chr(57344), '.')), lambda x: x <> '')"


@query(rf"""WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS part, unnest(range(1, 1 + len(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')))) AS paragraph FROM documents), s AS (SELECT doc_id, paragraph, {sentences_sql("part")} AS s FROM p) SELECT doc_id, paragraph, unnest(range(1, 1 + len(s))) AS place, unnest(s) AS sentence FROM s""")
def tx_sentences(t: Tables) -> DataFrame:
    parts = t.documents.select("doc_id", F.posexplode(sentences.paragraphs(F.col("text"))).alias("p", "part"))
    split = parts.select("doc_id", (F.col("p") + 1).cast("long").alias("paragraph"), F.posexplode(sentences.sentences(F.col("part"))).alias("k", "sentence"))
    return split.select("doc_id", "paragraph", (F.col("k") + 1).cast("long").alias("place"), "sentence")


@query()
def tx_marker(t: Tables) -> DataFrame:
    """The structural marks of all lines."""
    found = t.documents.select("doc_id", F.posexplode(lines(F.col("text"))).alias("line_no", "line")).withColumn("m", sentences.marker(F.col("line")))
    return found.filter("m is not null").select("doc_id", "line_no", "m.*")


@query()
def tx_chunk(t: Tables) -> DataFrame:
    """Chunks of the statutes' segments, by the default budgets."""
    return chunking.chunked(segments(statutes.pages(t)), F.lit("").alias("title"), F.lit(1)).drop("unit", "retrieval_text", "parent_text", "repeated")


@query()
def tx_retrieval_text(t: Tables) -> DataFrame:
    """What is searched and shown of each chunk: its text under a header, and its unit's text."""
    chunks = chunking.chunked(segments(statutes.pages(t)), F.concat(F.lit("Statuta "), F.col("document_id")), F.lit(1))
    return chunks.select("document_id", "chunk_id", F.regexp_extract("retrieval_text", r"^([^\n]*)", 1).alias("header"), F.sha2("retrieval_text", 256).alias("retrieval_text"), F.sha2("parent_text", 256).alias("parent_text"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '([^\s])-[ \t]*\n[ \t]*(\p{Ll})', '\1-\2', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS digest FROM documents""")
def tx_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(guards.normalised(F.col("text")), 256).alias("digest"))


def _any(column: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


@query(f"""SELECT doc_id FROM documents WHERE {_any("text", guards.PASSAGE)}""")
def g_context_guard(t: Tables) -> DataFrame:
    return t.documents.filter(guards.matches_any(guards.folded(F.col("text")), guards.PASSAGE)).select("doc_id")


@query(rf"""SELECT conv_id, turn, coalesce({_any("trim(regexp_replace(text, '[ \t\n]+', ' ', 'g'))", guards.QUESTION)}, false) AS blocked FROM conversations WHERE role = 'user'""")
def g_input_guard(t: Tables) -> DataFrame:
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", guards.asks_to_break_rules(F.col("text")).alias("blocked"))


def _without(column: str, patterns: tuple[str, ...], mark: str) -> str:
    for p in patterns:
        quoted = p.replace("'", "''")
        column = f"regexp_replace({column}, '{quoted}', '{mark}', 'g')"
    return column


@query(f"""SELECT doc_id, sha256({_without(_without("text", guards.SECRETS, "[redacted]"), guards.PERSONAL, "[PII]")}) AS redacted, {_without("text", guards.SECRETS, "[redacted]")} <> text AS secrets, {_without("text", guards.PERSONAL, "[PII]")} <> text AS personal FROM documents""")
def g_redact_secrets(t: Tables) -> DataFrame:
    text = F.col("text")
    clean = guards.redacted(text, guards.SECRETS, "[redacted]")
    return t.documents.select("doc_id", F.sha2(guards.redacted(clean, guards.PERSONAL, "[PII]"), 256).alias("redacted"), (clean != text).alias("secrets"), (guards.redacted(text, guards.PERSONAL, "[PII]") != text).alias("personal"))
