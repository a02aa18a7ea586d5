"""Filter documents as column conditions, and the filters that a question asks for."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StringType, StructType

#: What a filter may ask of a field, and the fields that each request narrows.
OPERATORS = ("$eq", "$in", "$gte", "$lte")
FIELDS = {
    "article": ("article", "$eq"), "year": ("year", "$eq"), "regulation_type": ("regulation_type", "$eq"), "number": ("number", "$eq"), "legal_statuses": ("legal_status", "$in"),
    "published_only": ("publication_status", "$eq"), "effective_on": ("effective_date", "$lte"), "segment_kinds": ("segment_kind", "$in"), "freshness_states": ("freshness_state", "$in"), "topics": ("topics_chunk", "$in"),
}
#: Kinds of regulations as questions name them, and regulations that have a common name.
REGULATIONS = {"uu": "UU", "pp": "PP", "permenaker": "Permenaker", "perpres": "Perpres"}
NAMED = ((r"\bcipta\s+kerja\b", "UU", 6, 2023), (r"\buu\s+ketenagakerjaan\b", "UU", 13, 2003), (r"\bundang[\s-]+undang\s+ketenagakerjaan\b", "UU", 13, 2003))
ASKED = "struct<article:string,year:int,regulation_type:string,number:int,legal_status:string,segment_kinds:array<string>,freshness_states:array<string>>"


def filter_document(**asked: Any) -> dict[str, dict[str, Any]] | None:
    """The filter that the requests of FIELDS make; empty, zero, false and missing ones narrow nothing. None if none does."""
    unknown = sorted(set(asked) - set(FIELDS))
    if unknown:
        raise ValueError(f"no such request: {', '.join(unknown)}")
    out: dict[str, dict[str, Any]] = {}
    for request, (field, operator) in FIELDS.items():
        value = asked.get(request)
        if value:
            out[field] = {operator: "published" if request == "published_only" else list(value) if operator == "$in" else value}
    return out or None


def _fits(kind: DataType, value: Any) -> bool:
    """Whether a value can equal a column's: text is never a number."""
    if isinstance(value, str):
        return isinstance(kind, StringType)
    if isinstance(value, (bool, int, float)):
        return isinstance(kind, (NumericType, BooleanType))
    return False


def _equal(field: Column, kind: DataType | None, value: Any) -> Column:
    if kind is None or value is None:
        return F.lit(value is None) if kind is None else field.isNull()
    if isinstance(kind, ArrayType):
        same = isinstance(value, (list, tuple)) and all(_fits(kind.elementType, x) for x in value)
        return field == F.array(*map(F.lit, value)).cast(kind) if same else F.lit(False)
    if not _fits(kind, value):
        return F.lit(False)
    return field == (F.lit(value).cast(kind) if isinstance(kind, BooleanType) or isinstance(value, bool) else F.lit(value))


def _among(field: Column, kind: DataType | None, values: list, overlap: bool) -> Column:
    if overlap and isinstance(kind, ArrayType):
        some = [x for x in values if _fits(kind.elementType, x)]
        return F.arrays_overlap(field, F.array(*map(F.lit, some)).cast(kind)) if some else F.lit(False)
    plain = [x for x in values if x is not None and kind is not None and not isinstance(kind, (ArrayType, BooleanType)) and not isinstance(x, bool) and _fits(kind, x)]
    others = [_equal(field, kind, x) for x in values if x not in plain]
    out = field.isin(plain) if plain else F.lit(False)
    for x in others:
        out = out | x
    return out


def condition(schema: StructType, document: Mapping[str, Any] | None, overlap: bool = False) -> Column:
    """What rows of this schema must fulfil, for use in a filter: null counts as false there, so that Spark can push it down.

    Fields map to a value, or to values by OPERATORS, all of which must hold; what else a condition says is ignored. A field that
    is null or not in the schema equals None alone and fails every range. Text equals no number; a range over another kind is an
    error. A list of the table is compared as a whole by $eq and $in; with `overlap`, $in takes lists that share a value instead.
    """
    kinds = {f.name: f.dataType for f in schema.fields}
    out = F.lit(True)
    for name, wanted in (document or {}).items():
        kind = kinds.get(name)
        field = F.col(f"`{name}`") if kind is not None else F.lit(None)
        if not isinstance(wanted, Mapping):
            out = out & _equal(field, kind, wanted)
            continue
        if "$eq" in wanted:
            out = out & _equal(field, kind, wanted["$eq"])
        if "$in" in wanted:
            out = out & _among(field, kind, list(wanted["$in"]), overlap)
        for operator in ("$gte", "$lte"):
            if operator in wanted:
                bound = wanted[operator]
                if kind is not None and not _fits(kind, bound):
                    raise ValueError(f"{name}: {operator} {bound!r} on {kind.simpleString()}")
                out = out & (F.lit(False) if kind is None else field >= F.lit(bound) if operator == "$gte" else field <= F.lit(bound))
    return out


def matching(rows: DataFrame, document: Mapping[str, Any] | None, overlap: bool = False) -> DataFrame:
    """Rows that fulfil the filter document."""
    return rows.filter(condition(rows.schema, document, overlap)) if document else rows


def matched(rows: DataFrame, documents: Mapping[str, Mapping[str, Any]], key: str, overlap: bool = False) -> DataFrame:
    """(filter, key) for every named filter and row that fulfils it, in one pass over the rows."""
    names = [F.when(condition(rows.schema, x, overlap), F.lit(name)) for name, x in documents.items()]
    return rows.select(F.explode(F.array_compact(F.array(*names))).alias("filter"), key)


def asked_filters(question: Column) -> Column:
    """Filters that a normal question asks for, as a struct of ASKED; null where it doesn't.

    An article; a year; a kind of regulation with its number, or a common name's kind, number and year; revoked texts;
    explanations; texts in force. Nothing is assumed. A year without regulation or article is when something began, and dropped.
    """
    part = lambda pattern, k=1: F.nullif(F.regexp_extract(question, pattern, k), F.lit(""))
    article, year = part(r"pasal\s+([0-9]+[a-z]?)"), part(r"\b(19[0-9]{2}|20[0-9]{2})\b").cast("int")
    regulation = r"\b(uu|pp|permenaker|perpres)\s*(?:nomor|no\.?\s*)?(\d+)\b"
    kinds = F.create_map(*[F.lit(x) for item in REGULATIONS.items() for x in item])
    common = F.coalesce(*[F.when(question.rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(n).alias("number"), F.lit(y).alias("year"))) for p, k, n, y in NAMED])
    told = F.when(part(regulation).isNotNull(), F.struct(kinds[part(regulation)].alias("kind"), part(regulation, 2).try_cast("int").alias("number"), year.alias("year"))).otherwise(common)
    when = F.when(told.isNotNull(), told["year"]).when(article.isNotNull(), year)
    return F.struct(
        F.concat(F.lit("Pasal "), F.upper(article)).alias("article"), when.alias("year"), told["kind"].alias("regulation_type"), told["number"].alias("number"),
        F.when(question.rlike(r"\b(dicabut|revoked)\b"), "revoked").alias("legal_status"), F.when(question.rlike(r"\bpenjelasan\b"), F.array(F.lit("explanation"))).alias("segment_kinds"),
        F.when(question.rlike(r"\bmasih berlaku\b|\bterkini\b|\bterbaru\b|\byang berlaku\b"), F.array(F.lit("fresh"))).alias("freshness_states"),
    )


def inherited_filters(asked: Column, topics: Column, context_topics: Column, context_documents: Column) -> Column:
    """asked_filters with the regulation of the conversation, if the question names none, stays on its topics (or has none) and
    all documents so far that bear a regulation's name bear the same. Articles are never inherited.
    """
    pattern = r"(?i)^(UU|PP|PERMENAKER|PERPRES)-(\d+)-(\d{4})(?:-|$)"
    kinds = F.create_map(*[F.lit(x) for item in REGULATIONS.items() for x in item])
    named = F.filter(F.coalesce(context_documents, F.array().cast("array<string>")), lambda d: d.rlike(pattern))
    known = F.array_distinct(F.transform(named, lambda d: F.struct(kinds[F.lower(F.regexp_extract(d, pattern, 1))].alias("kind"), F.regexp_extract(d, pattern, 2).try_cast("int").alias("number"), F.regexp_extract(d, pattern, 3).cast("int").alias("year"))))
    stays = (F.coalesce(F.size(topics), F.lit(0)) <= 0) | F.coalesce(F.arrays_overlap(topics, context_topics), F.lit(False))
    one = F.when(asked["regulation_type"].isNull() & stays & (F.size(known) == 1), known[0])
    return F.struct(asked["article"].alias("article"), F.coalesce(one["year"], asked["year"]).alias("year"), F.coalesce(one["kind"], asked["regulation_type"]).alias("regulation_type"), F.coalesce(one["number"], asked["number"]).alias("number"), *[asked[x].alias(x) for x in ("legal_status", "segment_kinds", "freshness_states")])
