"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .characters import character_grams, letters
from .packed import planes, unplanes
from .words import give_back

ORDERS = (1, 2, 3)
BITS = 16
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """languages in order, log_prior of each, log_likelihood[language, hashed n-gram]."""

    languages: list[str]
    log_prior: np.ndarray
    log_likelihood: np.ndarray


def fold(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(parts))


def _counted(languages: list[str]):
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros((len(languages), 1 << BITS), np.int64), np.zeros(len(languages), np.int64)
        for batch in batches:
            own = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            rows += np.bincount(own, minlength=len(languages))
            for codes, row in letters(batch.column("text"), max(ORDERS) - 1):
                for n in ORDERS:
                    key, of = character_grams(codes, row, n, BITS)
                    counts += np.bincount((own[of] << BITS) + key, minlength=counts.size).reshape(counts.shape)
        for i in np.flatnonzero(rows):
            yield pa.RecordBatch.from_pydict({"lang": pa.array([i], pa.int32()), "docs": pa.array([rows[i]], pa.int64()), "counts": pa.array([planes(counts[i])], pa.binary())})

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << BITS, np.int64)
    for x in table["counts"]:
        total += unplanes(x.as_py())
    return pa.table({"lang": table["lang"][:1], "docs": pa.array([sum(table["docs"].to_pylist())], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def train_language_model(labelled: DataFrame, smoothing: float = 0.5, most_languages: int = 200) -> LanguageModel:
    """From rows (text, lang): counts of n-grams over all of them, a matrix of 65536 columns and a row for each language.

    Rows with a null language are left out; null and empty texts add to the prior alone. More than most_languages languages
    are an error, since the matrix goes to every executor. Without rows the model knows no language.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null")
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(most_languages + 1).collect())
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    counts, docs = np.zeros((len(languages), 1 << BITS)), np.zeros(len(languages))
    summed = rows.mapInArrow(_counted(languages), "lang int, docs long, counts binary").groupBy("lang").applyInArrow(_summed, "lang int, docs long, counts binary")
    for i, n, x in summed.collect():
        counts[i], docs[i] = np.frombuffer(x, np.int64), n
    counts += smoothing
    return LanguageModel(languages, np.log((docs + 1) / max(1, docs.sum() + len(docs))), np.log(counts) - np.log(counts.sum(1, keepdims=True)))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.value.languages, UNKNOWN], object)
        prior, table = model.value.log_prior, model.value.log_likelihood
        for batch in batches:
            total, seen = np.zeros((len(prior), batch.num_rows)), np.zeros(batch.num_rows, np.int64)
            for codes, row in letters(batch.column("_text"), max(ORDERS) - 1):
                for n in ORDERS:
                    key, of = character_grams(codes, row, n, BITS)
                    if len(key):
                        low, size = int(of[0]), int(of[-1]) - int(of[0]) + 1
                        seen[low : low + size] += np.bincount(of - low, minlength=size)
                        for k in range(len(prior)):
                            total[k, low : low + size] += np.bincount(of - low, table[k][key], size)
            if len(prior):
                logs = total + prior[:, None]
                best = logs.argmax(0)
                score = 1 / np.exp(logs - logs.max(0)).sum(0)
            else:
                best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            best[seen == 0] = len(prior)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(np.where(seen > 0, score, 0.0))], names=[*batch.schema.names[:-1], "lang_pred", "score"])
        give_back()

    return run


def identify_language(documents: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """Per row: the columns in `keep`, lang_pred, score (the language's posterior, 0 to 1), from the whole text alone.

    Texts that are null or hold no letter get `und` and score 0, as do all where the model knows no language. Ties go to the
    language that comes first. Repeated rows get equal values; an empty table gives an empty one; other columns aren't read.
    """
    docs = documents.select(*keep, F.col(text_column).cast("string").alias("_text"))
    schema = StructType([*docs.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(_scored(documents.sparkSession.sparkContext.broadcast(model)), schema)


def language_model(documents: DataFrame, parts: int = 4, held: int = 2) -> LanguageModel:
    """A model of the rows whose fold isn't the held-out one."""
    return train_language_model(documents.filter(F.coalesce(fold("doc_id", parts), F.lit(held)) != held))


def identified(documents: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """identify_language with a model of the rows whose fold isn't the held-out one; held_out says which are."""
    scored = identify_language(documents, language_model(documents, parts, held))
    return scored.select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(True)).alias("held_out"), "lang_pred", "score")
