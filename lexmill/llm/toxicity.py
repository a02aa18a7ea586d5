"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Terms are whole words and beginnings of words whose share among toxic rows of the training sample stands out. They are dealt to
lexicon voters; pattern voters look at how many terms a text has, how dense they stand, and how it is written. The label model
estimates each voter's vote rates in either class by expectation-maximisation and how far voters repeat each other; what they
repeat counts once. Its posterior labels train a logistic regression on the terms' frequencies and the patterns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import fold
from .tables import stored
from .words import LOWER, SEPARATORS, U64, buffers, rows_of, slices, word_bounds, word_hashes

#: Bytes of the beginnings of words that may be terms.
PREFIXES = (4, 5, 6, 8)
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
BREAK = SEPARATORS | ~LETTER
LEXICONS = 8
#: Insults of the four languages, a voter of its own.
INSULTS = "idiot idiota idiotin moron stupid stupide dumm dummkopf loser trash scum pathetic disgusting worthless clown imbecile imbécile imbécil dumb fool bastard salaud connard crétin abruti ordure débile basura estúpido escoria payaso asqueroso tonto arschloch abschaum widerlich wertlos trottel versager müll"


@dataclass(frozen=True)
class ToxicityModel:
    """terms: hashes in ascending order; lexicon: the voter of each; weights: of terms and patterns, and the constant."""

    terms: np.ndarray
    weights: np.ndarray


def _hash_of(words: list[str]) -> np.ndarray:
    data, offsets = buffers(pa.array(words))
    return word_hashes(data, offsets[:-1], offsets[1:])


def _terms(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and rows of whole words and of beginnings of words."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, BREAK)
    row = rows_of(first)
    yield word_hashes(data, starts, ends), row
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        if len(long):
            yield word_hashes(data, starts[long], starts[long] + n) + U64(n), row[long]


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of either label hold a term, per task."""
    keys, toxic = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for batch in batches:
        label = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        data, offsets = buffers(batch.column("text"))
        for i, j in slices(offsets):
            for hashes, row in _terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                order = np.lexsort((hashes, row))
                hashes, row = hashes[order], row[order]
                once = np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])] if len(row) else np.zeros(0, bool)
                keys.append(hashes[once])
                toxic.append(label[i + row[once]])
    all_keys, all_toxic = np.concatenate(keys), np.concatenate(toxic)
    if len(all_keys):
        terms, at = np.unique(all_keys, return_inverse=True)
        bad = np.bincount(at, all_toxic, len(terms)).astype(np.int64)
        total = np.bincount(at, minlength=len(terms))
        for k in range(0, len(terms), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(terms[part].view(np.int64)), pa.array(bad[part]), pa.array(total[part])], names=["term", "bad", "total"])


def _features(terms: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: how often each term occurs, and its patterns (words, upper-case share, symbol share, exclamations, longest known insult)."""
    n = len(offsets) - 1
    counts = np.zeros((n, len(terms)), np.float32)
    marked = np.zeros(1 << 16, bool)
    marked[(terms >> U64(48)).astype(np.int64)] = True
    words = np.zeros(n)
    for k, (hashes, row) in enumerate(_terms(data, offsets)):
        if not k:
            words = np.bincount(row, minlength=n)
        near = np.flatnonzero(marked[(hashes >> U64(48)).astype(np.int64)])
        if len(near) and len(terms):
            at = np.minimum(np.searchsorted(terms, hashes[near]), len(terms) - 1)
            hit = terms[at] == hashes[near]
            np.add.at(counts, (row[near[hit]], at[hit]), 1)
    added = lambda mask: np.diff(np.r_[0, np.cumsum(mask[data])][offsets])
    letters, upper, white = added(LETTER), added(UPPER), added(SEPARATORS)
    bang = np.zeros(256, bool)
    bang[33] = True
    size = np.maximum(1, np.diff(offsets) - white)
    return counts, np.stack([words, upper / np.maximum(1, letters), 1 - letters / size, added(bang) / np.maximum(1, words)], 1)


def _inputs(counts: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """What the classifier weighs: presence and frequency of each term, how many terms, how dense, and the patterns."""
    words = np.maximum(1, patterns[:, :1])
    hits, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    rate = 1000 * hits / words
    return np.concatenate([np.minimum(counts, 3), np.log1p(hits), np.log1p(rate), np.minimum(kinds, 5), np.minimum(rate, 20) / 20, np.log1p(words) / 10, patterns[:, 1:]], 1)


def _votes(counts: np.ndarray, patterns: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 no vote; a column for each voter."""
    words = np.maximum(1, patterns[:, 0])
    hits, kinds = counts.sum(1), (counts > 0).sum(1)
    rate = 1000 * hits / words
    out = [np.where(counts[:, lexicon == k].sum(1) > 0, 1, 0) for k in range(LEXICONS + 1)]
    out.append(np.where(kinds >= 2, 1, np.where(kinds == 0, -1, 0)))
    out.append(np.where(hits >= 3, 1, np.where(hits == 0, -1, 0)))
    out.append(np.where(rate >= 2, 1, np.where(rate < 0.2, -1, 0)))
    out.append(np.where(rate >= 8, 1, 0))
    out.append(np.where(patterns[:, 1] > 0.5, 1, 0))
    out.append(np.where(patterns[:, 3] > 0.2, 1, 0))
    return np.stack(out, 1)


def label_model(votes: np.ndarray, prior: float, start: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the toxic class and the voters' weights, from votes in {-1, 0, 1}.

    `start`: first guess of the posterior, from the labels. The correlation of each pair of voters is that within the guessed
    classes; a voter's evidence is divided by one plus the correlations it has with others. Each round estimates the rate of
    each vote in either class, half from the posterior and half from the guess, so that the classes can't change places.
    """
    values = np.array([-1, 0, 1])
    seen = (votes[:, :, None] == values).astype(float)
    hard = start > 0.5
    left = votes - np.where(hard[:, None], votes[hard].mean(0) if hard.any() else 0, votes[~hard].mean(0) if (~hard).any() else 0)
    spread = np.sqrt((left * left).mean(0))
    related = np.abs(left.T @ left) / len(left) / np.maximum(spread * spread[:, None], 1e-9)
    np.fill_diagonal(related, 0)
    share = 1 / (1 + np.where(related > 0.1, related, 0).sum(1))
    p = start.astype(float)
    for _ in range(rounds):
        q = (p + hard) / 2
        bad = (np.einsum("n,njv->jv", q, seen) + 0.5) / (q.sum() + 1.5)
        good = (np.einsum("n,njv->jv", 1 - q, seen) + 0.5) / ((1 - q).sum() + 1.5)
        evidence = np.einsum("njv,jv,j->n", seen, np.log(bad) - np.log(good), share)
        new = 1 / (1 + np.exp(-np.clip(evidence + np.log(prior) - np.log1p(-prior), -30, 30)))
        if np.abs(new - p).max() < 1e-4:
            p = new
            break
        p = new
    return p, share


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Weights and constant of a ridge logistic regression on soft labels, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(penalty), x.T @ (y - q) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sample_features(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                counts, patterns = _features(terms.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                row, at = np.nonzero(counts)
                bounds = np.searchsorted(row, np.arange(j - i + 1))
                lists = lambda v: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), v)  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays([batch.column("toxic")[i:j], lists(pa.array(at, pa.int32())), lists(pa.array(counts[row, at])), pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * patterns.shape[1], pa.int32()), pa.array(patterns.ravel()))], names=["toxic", "at", "n", "patterns"])

    return run


def train_toxicity(documents: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_terms: int = 250) -> ToxicityModel:
    """From documents (doc_id, text) and labels (doc_id, toxic 0 or 1). At most `most_rows` labels are used, those of the smallest
    hash of doc_id; null labels are left out, and a doc_id with different labels counts as toxic. Without toxic rows all scores are near 0. No text is shuffled: the chosen labels,
    most_rows of them at most, go to the documents.
    """
    spark = documents.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows), "labels")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    sample = stored(rows.select("text", "toxic"), "sample")
    n_bad, n = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    ratio = (F.log(F.col("bad") / F.lit(n_bad + 1.0)) - F.log((F.col("total") - F.col("bad") + 1) / F.lit(n - n_bad + 1.0))).alias("ratio")
    seen = sample.mapInArrow(_seen, "term long, bad long, total long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("total").alias("total"))
    best = seen.filter("bad >= 3").withColumn("ratio", ratio).filter("ratio > 2.5").orderBy(F.desc(F.col("ratio") * F.sqrt("bad")), "term").limit(most_terms).collect()
    own = _hash_of(INSULTS.split())
    found = np.array([r["term"] for r in best], np.int64).view(np.uint64)
    terms = np.unique(np.r_[found, own])
    lexicon = np.full(len(terms), LEXICONS)
    lexicon[np.searchsorted(terms, found)] = np.arange(len(found)) % LEXICONS
    features = sample.mapInArrow(_sample_features(spark.sparkContext.broadcast(terms)), "toxic int, at array<int>, n array<float>, patterns array<double>").toPandas()  # most_rows rows at most
    counts = np.zeros((len(features), len(terms)), np.float32)
    for i, (at, m) in enumerate(zip(features["at"], features["n"], strict=True)):
        counts[i, at] = m
    patterns = np.array(features["patterns"].tolist()).reshape(len(features), -1) if len(features) else np.zeros((0, 4))
    if not len(features) or not 0 < n_bad < n:
        return ToxicityModel(terms, np.r_[np.zeros(len(terms) + 8), -6.0 if not n_bad else 6.0])
    labels = features["toxic"].to_numpy()
    start = np.where(labels > 0, 0.9, 0.1)
    posterior, _ = label_model(_votes(counts, patterns, lexicon), float(labels.mean()), start)
    soft = np.where(labels > 0, np.maximum(posterior, 0.5), posterior)  # a row known to be toxic never counts as clean, whatever the voters missed
    return ToxicityModel(terms, _logistic(_inputs(counts, patterns), soft))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, w = model.value.terms, model.value.weights
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            score = np.zeros(batch.num_rows)
            for i, j in slices(offsets):
                x = _inputs(*_features(terms, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                score[i:j] = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def score_toxicity(documents: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1), predicted (1 if score >= 0.5), from the whole text alone.

    Null texts score as empty ones. Repeated rows get equal values; an empty table gives an empty one; other columns aren't read.
    """
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    scored = docs.mapInArrow(_scored(documents.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(documents: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """score_toxicity with a model of the labelled rows whose fold isn't the held-out one; held_out says which are."""
    model = train_toxicity(documents, labels.filter(F.coalesce(fold("doc_id", parts), F.lit(held)) != held))
    return score_toxicity(documents, model).select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(True)).alias("held_out"), "score", "predicted")
