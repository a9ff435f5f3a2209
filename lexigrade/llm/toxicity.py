"""Toxicity by multiple-instance learning: noisy-or over sentence scores.

A sentence's score is a logistic function of the words and word beginnings it holds; a
document is toxic if any of its sentences is: 1 - product(1 - score).  Only document
labels train the model.  The gradient of the noisy-or sends a toxic document's label to
the sentences that best explain it.  Features enter if they are clearly more frequent in
toxic documents than in clean ones, and an L1 step keeps those few that are needed.

Training takes at most ``most`` labelled documents of each label, those of the least
hash of their id among rows whose crc32(id) mod 5 isn't 0, so the sample is the same
in every run; its bound is a parameter, and features reach the driver, no texts.  Scoring covers every row and the whole text in a constant number of NumPy
passes; the model (the words that the fit keeps) goes along with the tasks.

Cases: null and empty texts and texts without words score the model's score of an
empty sentence; a null id isn't held out and never trains; labels that are null or
without a document are ignored, contradicting labels of an id count as toxic; of rows that
share an id the least text trains; without
labels of both kinds every score is 0; repeated rows score alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigrade.llm import hashing as H
from lexigrade.llm.scratch import Scratch

#: Bytes that end a sentence, and bytes that aren't part of a word.
ENDS = np.zeros(256, dtype=bool)
ENDS[[ord(c) for c in ".!?\n"]] = True
GAP = np.ones(256, dtype=bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    GAP[_a:_b] = False
FOLDS = 5


#: Bytes of a word's beginning that are features beside the word.
BEGINNINGS = (4, 5, 6)


def features(hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """One row a word: the word's hash, then those of its beginnings."""
    return np.stack([hashes, *(H.mix((heads & H._MASK[k]) + np.uint64(k)) for k in BEGINNINGS)], axis=1)


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their weights and the weight that every sentence has."""

    words: np.ndarray
    weights: np.ndarray
    bias: float


def sentences(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(features of each word, sentence of each word, row of each sentence, start and end byte of each).

    Sentences are numbered through the column; those without words are left out.
    """
    data, offsets = H.text_bytes(column)
    low = H.LOWER[data]
    n = len(low)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64).reshape(0, 1 + len(BEGINNINGS)), none, none, none, none
    solid = np.append(~GAP[low], False)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    begins, ends = solid.copy(), np.zeros(n + 1, dtype=bool)
    begins[1:] &= ~solid[:-1] | first[1:]
    ends[1:] = solid[:-1] & (~solid[1:] | first[1:])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    row = np.searchsorted(offsets, start, side="right") - 1
    stops = np.cumsum(np.append(ENDS[low], False))[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (stops[1:] != stops[:-1]) | (row[1:] != row[:-1])
    at = np.cumsum(new) - 1
    opening = np.flatnonzero(new)
    closing = np.append(opening[1:], len(start)) - 1
    length = end - start
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    heads = np.ndarray((n + 1,), dtype="<u8", buffer=padded, strides=(1,))[start] & H._MASK[np.minimum(length, 8)]
    return features(H.word_hashes(low, start, length), heads), at, row[opening], start[opening] - offsets[row[opening]], end[closing] - offsets[row[opening]]


def sentence_logits(hashes: np.ndarray, at: np.ndarray, n: int, model: Model) -> np.ndarray:
    """Summed weights of each sentence's distinct features."""
    out = np.full(n, model.bias)
    if len(model.words) and len(hashes):
        sieve = np.zeros(1 << 16, dtype=bool)
        sieve[(model.words >> np.uint64(48)).astype(np.int64)] = True
        maybe = np.flatnonzero(sieve[(hashes >> np.uint64(48)).astype(np.int64)])
        found = hashes.ravel()[maybe]
        place = np.minimum(np.searchsorted(model.words, found), len(model.words) - 1)
        known = model.words[place] == found
        once = np.unique(at[maybe[known] // hashes.shape[1]] * len(model.words) + place[known])
        out += np.bincount(once // len(model.words), weights=model.weights[once % len(model.words)], minlength=n)
    return out


def noisy_or(logits: np.ndarray, row: np.ndarray, n: int, bias: float) -> np.ndarray:
    """1 - product of (1 - sigmoid(logit)) for each of n rows; rows without sentences have one empty."""
    miss = np.bincount(row, weights=np.logaddexp(0, logits), minlength=n)
    miss[np.bincount(row, minlength=n) == 0] = np.logaddexp(0, bias)
    return -np.expm1(-miss)


def scores(column: pa.Array, model: Model) -> np.ndarray:
    hashes, at, row, _, _ = sentences(column)
    return np.clip(noisy_or(sentence_logits(hashes, at, len(row), model), row, len(column), model.bias), 0.0, 1.0)


def fit(column: np.ndarray, sentence: np.ndarray, doc_of: np.ndarray, labels: np.ndarray, n_features: int, *, rounds: int = 600, rate: float = 0.1, l1: float = 3e-5) -> tuple[np.ndarray, float]:
    """(weights, bias) from the features of sentences (pairs of column and sentence), the
    document of each sentence and the labels of the documents."""
    y = labels.astype(float)
    share = 1 / len(y)
    weights, bias = np.zeros(n_features), -7.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for turn in range(1, rounds + 1):
        z = np.bincount(sentence, weights=weights[column], minlength=len(doc_of)) + bias
        miss = np.bincount(doc_of, weights=np.logaddexp(0, z), minlength=len(y))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        lost = np.exp(-miss)
        pull = np.where(y == 1, -lost / np.maximum(1 - lost, 1e-6), 1.0) * share
        g = pull[doc_of] * p
        grad = np.append(np.bincount(column, weights=g[sentence], minlength=n_features) + l1, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        step = rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-5)
        weights = np.maximum(weights - step[:-1], 0)
        bias = bias - step[-1]
    return weights, float(bias)


def _fold(doc: int | None) -> int | None:
    return None if doc is None else zlib.crc32(str(doc).encode()) % FOLDS


def train(documents: DataFrame, labels: DataFrame, *, most: int = 2500, least_documents: int = 3, lift: float = 3.0) -> Model:
    """The model of a bounded sample of the labelled rows outside the held-out fold.

    Executors count in how many toxic and clean documents of the sample a feature occurs;
    those with enough lift reach the driver (the sample bounds how many there are), and then
    the sentences of the sample as numbers of those features.
    """
    spark = documents.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    marks = marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = marks.where("toxic = 1").orderBy(*order).limit(most).union(marks.where("toxic = 0").orderBy(*order).limit(most))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    texts = Scratch(spark, "toxicity").save(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic"), "sample")
    totals = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in H.slices(b, "text"):
                hashes, at, row, _, _ = sentences(part.column(1))
                order = np.lexsort((hashes.ravel(), np.repeat(row[at], hashes.shape[1])))
                owner, value = np.repeat(row[at], hashes.shape[1])[order], hashes.ravel()[order]
                new = np.ones(len(value), dtype=bool)
                new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
                feature, inverse, n = np.unique(value[new], return_inverse=True, return_counts=True)
                toxic = np.bincount(inverse, weights=part.column(2).to_numpy()[owner[new]], minlength=len(feature))
                yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(n), pa.array(toxic.astype(np.int64))], names=["feature", "n", "toxic"])

    seen = texts.mapInArrow(counted, "feature long, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    odds = ((F.col("toxic") + 0.2) / totals[1]) / ((F.col("n") - F.col("toxic") + 0.2) / totals[0])
    chosen = seen.where(F.col("toxic") >= least_documents).where(odds >= lift)
    words = np.sort(np.array([r.feature for r in chosen.select("feature").collect()], np.int64).view(np.uint64))
    if not len(words):
        return Model(words, np.zeros(0), -7.0)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in H.slices(b, "text"):
                hashes, at, row, _, _ = sentences(part.column(1))
                place = np.minimum(np.searchsorted(words, hashes.ravel()), len(words) - 1)
                known = np.flatnonzero(words[place] == hashes.ravel())
                once = np.unique(at[known // hashes.shape[1]] * len(words) + place[known])
                sentence, column = once // len(words), once % len(words)
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                edge = np.searchsorted(sentence, first)
                cells = [(column[a:z].astype(np.int32).tobytes(), (sentence[a:z] - f).astype(np.int32).tobytes()) for a, z, f in zip(edge[:-1], edge[1:], first[:-1], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(first)), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], names=["doc_id", "toxic", "n", "columns", "sentences"])

    rows = sorted(texts.mapInArrow(numbered, "doc_id long, toxic int, n long, columns binary, sentences binary").collect(), key=lambda r: r.doc_id)
    sizes = np.array([r.n for r in rows], np.int64)
    first = np.cumsum(sizes) - sizes
    column = np.concatenate([np.frombuffer(r.columns, np.int32) for r in rows])
    sentence = np.concatenate([np.frombuffer(r.sentences, np.int32) + f for r, f in zip(rows, first, strict=True)])
    weights, bias = fit(column, sentence, np.repeat(np.arange(len(rows)), sizes), np.array([r.toxic for r in rows]), len(words))
    used = np.flatnonzero(weights > 0.05)
    return Model(words[used], weights[used], bias)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in H.slices(b):
                s = scores(part.column(1), model)
                out = [_fold(d) == 0 for d in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.bool_()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(mapped, "doc_id long, held_out boolean, score double, predicted int")


def offending_sentences(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, score): byte spans of sentences that score the threshold."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in H.slices(b):
                hashes, at, row, start, end = sentences(part.column(1))
                s = -np.expm1(-np.logaddexp(0, sentence_logits(hashes, at, len(row), model)))
                bad = np.flatnonzero(s >= threshold)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[bad])), pa.array(start[bad]), pa.array(end[bad]), pa.array(s[bad])], names=["doc_id", "start", "end", "score"])

    return rows.mapInArrow(mapped, "doc_id long, start long, end long, score double")


def without_toxic(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of documents, all columns, that score under the threshold."""
    text = documents.columns.index("text")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in H.slices(b, "text"):
                yield part.filter(pa.array(scores(part.column(text), model) < threshold))

    return documents.mapInArrow(mapped, documents.schema)
