"""Fitting weights to labelled samples, and evaluating a fit.

A sample is 13 difficulties, 13 scales and a label 0, 1 or 2.  The model is ordinal
logistic in the composite score.  A step's gradient is a sum over samples: ``fit`` takes
it with NumPy over the features of a labelled set, which is small by nature (people label
it); evaluation and ordering are DataFrame aggregations and take any number of rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigrade.functions import lexicons as L
from lexigrade.functions.text import readability_weight
from lexigrade.operators import vocabulary
from lexigrade.operators.metrics import Context
from lexigrade.operators.normalize import normalized
from lexigrade.operators.score import PRIORS, difficulty, measured

ITERATIONS, RATE, PULL, EPSILON = 3000, 0.02, 0.05, 1e-9


def samples(labelled: DataFrame, zipf: DataFrame) -> DataFrame:
    """``labelled(text, languageId, kind, label)`` with ``words`` and the ``results`` of all metrics.

    Texts are raw comments and are normalized first.  The vocabulary is empty and there is no
    symbol: a label is given to a comment alone.  Other columns but those of these names stay.
    """
    raw = labelled.withColumnsRenamed({"text": "raw_text", "languageId": "language_id"})
    empty = zipf.select("word").where(F.lit(False))
    rated = measured(F.col("text"), Context(identifiers=F.col("identifiers")), vocabulary.lexicon(zipf, empty))
    return normalized(raw).withColumn("_m", rated).select("*", "_m.words", "_m.results").drop("_m")


def matrix(sampled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hardness, scale, label) of samples, as ``fit`` takes them; a labelled set is small by nature."""
    results = {m: F.col(f"results.{m}") for m, *_ in PRIORS}
    rows = sampled.select(features(results, F.col("words"), F.col("label")).alias("f")).select("f.*").collect()
    hard, scale = (np.array([r[k] for r in rows], float).reshape(len(rows), len(PRIORS)) for k in ("difficulty", "scale"))
    return hard, scale, np.array([r.label for r in rows], int)


def features(results: dict[str, Column], words: Column, label: Column) -> Column:
    """struct(difficulty, scale, label) of the metrics' results under the prior ramps."""
    blend = readability_weight(words, L.RAMP_START, L.RAMP_END)
    return F.struct(
        F.array(*(difficulty(results[m].value, easy, hard) for m, _, easy, hard, _ in PRIORS)).alias("difficulty"),
        F.array(*((blend if ramped else F.lit(1.0)) for *_, ramped in PRIORS)).alias("scale"),
        (F.array_position(F.array(F.lit("easy"), F.lit("ok"), F.lit("hard")), label) - 1).cast("int").alias("label"),
    )


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def fit(hardness: np.ndarray, scale: np.ndarray, label: np.ndarray, *, iterations: int = ITERATIONS, rate: float = RATE, pull: float = PULL, priors=PRIORS) -> tuple[dict[str, float], dict[str, float]]:
    """(weights, bands): full-batch Adam, weights pulled to their priors and kept at 0 or more."""
    prior = np.array([p[1] for p in priors])
    n = len(prior)
    params = np.concatenate([prior, [3.0, np.log(3.0), 0.0]])
    first, second = np.zeros(n + 3), np.zeros(n + 3)
    for step in range(1, iterations + 1):
        ok, gap, k = params[n], np.exp(params[n + 1]), np.exp(params[n + 2])
        w = params[:n] * scale
        total = w.sum(1)
        live = total > 0
        safe = np.where(live, total, 1.0)
        score = np.where(live, 10 * (w * hardness).sum(1) / safe, 0.0)
        p1, p2 = _sigmoid(k * (score - ok)), _sigmoid(k * (score - ok - gap))
        between = np.maximum(p1 - p2, EPSILON)
        d1 = np.where(label == 0, p1, np.where(label == 2, 0.0, -p1 * (1 - p1) / between))
        d2 = np.where(label == 0, 0.0, np.where(label == 2, -(1 - p2), p2 * (1 - p2) / between))
        pushed = np.where(live, k * (d1 + d2), 0.0)
        grad = np.empty(n + 3)
        grad[:n] = (pushed[:, None] * 10 * scale * (hardness - score[:, None] / 10) / safe[:, None]).sum(0)
        grad[n] = -(k * (d1 + d2)).sum()
        grad[n + 1] = -(k * d2 * gap).sum()
        grad[n + 2] = (k * (d1 * (score - ok) + d2 * (score - ok - gap))).sum()
        grad /= max(1, len(label))
        grad[:n] += 2 * pull * (params[:n] - prior)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        params = params - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        params[:n] = np.maximum(0, params[:n])
    rounded = lambda x: float(np.floor(x * 1000 + 0.5) / 1000)
    ok = rounded(params[n])
    return {p[0]: rounded(v) for p, v in zip(priors, params, strict=False)}, {"ok": ok, "hard": rounded(ok + np.exp(params[n + 1]))}


def confusion(rows: DataFrame) -> DataFrame:
    """``rows(human, predicted)`` by human label, a column for each predicted one."""
    wide = rows.groupBy("human").pivot("predicted", ["easy", "ok", "hard"]).agg(F.count("human"))
    return wide.na.fill(0, ["easy", "ok", "hard"])


def agreement(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.avg((F.col("human") == F.col("predicted")).cast("double")), F.lit(0.0)).alias("agreement"))


def pair_order(rows: DataFrame) -> DataFrame:
    """(lower, higher, ordered, pairs) of ``rows(label, raw)`` for each two labels.

    Ordered pairs, ties counted half, are a rank sum: counts of equal scores are
    aggregated first, and a running count over distinct scores replaces the pairs.
    """
    rank = F.array_position(F.array(F.lit("easy"), F.lit("ok"), F.lit("hard")), F.col("label")).cast("int")
    by_score = rows.groupBy("raw").agg(*(F.sum((rank == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3)))
    below = Window.orderBy("raw").rowsBetween(Window.unboundedPreceding, -1)
    counted = by_score.select("*", *(F.coalesce(F.sum(f"n{k}").over(below), F.lit(0)).alias(f"b{k}") for k in (1, 2)))
    sums = [F.sum(F.col(f"n{b}") * (F.col(f"b{a}") + 0.5 * F.col(f"n{a}"))).alias(f"o{a}{b}") for a, b in ((1, 2), (2, 3), (1, 3))]
    totals = [F.sum(f"n{k}").alias(f"t{k}") for k in (1, 2, 3)]
    one = counted.agg(*sums, *totals)
    names = {1: "easy", 2: "ok", 3: "hard"}
    pairs = [F.struct(F.lit(names[a]).alias("lower"), F.lit(names[b]).alias("higher"), F.coalesce(f"o{a}{b}", F.lit(0.0)).alias("ordered"), F.coalesce(F.col(f"t{a}") * F.col(f"t{b}"), F.lit(0)).alias("pairs")) for a, b in ((1, 2), (2, 3), (1, 3))]
    return one.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def folds(rows: DataFrame, order: str, k: int = 5) -> DataFrame:
    """rows with ``fold``: position in the order modulo k (labelled sets are small)."""
    return rows.withColumn("fold", ((F.row_number().over(Window.orderBy(order)) - 1) % k).cast("int"))


def cross_validate(hardness: np.ndarray, scale: np.ndarray, label: np.ndarray, k: int = 5, **options) -> float:
    """Share of samples labelled right by a fit that hasn't seen them."""
    fold, agreed = np.arange(len(label)) % k, 0
    for f in range(k):
        inside = fold != f
        weights, bands = fit(hardness[inside], scale[inside], label[inside], **options)
        w = np.array([weights[p[0]] for p in PRIORS]) * scale[~inside]
        score = 10 * (w * hardness[~inside]).sum(1) / np.maximum(w.sum(1), 1e-300)
        agreed += int((((score >= bands["ok"]).astype(int) + (score >= bands["hard"])) == label[~inside]).sum())
    return agreed / len(label) if len(label) else 0.0
