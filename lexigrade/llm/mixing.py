"""Mixing sources by temperature, realised as budgeted block permutations.

A source with token share p gets weight proportional to p ** exponent.  Exponent 1 keeps
the shares, 0 makes them equal; the weights' entropy falls and repetition rises on the
way between.  Bisection finds the exponent that meets a target entropy, or the least one
whose most repeated source stays within a limit of epochs relative to the least repeated.

A source's share of the budget is whole epochs and a rest.  Every epoch holds all
documents of the source; the rest takes its documents in the order of a keyed hash.  The
hash's leading bits deal a source into blocks; whole blocks count by their sums, and only
the block in which the budget ends is ordered document by document.  So a source that
holds a third of all rows is never gathered in one task.

The driver sees one row a source (name, tokens); sources are labels, not documents.

Cases: a null source is a source of its own; null and empty texts and texts without words
have no tokens and appear once; sources without tokens have weight 0 and their documents
appear once; repeated rows are documents of their own that share an id and hash; an empty
table gives an empty result; columns named like the ones added are kept as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Blocks that a source's documents are dealt into.
BLOCKS = 4096
_WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """The exponent, and each source's weight and epochs."""

    exponent: float
    weights: dict[str | None, float]
    epochs: dict[str | None, float]


def tempered(tokens: dict, exponent: float) -> dict:
    """Normalised weights of the sources that have tokens; the largest term is 1 before."""
    top = max(tokens.values())
    raw = {k: math.exp(exponent * (math.log(v) - math.log(top))) for k, v in tokens.items()}
    total = math.fsum(raw.values())
    return {k: v / total for k, v in raw.items()}


def entropy(weights: dict) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def bisected(fits: Callable[[float], bool], steps: int = 60) -> float:
    """The least exponent in 0 .. 1 that fits, where larger ones do; 1 if none does."""
    if fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def plan(tokens: dict, *, target_entropy: float | None = None, repeat_limit: float | None = None, budget: float | None = None) -> Mix:
    """Weights and epochs of the sources.

    ``target_entropy``: at most this entropy, so the exponent is the least that comes down
    to it.  ``repeat_limit``: no source more often than that many times the least repeated.
    With both the larger exponent holds.  ``budget`` in tokens; None is the budget at which
    the least repeated source appears exactly once, so that no document is left out.
    """
    live = {k: v for k, v in tokens.items() if v > 0}
    if not live:
        return Mix(1.0, {}, {})
    epochs_of = lambda a: {k: w / live[k] for k, w in tempered(live, a).items()}
    exponent = 1.0 if target_entropy is None and repeat_limit is None else 0.0
    if target_entropy is not None:
        exponent = max(exponent, bisected(lambda a: entropy(tempered(live, a)) <= target_entropy + 1e-12))
    if repeat_limit is not None:
        exponent = max(exponent, bisected(lambda a: max(epochs_of(a).values()) <= repeat_limit * min(epochs_of(a).values()) * (1 + 1e-12)))
    weights, per = tempered(live, exponent), epochs_of(exponent)
    size = 1 / min(per.values()) if budget is None else budget
    return Mix(exponent, weights, {k: v * size for k, v in per.items()})


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(_WORD)).cast("long")


def _position(seed: int) -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed))


def copies(sized: DataFrame, mix: Mix, *, seed: int) -> DataFrame:
    """``sized(doc_id, source, n_tokens, ...)`` with ``copies``: how often each row appears."""
    spark = sized.sparkSession
    shares = [(k, int(math.floor(e + 1e-9)), max(0.0, e - math.floor(e + 1e-9))) for k, e in mix.epochs.items()]
    shares = spark.createDataFrame(shares or [(None, 0, 0.0)], "_source string, _whole int, _rest double")
    rows = sized.withColumn("_at", _position(seed)).withColumn("_block", F.shiftrightunsigned("_at", 64 - (BLOCKS.bit_length() - 1)))
    blocks = rows.groupBy("source", "_block").agg(F.sum("n_tokens").alias("_tokens"))
    order = Window.partitionBy("source").orderBy("_block")
    blocks = blocks.withColumn("_until", F.sum("_tokens").over(order)).withColumn("_all", F.sum("_tokens").over(Window.partitionBy("source")))
    blocks = blocks.join(F.broadcast(shares), blocks.source.eqNullSafe(shares._source)).withColumn("_most", F.floor(F.col("_rest") * F.col("_all") + 1e-6))
    ends = blocks.where("_until > _most").groupBy("source").agg(F.min(F.struct("_block", (F.col("_until") - F.col("_tokens")).alias("_before"), "_most")).alias("_end"))
    ends = ends.select(F.col("source").alias("_of"), "_end")
    last = rows.join(F.broadcast(ends), rows.source.eqNullSafe(ends._of)).where(F.col("_block") == F.col("_end._block"))
    running = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("_at", "doc_id").rangeBetween(Window.unboundedPreceding, 0))
    cut = last.withColumn("_sum", F.col("_end._before") + running).where(F.col("_sum") <= F.col("_end._most"))
    cut = cut.groupBy(F.col("source").alias("_cut_source")).agg(F.max(F.struct("_at", "doc_id")).alias("_last"))
    known = shares.join(F.broadcast(ends), F.col("_source").eqNullSafe(F.col("_of")), "left").join(F.broadcast(cut), F.col("_source").eqNullSafe(F.col("_cut_source")), "left")
    known = known.select("_source", "_whole", "_rest", F.col("_end._block").alias("_stop"), "_last")
    out = rows.join(F.broadcast(known), rows.source.eqNullSafe(known._source), "left")
    inside = (F.col("_rest") > 0) & (F.col("_stop").isNull() | (F.col("_block") < F.col("_stop")) | ((F.col("_block") == F.col("_stop")) & F.coalesce(F.struct("_at", "doc_id") <= F.col("_last"), F.lit(False))))
    many = F.when(F.col("_whole").isNull() | (F.col("n_tokens") == 0), F.lit(1)).otherwise(F.col("_whole") + inside.cast("int"))
    return out.withColumn("copies", many).drop("_at", "_block", "_source", "_whole", "_rest", "_stop", "_last")


def source_tokens(sized: DataFrame, most: int = 1_000_000) -> dict[str | None, int]:
    """Token sums of the sources; more than ``most`` sources are an error, not cut off."""
    rows = sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} sources: a mix is planned on the driver")
    return {r.source: int(r.n or 0) for r in sorted(rows, key=lambda r: (r.source is None, r.source or ""))}


def mixed(documents: DataFrame, *, target_entropy: float | None = None, repeat_limit: float | None = 1.5, budget: float | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, weight, epoch, block, place): a row for each appearance.

    An epoch's order is by block, then place; both follow from the id, seed and epoch.
    """
    sized = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_tokens(F.col("text")).alias("n_tokens"))
    mix = plan(source_tokens(sized), target_entropy=target_entropy, repeat_limit=repeat_limit, budget=budget)
    weights = documents.sparkSession.createDataFrame([(k, float(v)) for k, v in mix.weights.items()] or [(None, 0.0)], "_name string, weight double")
    rows = copies(sized, mix, seed=seed).where("copies > 0")
    rows = rows.join(F.broadcast(weights), rows.source.eqNullSafe(weights._name), "left")
    rows = rows.select("doc_id", "source", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"))
    place = F.xxhash64("doc_id", F.lit(seed) + F.col("epoch"))
    return rows.withColumn("block", F.shiftrightunsigned(place, 64 - (BLOCKS.bit_length() - 1))).withColumn("place", place)


def mixed_documents(documents: DataFrame, *, target_entropy: float | None = None, repeat_limit: float | None = 1.5, budget: float | None = None, seed: int = 7) -> DataFrame:
    """The rows of documents, all columns, each as often as the mix asks for."""
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    sized = documents.select(whole.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_tokens(F.col("text")).alias("n_tokens"))
    mix = plan(source_tokens(sized.select("source", "n_tokens")), target_entropy=target_entropy, repeat_limit=repeat_limit, budget=budget)
    rows = copies(sized, mix, seed=seed).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
