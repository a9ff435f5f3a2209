"""Reproducible sharding: a Feistel permutation over global row numbers.

Rows are numbered 0 .. N-1 in the order of (doc_id, hashes of the text, place).  A balanced
Feistel network permutes the smallest even-bit domain that holds N; a value that falls
outside 0 .. N-1 walks on through the permutation until it falls inside, which makes a
permutation of exactly 0 .. N-1.  Row r then goes to shard p(r) mod S, slot p(r) div S:
both follow from (r, N, S, seed) alone, slots have no gaps and shard counts differ by
at most one (the law ``rows``).

Numbering sorts by range partitions of the id; a partition's offset is the count of
those before it, so the driver sees one number a partition.  No row of a hot source or
group of copies is treated apart, since only ids order the rows.

Cases: null texts have size 1 and the checksum of no bytes; a null id sorts first;
repeated rows get different numbers, and which of equal rows gets which can't be told
apart; an empty table gives an empty result; other columns are ignored unless kept.  A
kept column of a made one's name (``size``, ``shard`` ...) comes as that name with ``_before``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexigrade.llm import hashing as H
from lexigrade.llm.scratch import Scratch

ROUNDS = 6


def permuted(r: np.ndarray, n: int, seed: int) -> np.ndarray:
    """p(r) for row numbers r in 0 .. n-1: a permutation fixed by (n, seed)."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    out = np.asarray(r, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for k in range(ROUNDS):
            key = np.uint64((seed * 0x9E3779B97F4A7C15 + k * 0xC2B2AE3D27D4EB4F + 1) & 0xFFFFFFFFFFFFFFFF)
            left, right = right, left ^ (H.mix(right + key) & low)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def unpermuted(p: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row number that goes to p: the inverse of ``permuted``."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    out = np.asarray(p, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for k in reversed(range(ROUNDS)):
            key = np.uint64((seed * 0x9E3779B97F4A7C15 + k * 0xC2B2AE3D27D4EB4F + 1) & 0xFFFFFFFFFFFFFFFF)
            left, right = right ^ (H.mix(left + key) & low), left
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str = "row_number") -> tuple[DataFrame, int]:
    """(rows with a global number 0 .. N-1 in the order of the columns, N)."""
    ordered = scratch.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_place", 33)
    counts = sorted((r[0], r[1]) for r in ordered.groupBy(part.alias("part")).count().collect())
    before, n = {}, 0
    for p, c in counts:
        before[p] = n
        n += c
    offsets = rows.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_part long, _before long")
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    out = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + inside)
    return out.drop("_place", "_part", "_before"), n


def sharded(documents: DataFrame, *, shards: int = 8, seed: int = 20240229, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), and the columns to keep."""
    scratch = Scratch(documents.sparkSession, "feistel")
    text = F.col("text").cast("string")
    made = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [c for c in keep or [] if c != "doc_id"]
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_tie"),
        F.monotonically_increasing_id().alias("_nth"),
        *[F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept))).alias("_kept")] * bool(kept),  # as one, so that no name of theirs meets one of ours
    )
    rows, n = numbered(rows, ["doc_id", "text_crc32", "_tie", "_nth"], scratch, "_row")
    # only the numbers go to Python; texts and other kept columns stay where they are
    place = F.pandas_udf(lambda r: pd.Series(permuted(r.to_numpy(), n, seed)), "long")
    rows = rows.withColumn("_at", place("_row"))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_at") % shards).cast("int").alias("shard"),
        F.expr(f"_at div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(F.col(f"_kept.k{i}").alias(f"{c}_before" if c in made else c) for i, c in enumerate(kept)),
    )
