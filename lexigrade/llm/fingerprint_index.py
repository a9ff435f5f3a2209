"""Incremental substring dedup over a log-structured index of window hashes.

The index is a list of immutable runs; a run holds, per hash bucket, the sorted hashes of
word windows that no older run holds.  A new batch of documents sends its window hashes to
the buckets, where they are sorted and merged with the runs' hashes: a window is a copy if
a run holds it, or a document of the batch with a smaller id.  The merge compares 40 bits
and the bucket's, and verifies a match by 24 bits of a second, independent hash.  The
batch's new hashes become the next run; when there are more than ``fan`` runs they are
compacted into one.  Batches come in the order of ids, so all that a run holds is older.

A match is 70 bits long at 64 buckets and gains a bit with each doubling of the input, up
to 84 at 8 TB: among 10^8 windows that differ, one is taken for a copy with a chance of
10^-5; among the 10^13 of 100 TB two or three false matches are to be expected.

Cases: null and empty texts and texts of fewer words than a window keep all their words; a
null id counts as the largest; rows that share an id don't count as copies of each other;
a window that a document repeats isn't removed for that; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrade.llm import exchange as X
from lexigrade.llm import hashing as H
from lexigrade.llm.scratch import Scratch, buckets

#: Stands for a null id.
LAST = (1 << 63) - 1
_SECOND = 0x5EED


def _windows(column: pa.Array, width: int) -> tuple[np.ndarray, ...]:
    """(data, word starts, word lengths, word rows, first word of each window, both hashes)."""
    data, offsets = H.text_bytes(column)
    start, length, row = H.words(data, offsets)
    whole = np.flatnonzero(H.full_windows(row, width))
    h = H.word_hashes(data, start, length)
    one = H.window_hashes(h, width)[whole]
    two = H.window_hashes(H.mix(h + np.uint64(_SECOND)), width, _SECOND)[whole]
    return data, start, length, row, whole, one, two


class FingerprintIndex:
    """Runs of window hashes in the shared folder; ``add`` asks about a batch and keeps its hashes."""

    def __init__(self, spark: SparkSession, n_buckets: int, *, width: int = 13, fan: int = 2):
        self.scratch = Scratch(spark, "windows")
        self.spark, self.n_buckets, self.width, self.fan = spark, n_buckets, width, fan
        self.runs: list[str] = []
        self.batches = self.compactions = 0

    def _run(self, name: str) -> DataFrame:
        return self.scratch.read(name, "bucket int, run binary, is_run int").where("is_run = 1").select("bucket", "run")

    def add(self, batch: DataFrame, *, last: bool = False) -> DataFrame:
        """Packed answers on ``batch(id, text)``: windows that a smaller id or an older batch holds.

        The last batch's hashes needn't be kept if nothing is to follow.
        """
        n_buckets, width = self.n_buckets, self.width

        def hold(b: pa.RecordBatch) -> Iterator[X.Held]:
            for part in H.slices(b):
                _, _, _, row, whole, one, two = _windows(part.column(1), width)
                yield part.column(0).to_numpy(), None, row[whole], one, two

        rows = X.packed(batch.select("id", "text"), hold, n_buckets, "earlier")
        for name in self.runs:
            rows = rows.union(X.as_packed(self._run(name)))
        self.batches += 1
        name = f"batch{self.batches}"
        found = X.answered(rows, "earlier", n_buckets, width=8, make_run=not last)
        found = self.scratch.save(found.withColumn("is_run", F.col("run").isNotNull().cast("int")), name, by="is_run")
        if not last:  # the run lies in a folder of its own beside the answers
            self.runs.append(name)
            if len(self.runs) > self.fan:
                self.compact()
        return found.where("is_run = 0")

    def compact(self) -> None:
        """Merge all runs into one; what they held stays, their files go."""
        if len(self.runs) > 1:
            every = self._run(self.runs[0])
            for name in self.runs[1:]:
                every = every.union(self._run(name))
            merged = f"merged{self.batches}"
            self.scratch.save(X.compacted(every, 8).withColumn("is_run", F.lit(1)), merged, by="is_run")
            for name in self.runs:
                self.scratch.drop_part(name, "is_run=1")
            self.runs = [merged]
            self.compactions += 1

    def close(self) -> None:
        """Drop the runs once no batch is to follow."""
        for name in self.runs:
            self.scratch.drop_part(name, "is_run=1")
        self.runs = []


def _batches(rows: DataFrame, n: int) -> list[DataFrame]:
    """The rows in n ranges of ids of about equal count."""
    low = rows.agg(F.min("id"), F.max("id")).first()
    if n < 2 or low[0] is None or low[0] == low[1]:
        return [rows]
    cuts = sorted(set(rows.select(F.expr(f"percentile_approx(id, array({', '.join(str(k / n) for k in range(1, n))}), 1000)")).first()[0]))
    edges = [None, *cuts, None]
    return [rows.where((F.lit(True) if a is None else F.col("id") > a) & (F.lit(True) if z is None else F.col("id") <= z)) for a, z in zip(edges, edges[1:], strict=False)]


def deduplicated(documents: DataFrame, *, width: int = 13, batches: int = 4, fan: int = 2, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, and the kept text if asked for.

    The rows come as ``batches`` ranges of ids, one after another; more than ``fan`` runs
    are compacted, so with four batches the third's end merges three runs.
    """
    spark = documents.sparkSession
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    n_buckets = buckets(documents)
    index = FingerprintIndex(spark, n_buckets, width=width, fan=fan)
    parts = _batches(rows, batches)
    answers = [index.add(part, last=k == len(parts) - 1) for k, part in enumerate(parts)]
    index.close()
    every = answers[0]
    for one in answers[1:]:
        every = every.union(one)
    told = X.merged(every).select("id", "cells")

    def cleaned(b: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in b:
            for part in H.slices(batch, "text"):
                yield _cleaned(part, width, n_buckets, texts)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    return rows.join(told, "id", "left").select("doc_id", "text", "cells").mapInArrow(cleaned, schema)


def _cleaned(part: pa.RecordBatch, width: int, n_buckets: int, texts: bool) -> pa.RecordBatch:
    data, start, length, row, whole, one, two = _windows(part.column(1), width)
    _, rest = X.split(one, two, n_buckets)
    edge = np.searchsorted(row, np.arange(part.num_rows + 1))
    first = np.searchsorted(row[whole], np.arange(part.num_rows + 1))
    raw = data.tobytes()
    n_removed, digests, kept_texts = [], [], []
    for k in range(part.num_rows):
        a, z = edge[k], edge[k + 1]
        cells = part.column(2)[k].as_py()
        gone = np.zeros(z - a, bool)
        if cells:
            of = slice(first[k], first[k + 1])
            copied = np.isin(rest[of], X.unpacked(cells, 8))
            gone = H.covered(whole[of][copied] - a, width, z - a)
        left = np.flatnonzero(~gone) + a
        kept = b" ".join([raw[s : s + n] for s, n in zip(start[left].tolist(), length[left].tolist(), strict=True)])
        n_removed.append(int(gone.sum()))
        digests.append(hashlib.sha256(kept).hexdigest())
        kept_texts.append(kept.decode())
    columns = [part.column(0), pa.array(np.diff(edge), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return pa.RecordBatch.from_arrays([*columns, pa.array(kept_texts, pa.string())] if texts else columns, names=[*names, "kept"] if texts else names)


ORACLE_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS k FROM words WHERE len(w) >= 13)
), firsts AS (SELECT gram, min(doc_id) AS low FROM windows GROUP BY gram
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(k, k + 12)) AS i FROM windows JOIN firsts USING (gram) WHERE doc_id > low
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM words) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)
"""
