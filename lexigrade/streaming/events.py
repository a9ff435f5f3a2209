"""Document events: latest version, debounce, and a refcounted vocabulary kept up to date.

Each operator has a batch form over a table of events.  ``vocabulary_updates`` is the
streaming form: state per file holds the newest version's words and emits what a change
adds and takes away, so sums of the deltas are the vocabulary at any time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

DEBOUNCE_MS = 300


def latest(events: DataFrame, key: str, version: str) -> DataFrame:
    """The newest event of each key, all columns; one hash aggregation, no sort.

    Equal versions are settled by the whole row, so the result doesn't depend on order.
    """
    whole = F.struct(version, *(c for c in events.columns if c != version))
    return events.groupBy(F.col(key).alias("_key")).agg(F.max(whole).alias("row")).select(*(F.col(f"row.{c}") for c in events.columns))


def debounced(events: DataFrame, key: str, ts: str, tie: str, millis: int = DEBOUNCE_MS) -> DataFrame:
    """Events that no other event of their key follows within the time: trailing edge."""
    following = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, tie))
    gap = F.unix_millis(following.cast("timestamp")) - F.unix_millis(F.col(ts).cast("timestamp"))
    return events.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > millis)).drop("_gap")


def debounced_stream(events: DataFrame, key: str, ts: str, millis: int = DEBOUNCE_MS, late: str = "10 seconds") -> DataFrame:
    """(key, at, events): the end of each burst of a key, as session windows with a watermark."""
    stream = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return stream.groupBy(F.col(key).alias("key"), F.session_window("_at", f"{millis} milliseconds")).agg(F.max("_at").alias("at"), F.count("*").alias("events")).select("key", "at", "events")


def fresh(results: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """Results whose version is still the document's; closed documents have none."""
    return results.join(versions.select(key, "version"), [key, "version"], "left_semi")


def evicted(results: DataFrame, closed: DataFrame, key: str) -> DataFrame:
    """Results without those of closed documents; a null key is never closed."""
    return results.join(closed.select(key), key, "left_anti")


def scored_once(comments: DataFrame, keys: list[str], score) -> DataFrame:
    """comments with the columns that ``score`` adds to their distinct keys, computed once each."""
    return comments.join(score(comments.select(*keys).distinct()), keys, "left")


def vocabulary_updates(events: DataFrame, words: Column) -> DataFrame:
    """(word, delta) of a stream ``events(file, version, kind, text)``; kinds upsert and delete.

    An event older than the version that a file's state holds is discarded.
    """
    rows = events.select("file", "version", "kind", F.when(F.col("kind") == "delete", F.array().cast("array<string>")).otherwise(F.array_distinct(words)).alias("words"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        version, held = state.get if state.exists else (-1, [])
        before = set(held)
        now = before
        for batch in batches:
            for row in batch.sort_values("version").itertuples():
                if row.version > version:
                    version, now = int(row.version), set(row.words)
        state.update((version, sorted(now)))
        changes = [(w, 1) for w in sorted(now - before)] + [(w, -1) for w in sorted(before - now)]
        yield pd.DataFrame(changes, columns=["word", "delta"])

    return rows.groupBy("file").applyInPandasWithState(update, "word string, delta long", "version long, words array<string>", "append", "NoTimeout")
