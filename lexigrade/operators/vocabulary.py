"""Corpus vocabularies and word frequencies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexigrade.functions import lexicons as L
from lexigrade.sources.files import is_scanned, is_within

#: A plain word, lower-cased.
PLAIN = "[a-z]+"
#: Words that a frequency table holds.
MOST_RATED = 50_000


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(PLAIN), F.lit(0))


def file_words(files: DataFrame, key: str, words: Column) -> DataFrame:
    """(file, word), distinct within a file without a shuffle."""
    return files.select(F.col(key).alias("file"), F.explode(F.array_distinct(words)).alias("word"))


def file_counts(pairs: DataFrame) -> DataFrame:
    """(word, files): in how many files a word stands; counted map-side first."""
    return pairs.groupBy("word").agg(F.count("*").alias("files"))


def file_count(pairs: DataFrame) -> DataFrame:
    """(files): how many files give words to the vocabulary."""
    return pairs.agg(F.count_distinct("file").alias("files"))


def kept(path: str, pairs: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """The pairs written at the path; made and written by the first call, read by later ones."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    pairs().write.parquet(path)
    return spark.read.parquet(path)


def vocabulary(pairs: DataFrame, most: int = L.MAX_VOCABULARY) -> DataFrame:
    """The words of most files, ties alphabetical, at most ``most``; a top-k, not a full sort."""
    return file_counts(pairs).orderBy(F.desc("files"), "word").limit(most)


def renamed(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """Pairs after a file or folder was renamed."""
    inside = (F.col("file") == old) | F.startswith(F.col("file"), F.lit(old + "/"))
    return pairs.withColumn("file", F.when(inside, F.concat(F.lit(new), F.substr(F.col("file"), F.lit(len(old) + 1)))).otherwise(F.col("file")))


def removed(pairs: DataFrame, path: str) -> DataFrame:
    return pairs.where(~((F.col("file") == path) | F.startswith(F.col("file"), F.lit(path + "/"))))


def moved(pairs: DataFrame, old: str, new: str, excluded: list[str] | None = None) -> DataFrame:
    """Pairs after a rename, with the scan rules checked again: a file that no longer passes
    them is dropped, and one that is written over gives way."""
    inside = is_within(F.col("file"), old)
    target = F.concat(F.lit(new), F.substr(F.col("file"), F.lit(len(old) + 1)))
    there = pairs.where(inside).withColumn("file", target).where(is_scanned(F.col("file"), excluded))
    rest = pairs.where(~inside)
    below = is_within(F.col("file"), new)
    stays = rest.where(below).join(there.select("file").distinct(), "file", "left_anti")
    return rest.where(~below).unionByName(stays).unionByName(there)


def admitted(changes: DataFrame, tracked: DataFrame, order: str, most: int = L.MAX_FILES) -> DataFrame:
    """``changes(file, ...)`` that are taken in: all of tracked files, and of new files those that
    came first while fewer than ``most`` files are tracked.

    The limit is a workspace's, not a corpus'.  New files are aggregated before the top-k, and
    at most ``most`` of them are broadcast.  Ties go by name; a null file is never taken in.
    """
    files = tracked.select("file").where("file is not null").distinct()
    new = changes.join(files, "file", "left_anti").where("file is not null").groupBy("file").agg(F.min(order).alias("at"))
    room = max(0, most - files.limit(most).count())
    taken = new.orderBy("at", "file").limit(room).select("file")
    return changes.join(files, "file", "left_semi").unionByName(changes.join(F.broadcast(taken), "file", "left_semi"))


def zipf_table(texts: DataFrame, text: str = "text", most: int = MOST_RATED) -> DataFrame:
    """(word, zipf): log10 of occurrences per thousand million words, of the most frequent."""
    words = texts.select(F.explode(plain_words(F.col(text))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    rated = counts.join(F.broadcast(total)).withColumn("zipf", F.floor(F.log10(F.col("n") * 1e9 / F.col("total")) * 100 + 0.5) / 100)
    return rated.orderBy(F.desc("n"), "word").limit(most).select("word", "zipf")


def zipf_of_buckets(buckets: DataFrame, most: int = MOST_RATED) -> DataFrame:
    """(word, zipf) from ``buckets(bucket, words)``: bucket i is (900 - i) / 100; first of repeated words."""
    words = buckets.select("bucket", F.posexplode("words").alias("place", "word")).where(F.col("word").rlike(r"^[a-z]+\z"))
    first = words.groupBy("word").agg(F.min(F.struct("bucket", "place")).alias("at"))
    return first.orderBy("at").limit(most).select("word", ((900 - F.col("at.bucket")) / 100).alias("zipf"))


def rated_words(texts: DataFrame, key: str, vocabulary_: DataFrame, zipf: DataFrame, text: str = "text") -> DataFrame:
    """(key, word, zipf) of words outside the vocabulary; words not in the table get the least.

    Both sides are bounded tables (20,000 and 50,000 words) and are broadcast.
    """
    words = texts.select(key, F.explode(plain_words(F.col(text))).alias("word"))
    unknown = words.join(F.broadcast(vocabulary_.select("word")), "word", "left_anti")
    return unknown.join(F.broadcast(zipf), "word", "left").withColumn("zipf", F.coalesce("zipf", F.lit(L.UNLISTED_ZIPF)))


class Lexicon:
    """Frequencies and vocabulary, broadcast as one table: 70,000 words at the most."""

    def __init__(self, zipf: DataFrame, vocabulary_: DataFrame, acronyms: Iterable[str] = ()):
        words = {r.word: r.zipf for r in zipf.limit(MOST_RATED).collect()}
        known = {r.word for r in vocabulary_.limit(L.MAX_VOCABULARY).collect()} | set(acronyms)
        self.table = zipf.sparkSession.sparkContext.broadcast((words, known))

    def entries(self, texts: Column) -> Column:
        """struct(zipf, flags) of an array of tokens' texts: an array of frequencies, null where
        a token isn't listed, and one of flags: 1 if it is known, 2 if the acronym it is is."""
        table = self.table

        def looked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            words, known = table.value
            acronym = re.compile("([A-Z]{2,})s?")

            def flags(token: str) -> int:
                spelt = acronym.fullmatch(token)
                return (token.lower() in known) | (spelt is not None and spelt.group(1).lower() in known) << 1

            for batch in batches:
                rows = [list(tokens) for tokens in batch]
                yield pd.DataFrame({"zipf": [[words.get(t.lower()) for t in tokens] for tokens in rows], "flags": [[flags(t) for t in tokens] for tokens in rows]})

        looked.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(looked, "zipf array<double>, flags array<int>")(texts)


def lexicon(zipf: DataFrame, vocabulary_: DataFrame, acronyms: Iterable[str] = ()) -> Lexicon:
    """The lexicon of ``zipf(word, zipf)`` and ``vocabulary_(word)``, to which the acronyms are added."""
    return Lexicon(zipf, vocabulary_, acronyms)
