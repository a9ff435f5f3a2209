"""The whole run over source files: scan, extract, normalize, score, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexigrade.functions.identifiers import vocabulary_words
from lexigrade.functions.redundancy import redundancy
from lexigrade.operators import vocabulary
from lexigrade.operators.extract import code_of, comments_of
from lexigrade.operators.metrics import Context
from lexigrade.operators.normalize import normalized
from lexigrade.operators.report import above
from lexigrade.operators.score import scored
from lexigrade.sources.files import Settings


def scored_comments(files: DataFrame, zipf: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """Comments of ``files(path, language_id, text)`` with text, words, score and redundancy.

    Words of the files' code are the vocabulary; frequencies are the comments' own unless
    ``zipf(word, zipf)`` gives others.  Equal comments (text, identifiers and symbol) are
    scored once and joined back.  Settings choose the languages, the weights, the ramp, known
    acronyms and, if only those are to be shown, the least score.
    """
    comments = normalized(comments_of(files.where(settings.keeps(F.col("language_id"))))).withColumn("known", F.when(F.col("target_symbol").isNull(), F.col("identifiers")).otherwise(F.array_append("identifiers", F.col("target_symbol"))))
    words = vocabulary.vocabulary(vocabulary.file_words(code_of(files), "path", vocabulary_words(F.col("text"))))
    lexicon = vocabulary.lexicon(vocabulary.zipf_table(comments) if zipf is None else zipf, words, settings.acronyms)
    keys = ["text", "known"]
    once = scored(comments.select(*keys).distinct(), context=Context(identifiers=F.col("known")), lexicon=lexicon, weights=settings.fitted(), start=settings.ramp_start, end=settings.ramp_end)
    out = comments.join(once, keys).withColumn("redundancy", redundancy(F.col("text"), F.col("target_symbol")))
    return above(out, settings.threshold) if settings.show_only_above else out
