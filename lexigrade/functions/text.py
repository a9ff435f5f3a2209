"""Text statistics as column expressions: sentences, words, syllables, letters.

Nothing here shuffles; a text's words are one array and every count is a fold over it.
Regular expressions stay within what Java and RE2 both give the same meaning, except the
sentence split, which uses lookbehind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from lexigrade.functions.lexicons import SYLLABLE_EXTRA

WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
SENTENCE_END = r"""(?i)(?<=[.!?]["'”’)\]]{0,9})(?<!(?<![A-Za-z0-9_])(?:e\.g|i\.e|etc|vs|cf)\.)\s+"""
VOWELS = "aeiouyàâäáãåéèêëíìîïóòôöõúùûüœæ"
_V, _C = f"[{VOWELS}]", f"[^{VOWELS}"
SILENT = rf"{_V}.*(?:{_C}l]e|(?:{_C}cgsxzhl]|{_C}cs]h)es|{_C}tdl]ed)$"
SYLLABIC_ENDING = r"(?:ing|[td]ed|(?:[cgsxz]|[cs]h)es)$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value evaluated once, also where body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js_round(value: Column, digits: int = 0) -> Column:
    """Half up, also below zero."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def number(value: Column) -> Column:
    """A double as text, whole numbers without a point."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def sentences(text: Column) -> Column:
    """Sentences that hold a letter; every line is split by itself."""
    lines = F.split(text, "\n", -1)
    return F.filter(F.flatten(F.transform(lines, lambda line: F.split(line, SENTENCE_END, -1))), lambda s: s.rlike(r"\p{L}"))


def words(text: Column) -> Column:
    """Words with at least one letter, as they stand."""
    return F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: w.rlike(r"\p{L}"))


def raw_syllables(word: Column) -> Column:
    """Vowel groups, less a silent ending; may be 0."""
    low = F.lower(word)
    groups = F.regexp_count(low, F.lit(f"{_V}+"))
    return groups - low.rlike(SILENT).cast("int") + low.isin(SYLLABLE_EXTRA).cast("int")


def is_complex(word: Column, syllables: Column) -> Column:
    parts = F.split(word, "-")
    compound = (F.size(parts) > 1) & F.forall(parts, lambda p: raw_syllables(p) <= 1)
    return ~compound & (syllables - F.lower(word).rlike(SYLLABIC_ENDING).cast("int") >= 3)


def text_stats(text: Column) -> Column:
    """struct(sentences, words, syllables, letters, complex_words); a null text has none.

    One Arrow pass that keeps what it knows of a word: as expressions, some ten patterns a
    word are interpreted, which took about 50 times as long.  Marked as not deterministic
    only so that a filter on the result isn't pushed below it, which would run it twice.
    """
    from lexigrade.functions.counting import counted

    return counted(F.coalesce(text.cast("string"), F.lit("")))


def _formula(stats: Column, value: Column) -> Column:
    return F.when(stats.words == 0, F.lit(0.0)).otherwise(js_round(value, 2))


def _metric(value: Column, least: float, reason: Column) -> Column:
    return F.struct(value.alias("value"), F.when(value >= least, reason).alias("reason"))


def _per_word(stats: Column, part: Column) -> Column:
    return F.try_divide(part.cast("double"), stats.words.cast("double"))


def _per_sentence(stats: Column) -> Column:
    return F.try_divide(stats.words.cast("double"), stats.sentences.cast("double"))


def flesch_kincaid(stats: Column) -> Column:
    value = _formula(stats, 0.39 * _per_sentence(stats) + 11.8 * _per_word(stats, stats.syllables) - 15.59)
    return _metric(value, 12, F.concat(F.lit("Flesch-Kincaid grade "), number(value)))


def gunning_fog(stats: Column) -> Column:
    value = _formula(stats, 0.4 * (_per_sentence(stats) + 100 * _per_word(stats, stats.complex_words)))
    return _metric(value, 12, F.concat(F.lit("Gunning Fog index "), number(value)))


def coleman_liau(stats: Column) -> Column:
    value = _formula(stats, 0.0588 * (_per_word(stats, stats.letters) * 100) - 0.296 * (_per_word(stats, stats.sentences) * 100) - 15.8)
    return _metric(value, 12, F.concat(F.lit("Coleman-Liau index "), number(value)))


def average_sentence_length(stats: Column) -> Column:
    value = _formula(stats, _per_sentence(stats))
    return _metric(value, 25, F.concat(F.lit("Long sentences: "), number(value), F.lit(" words on average")))


READABILITY = {
    "fleschKincaidGrade": flesch_kincaid,
    "gunningFog": gunning_fog,
    "colemanLiau": coleman_liau,
    "averageSentenceLength": average_sentence_length,
}


def readability_weight(words_: Column, start: float = 20, end: float = 40) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (words_ - start) / (end - start)))
