"""Text statistics over Arrow batches; the rules are those of ``functions.text``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, functions as F

from lexigrade.functions.lexicons import SYLLABLE_EXTRA
from lexigrade.functions.text import SILENT, SYLLABIC_ENDING, VOWELS, WORD

_WORD = regex.compile(WORD)
_LETTER = regex.compile(r"\p{L}")
_LETTERS = regex.compile(r"\p{L}+")
_GROUP = regex.compile(f"[{VOWELS}]+")
_SILENT = regex.compile(SILENT.replace("$", r"\Z"))
_ENDING = regex.compile(SYLLABIC_ENDING.replace("$", r"\Z"))
_EXTRA = frozenset(SYLLABLE_EXTRA)
# whitespace after a sentence's end, of which an abbreviation's isn't one
_END = regex.compile(r"""(?<=[.!?]["'”’)\]]*)(?<!(?i:(?<![A-Za-z0-9_])(?:e\.g|i\.e|etc|vs|cf)\.))[ \t\n\x0b\f\r]+""")
COUNTS = ("sentences", "words", "syllables", "letters", "complex_words")
#: Words kept with their counts; what a corpus uses most is always among them.
_KEPT = 1 << 17


def _syllables(word: str) -> int:
    low = word.lower()
    return len(_GROUP.findall(low)) - (_SILENT.search(low) is not None) + (low in _EXTRA)


@lru_cache(maxsize=_KEPT)
def word_counts(word: str) -> tuple[int, int, int]:
    """(words, syllables, complex words) of one match: 0 for a number."""
    if not _LETTER.search(word):
        return 0, 0, 0
    n = max(1, _syllables(word))
    parts = word.split("-")
    compound = len(parts) > 1 and all(_syllables(p) <= 1 for p in parts)
    return 1, n, int(not compound and n - (_ENDING.search(word.lower()) is not None) >= 3)


def count(text: str) -> tuple[int, int, int, int, int]:
    """(sentences, words, syllables, letters, complex words) of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    n = syllables = hard = 0
    for word in _WORD.findall(text):
        a, b, c = word_counts(word)
        n, syllables, hard = n + a, syllables + b, hard + c
    letters = sum(map(len, _LETTERS.findall(text)))
    sentences = sum(_LETTER.search(s) is not None for line in text.split("\n") for s in _END.split(line))
    return sentences, n, syllables, letters, hard


def counted(text: Column) -> Column:
    """struct(sentences, words, syllables, letters, complex_words) of a text that isn't null."""

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([count(t) for t in batch], columns=list(COUNTS), dtype="int64")

    batches.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    made = F.pandas_udf(batches, ", ".join(f"{c} long" for c in COUNTS))
    return made.asNondeterministic()(text)
