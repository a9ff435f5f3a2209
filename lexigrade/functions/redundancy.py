"""How much of a comment its symbol's name already says."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexigrade.functions import lexicons as L
from lexigrade.functions.identifiers import split_identifier
from lexigrade.functions.text import js_round, let


def canonical(word: Column) -> Column:
    """The word's synonym, or null."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in L.CANONICAL.items() for x in pair)), word)


def stem(word: Column) -> Column:
    """Plurals, -ing and -ed go; synonyms meet before and after."""
    one = F.coalesce(canonical(word), word)
    n = F.length(one)
    two = (
        F.when((n > 4) & one.endswith("ies"), F.concat(F.left(one, n - 3), F.lit("y")))
        .when((n > 4) & one.rlike(r"(?:[sxz]|[cs]h)es\z"), F.left(one, n - 2))
        .when((n > 3) & one.endswith("s") & ~one.rlike(r"(?:ss|us|is)\z"), F.left(one, n - 1))
        .otherwise(one)
    )
    base = F.regexp_extract(two, r"^(.{3,}?)(?:ing|ed)\z", 1)
    three = F.when(base != "", F.regexp_replace(base, r"([^aeiou])\1\z", "$1")).otherwise(two)
    return F.coalesce(canonical(three), canonical(F.concat(three, F.lit("e"))), three)


def content_words(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))
    return F.transform(F.filter(found, lambda w: ~w.isin(L.FILLER)), stem)


def same_word(a: Column, b: Column) -> Column:
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a == b) | ((F.length(short) >= 4) & F.startswith(long, short) & (F.length(long) - F.length(short) <= 2))


def redundancy(text: Column, symbol: Column) -> Column:
    """struct(redundant, overlap, reason); the threshold is on the unrounded share."""

    def compared(made: Column) -> Column:
        said = F.size(F.filter(made.words, lambda w: F.exists(made.parts, lambda p: same_word(w, p))))
        share = F.when(symbol.isNull() | (F.size(made.words) == 0), F.lit(0.0)).otherwise(F.try_divide(said.cast("double"), F.size(made.words)))
        return let(share, lambda s: F.struct((s >= L.REDUNDANCY_THRESHOLD).alias("redundant"), js_round(s, 2).alias("overlap"), F.when(s >= L.REDUNDANCY_THRESHOLD, F.concat(F.lit('Restates the name "'), symbol, F.lit('"'))).alias("reason")))

    parts = F.transform(F.split(F.coalesce(split_identifier(symbol), F.lit("")), " "), stem)
    return let(F.struct(content_words(text).alias("words"), parts.alias("parts")), compared)
