"""Tokens with part-of-speech tags by a closed-class lexicon and suffix rules.

The tags are approximate: a word's tag doesn't depend on its neighbours.  The metrics only
see ``ARRAY<STRUCT<text, normal, pos>>`` and are exact for any tagger's tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexigrade.functions.lexicons import POS_SUFFIXES, POS_WORDS, WORD_TAGS

CONTRACTION = r"(?i)([a-z])(n't|'s|'re|'ve|'ll|'d|'m)([^a-z]|$)"
TOKEN = r"(?i)n't|'(?:re|ve|ll|s|d|m)|[\p{L}\p{N}]+(?:[-_.'’][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"


def part_of_speech(token: Column) -> Column:
    low = F.lower(token)
    tag = F.when(~token.rlike(r"[\p{L}\p{N}]"), F.lit("PUNCT"))
    tag = tag.when(token.rlike(r"^[0-9][0-9.,]*\z"), F.lit("NUM")).when(token.rlike(r"^[A-Z]{2,}s?\z"), F.lit("PROPN"))
    for pos, listed in POS_WORDS.items():
        tag = tag.when(low.isin(listed), F.lit(pos))
    for pos, suffix in POS_SUFFIXES:
        tag = tag.when(low.rlike(suffix), F.lit(pos))
    return tag.otherwise(F.lit("NOUN"))


def token_texts(text: Column) -> Column:
    """Tokens of every line in order, contractions split off."""
    apart = F.regexp_replace(F.coalesce(text, F.lit("")), CONTRACTION, "$1 $2$3")
    return F.regexp_extract_all(apart, F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """Tagged tokens of every line in order."""
    return F.transform(token_texts(text), lambda t: F.struct(t.alias("text"), F.lower(t).alias("normal"), part_of_speech(t).alias("pos")))


def is_word(token: Column) -> Column:
    return token.pos.isin(WORD_TAGS)
