"""Identifier tests and the two splitters, which differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexigrade.functions.lexicons import PROSE_WORDS

TOKEN = r"(?<![A-Za-z0-9_$])[A-Za-z_$][A-Za-z0-9_$]*(?:(?:\.|::)[A-Za-z_$][A-Za-z0-9_$]*)*(?:\(\))?"
_CODE_SHAPE = r"[a-z0-9][A-Z]|[A-Z]{2,}[a-z]{2}|[A-Za-z0-9]_[A-Za-z0-9]|^_|\$"


def _parts(text: Column, pattern: str) -> Column:
    return F.transform(F.filter(F.split(text, pattern), lambda p: p != ""), F.lower)


def is_identifier(token: Column) -> Column:
    dotted = F.forall(F.split(token, r"\."), lambda p: F.length(p) > 1)
    return ~token.isin(PROSE_WORDS) & (
        token.endswith("()") | F.contains(token, F.lit("::")) | F.when(F.contains(token, F.lit(".")), dotted).otherwise(token.rlike(_CODE_SHAPE))
    )


def split_identifier(identifier: Column) -> Column:
    """``getUserName`` to ``get user name``; digits stay inside words."""
    bare = F.regexp_replace(identifier, r"\(\)\z", "")
    return F.array_join(_parts(bare, r"[.:_$]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"), " ")


def identifier_words(identifiers: Column) -> Column:
    """Distinct words of an array of identifiers; everything but letters separates."""
    split = F.transform(identifiers, lambda i: _parts(i, r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"))
    return F.array_distinct(F.flatten(split))


def vocabulary_words(text: Column) -> Column:
    """Distinct words of all identifier tokens of a code text: two letters or more, no digits."""
    tokens = F.regexp_extract_all(text, F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))
    parts = F.flatten(F.transform(tokens, lambda t: F.split(split_identifier(t), " ")))
    return F.array_distinct(F.filter(parts, lambda w: w.rlike(r"^[a-z]{2,}\z")))
