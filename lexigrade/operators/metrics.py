"""The nine short-text metrics over tagged tokens, as folds in column expressions.

Each takes (tokens, context) and gives struct(value, reason).  A context has the columns
``identifiers`` and ``vocabulary`` (arrays), ``zipf``, a function from a word to its Zipf
frequency or null, and ``known``, one from a word to whether a large vocabulary has it.
``METRICS`` is the registry; add to it to extend the scores.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from lexigrade.functions import lexicons as L
from lexigrade.functions.identifiers import identifier_words
from lexigrade.functions.text import js_round, let, number
from lexigrade.functions.tokens import is_word


def _none() -> Column:
    return F.array().cast("array<string>")


@dataclass
class Context:
    """What the reader knows: names in the code, words of the workspace, word frequencies."""

    identifiers: Column = field(default_factory=_none)
    vocabulary: Column = field(default_factory=_none)
    zipf: Callable[[Column], Column] = lambda word: F.lit(None).cast("double")
    known: Callable[[Column], Column] = lambda word: F.lit(False)
    #: Whether tokens carry a lexicon's answers (``zipf`` and ``flags``) themselves.
    looked: bool = False

    def zipf_of(self, token: Column) -> Column:
        return token.zipf if self.looked else self.zipf(token.normal)

    def knows(self, token: Column) -> Column:
        return token.flags.bitwiseAND(1) == 1 if self.looked else self.known(token.normal)

    def knows_acronym(self, token: Column, acronym: Column) -> Column:
        return token.flags.bitwiseAND(2) == 2 if self.looked else self.known(F.lower(acronym))


def _result(value: Column, when: Column, reason: Column) -> Column:
    return F.struct(value.cast("double").alias("value"), F.when(when, reason).alias("reason"))


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def noun_stack(tokens: Column, context: Context) -> Column:
    """Longest run of nouns, adjectives and names; the first of equal ones."""
    start = F.struct(_none().alias("run"), _none().alias("best"))

    def step(state: Column, token: Column) -> Column:
        run = F.when(token.pos.isin("NOUN", "ADJ", "PROPN"), F.array_append(state.run, token.text)).otherwise(_none())
        return F.struct(run.alias("run"), F.when(F.size(run) > F.size(state.best), run).otherwise(state.best).alias("best"))

    best = F.aggregate(tokens, start, step).best
    return let(best, lambda b: _result(F.size(b), F.size(b) >= 3, F.concat(F.lit('Noun stack: "'), F.array_join(b, " "), F.lit('"'))))


def clause_count(tokens: Column, context: Context) -> Column:
    """Verb groups, or subordinators and the main clause, whichever are more."""
    start = F.struct(_long(0).alias("groups"), F.lit(False).alias("inside"), _long(0).alias("links"))

    def step(state: Column, token: Column) -> Column:
        verb = token.pos.isin("VERB", "AUX")
        link = token.normal.isin(L.SUBORDINATORS) & (token.pos != "DET")
        return F.struct(
            (state.groups + (verb & ~state.inside).cast("long")).alias("groups"),
            F.when(verb, F.lit(True)).when(token.pos.isin("PART", "ADV"), state.inside).otherwise(F.lit(False)).alias("inside"),
            (state.links + link.cast("long")).alias("links"),
        )

    value = let(F.aggregate(tokens, start, step), lambda end: F.greatest(end.groups, end.links + (end.groups > 0).cast("long")))
    return let(value, lambda v: _result(v, v >= 3, F.concat(v.cast("string"), F.lit(" clauses in one comment"))))


def rated_words(tokens: Column, context: Context) -> Column:
    """Plain words that neither the code nor the workspace uses."""
    names = F.array_union(identifier_words(context.identifiers), context.vocabulary)
    return let(names, lambda n: F.filter(tokens, lambda t: is_word(t) & t.normal.rlike(r"^[a-z]+\z") & ~F.array_contains(n, t.normal) & ~context.knows(t)))


def _rated(tokens: Column, context: Context) -> Column:
    return F.transform(rated_words(tokens, context), lambda t: F.struct(F.coalesce(context.zipf_of(t), F.lit(L.UNLISTED_ZIPF)).alias("zipf"), t.text.alias("text")))


def mean_zipf(tokens: Column, context: Context) -> Column:

    def mean(rated: Column) -> Column:
        total = F.aggregate(rated, F.lit(0.0), lambda s, r: s + r.zipf)
        return F.when(F.size(rated) == 0, F.lit(L.COMMON_ZIPF)).otherwise(js_round(F.try_divide(total, F.size(rated)), 2))

    return _result(let(_rated(tokens, context), mean), F.lit(False), F.lit(""))


def min_zipf(tokens: Column, context: Context) -> Column:
    start = F.struct(F.lit(L.COMMON_ZIPF).alias("zipf"), F.lit(None).cast("string").alias("text"))
    least = F.aggregate(_rated(tokens, context), start, lambda s, r: F.when(r.zipf < s.zipf, r).otherwise(s))
    return let(least, lambda best: _result(best.zipf, best.text.isNotNull() & (best.zipf < 3), F.concat(F.lit('Rare word: "'), best.text, F.lit('"'))))


def lexical_density(tokens: Column, context: Context) -> Column:
    words = F.size(F.filter(tokens, is_word))
    content = F.size(F.filter(tokens, lambda t: t.pos.isin(L.CONTENT_TAGS)))
    value = F.when(words == 0, F.lit(0.0)).otherwise(js_round(F.try_divide(content.cast("double"), words), 2))
    return _result(value, value >= 0.75, F.concat(F.lit("Dense: "), number(js_round(value * 100)), F.lit("% content words")))


def negation_count(tokens: Column, context: Context) -> Column:
    value = F.size(F.filter(tokens, lambda t: t.normal.isin(L.NEGATIONS)))
    return _result(value, value >= 2, F.concat(value.cast("string"), F.lit(" negations")))


def dangling_reference(tokens: Column, context: Context) -> Column:
    """References that stand alone before any noun."""
    start = F.struct(F.lit(False).alias("named"), _none().alias("dangling"))

    def step(state: Column, place: Column) -> Column:
        token, following = F.get(tokens, place), F.get(tokens, place + 1)
        noun = token.pos.isin("NOUN", "PROPN")
        alone = (token.pos == "PRON") | ((token.pos == "DET") & ~F.coalesce(following.pos.isin("NOUN", "PROPN", "ADJ", "NUM"), F.lit(False)))
        found = ~state.named & ~noun & alone & token.normal.isin(L.REFERENCES)
        return F.struct((state.named | noun).alias("named"), F.when(found, F.array_append(state.dangling, token.text)).otherwise(state.dangling).alias("dangling"))

    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    return let(F.aggregate(places, start, step).dangling, lambda d: _result(F.size(d), F.size(d) > 0, F.concat(F.lit('"'), F.get(d, F.lit(0)), F.lit('" has no antecedent'))))


def _initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.upper(F.left(w, F.lit(1)))), "")


def _expands(words: Column, acronym: Column) -> Column:
    major = F.filter(words, lambda w: ~F.lower(w).isin(L.MINOR_WORDS))
    return (_initials(words) == acronym) | (_initials(major) == acronym)


def _defined_in_place(tokens: Column, place: Column, acronym: Column) -> Column:
    """Spelt out in brackets after the acronym, or by the plain words before its bracket."""
    plain = r"^[A-Za-z][A-Za-z'-]*\z"
    texts = F.transform(tokens, lambda t: t.text)
    rest = F.slice(texts, place + 3, F.greatest(F.lit(0), F.size(texts) - place - 2))
    close = F.array_position(rest, ")")
    inside = F.when(close > 0, F.slice(rest, F.lit(1), (close - 1).cast("int"))).otherwise(rest)
    after = (F.get(texts, place + 1) == "(") & F.forall(inside, lambda w: w.rlike(plain)) & _expands(inside, acronym)
    head = F.when(place >= 2, F.slice(texts, F.lit(1), place - 1)).otherwise(_none())
    back = F.reverse(head)
    stop = F.array_position(F.transform(back, lambda w: w.rlike(plain)), False)
    before = F.reverse(F.when(stop > 0, F.slice(back, F.lit(1), (stop - 1).cast("int"))).otherwise(back))
    n, m = F.length(acronym), F.size(before)
    lengths = F.when(n <= m, F.sequence(n, m)).otherwise(F.array().cast("array<int>"))
    ahead = (place >= 1) & (F.get(texts, F.greatest(place - 1, F.lit(0))) == "(") & F.exists(lengths, lambda k: _expands(F.slice(before, m - k + 1, k), acronym))
    return F.coalesce(after, F.lit(False)) | F.coalesce(ahead, F.lit(False))


def undefined_acronyms(tokens: Column, context: Context) -> Column:
    names = F.transform(F.array_union(identifier_words(context.identifiers), context.vocabulary), F.upper)
    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    spelt = F.transform(places, lambda i: F.struct(i.alias("place"), F.regexp_extract(F.get(tokens, i).text, r"^([A-Z]{2,})s?\z", 1).alias("acronym"), F.get(tokens, i).alias("token")))
    found = F.filter(spelt, lambda f: (f.acronym != "") & ~f.acronym.isin(L.KNOWN_ACRONYMS))
    open_ = let(names, lambda known: F.filter(found, lambda f: ~F.array_contains(known, f.acronym) & ~context.knows_acronym(f.token, f.acronym)))
    named = F.array_distinct(F.transform(F.filter(open_, lambda f: ~_defined_in_place(tokens, f.place, f.acronym)), lambda f: f.acronym))
    return let(named, lambda n: _result(F.size(n), F.size(n) > 0, F.concat(F.when(F.size(n) > 1, F.lit("Undefined acronyms: ")).otherwise(F.lit("Undefined acronym: ")), F.array_join(n, ", "))))


def comment_length(tokens: Column, context: Context) -> Column:
    value = F.size(F.filter(tokens, is_word))
    return _result(value, value >= 60, F.concat(F.lit("Long comment: "), value.cast("string"), F.lit(" words")))


METRICS: dict[str, Callable[[Column, Context], Column]] = {
    "nounStack": noun_stack,
    "clauseCount": clause_count,
    "meanZipf": mean_zipf,
    "minZipf": min_zipf,
    "lexicalDensity": lexical_density,
    "negationCount": negation_count,
    "danglingReference": dangling_reference,
    "undefinedAcronyms": undefined_acronyms,
    "commentLength": comment_length,
}
