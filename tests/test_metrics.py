import pytest
from pyspark.sql import functions as F

from lexigrade.operators import metrics as M
from lexigrade.operators.report import diagnostic_message, hover_markdown, lens_title
from lexigrade.operators.score import composite, scored

FIELDS = "tokens array<struct<text:string,normal:string,pos:string>>"


def measured(spark, name, tagged, identifiers=(), vocabulary=(), zipf=None):
    tokens = [(t.rsplit("/", 1)[0], t.rsplit("/", 1)[0].lower(), t.rsplit("/", 1)[1]) for t in tagged.split()]
    table = F.create_map(*(F.lit(x) for pair in (zipf or {"": 0.0}).items() for x in pair))
    strings = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    context = M.Context(strings(identifiers), strings(vocabulary), lambda w: F.try_element_at(table, w))
    return tuple(spark.createDataFrame([(tokens,)], FIELDS).select(M.METRICS[name](F.col("tokens"), context).alias("m")).first().m)


@pytest.mark.parametrize(
    ("name", "tagged", "value", "reason"),
    [
        ("nounStack", "user/NOUN session/NOUN cache/NOUN key/NOUN is/AUX old/ADJ", 4, 'Noun stack: "user session cache key"'),
        ("nounStack", "a/DET key/NOUN", 1, None),
        ("clauseCount", "If/SCONJ it/PRON fails/VERB it/PRON retries/VERB because/SCONJ that/DET works/VERB", 3, "3 clauses in one comment"),
        ("clauseCount", "does/AUX not/PART run/VERB", 1, None),
        ("lexicalDensity", "parse/VERB config/NOUN file/NOUN", 1, "Dense: 100% content words"),
        ("lexicalDensity", "./PUNCT", 0, None),
        ("negationCount", "do/AUX n't/PART never/ADV stop/VERB", 2, "2 negations"),
        ("danglingReference", "It/PRON fails/VERB", 1, '"It" has no antecedent'),
        ("danglingReference", "The/DET cache/NOUN fails/VERB ,/PUNCT it/PRON stops/VERB", 0, None),
        ("danglingReference", "This/DET cache/NOUN fails/VERB", 0, None),
        ("undefinedAcronyms", "The/DET LRU/PROPN and/CCONJ the/DET API/PROPN", 1, "Undefined acronym: LRU"),
        ("undefinedAcronyms", "least/ADJ recently/ADV used/VERB (/PUNCT LRU/PROPN )/PUNCT", 0, None),
        ("undefinedAcronyms", "BLS/PROPN (/PUNCT Bureau/PROPN of/ADP Labor/PROPN Statistics/PROPN )/PUNCT", 0, None),
        ("undefinedAcronyms", "TTLs/PROPN", 1, "Undefined acronym: TTL"),
    ],
)
def test_short_metrics(spark, name, tagged, value, reason):
    assert measured(spark, name, tagged) == (float(value), reason)


def test_zipf_metrics(spark):
    zipf = {"the": 7.7, "cache": 3.9, "idempotent": 1.5}
    tagged = "the/DET idempotent/ADJ cache/NOUN"
    assert measured(spark, "minZipf", tagged, zipf=zipf) == (1.5, 'Rare word: "idempotent"')
    assert measured(spark, "meanZipf", tagged, zipf=zipf) == (4.37, None)
    assert measured(spark, "minZipf", tagged, zipf=zipf, vocabulary=["idempotent"]) == (3.9, None)
    assert measured(spark, "minZipf", "the/DET", zipf=zipf) == (7.0, None)
    assert measured(spark, "meanZipf", "./PUNCT") == (7.0, None)
    assert measured(spark, "undefinedAcronyms", "TTL/PROPN", identifiers=["ttlMs"]) == (0.0, None)


def test_composite_blend_and_ties(spark):
    def scores(words, **values):
        result = {k: F.struct(F.lit(float(v)).alias("value"), F.lit(k).alias("reason")) for k, v in values.items()}
        return spark.range(1).select(composite(result, F.lit(words)).alias("s")).first().s

    easy = scores(40, nounStack=2, negationCount=0)
    assert (easy.score, easy.label, easy.reasons) == (0.0, "easy", [])
    hard = scores(40, nounStack=5, clauseCount=5, negationCount=3, undefinedAcronyms=2)
    assert (hard.score, hard.label) == (10.0, "hard")
    assert hard.reasons == ["undefinedAcronyms", "clauseCount", "negationCount"]
    assert scores(20, gunningFog=16).score == 0.0
    assert scores(30, gunningFog=16, nounStack=2).readability == 0.5


def test_scored_texts_and_presentation(spark):
    rows = spark.createDataFrame([(1, "Too short"), (2, "It does not retry unless the XQZ flag is not set, because that never works."), (3, None)], "id int, text string")
    df = scored(rows).select("id", "words", "score", lens_title(F.col("score")).alias("lens"), diagnostic_message(F.col("score")).alias("said"), hover_markdown(F.col("score"), F.col("words")).alias("hover"))
    got = df.collect()
    assert [r.id for r in got] == [2]
    assert got[0].lens == "complexity 5.3 · rare: It · 3 negations" and "3 negations" in got[0].said
    assert got[0].hover.count("\n| ") == 15 and "too short for them" in got[0].hover
