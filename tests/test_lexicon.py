"""Word frequencies and vocabulary reach the scores."""

from pyspark.sql import functions as F

from lexigrade.operators import vocabulary
from lexigrade.operators.score import scored
from lexigrade.plans.catalog import QUERIES
from lexigrade.plans.corpus import scored_comments


def values(score):
    return {c.metric: c.value for c in score.contributions}


def test_lexicon_tells_common_from_rare_words(spark):
    docs = spark.createDataFrame([(1, "the ledger waits here"), (2, "the quokka waits here"), (3, "the ledger waits zzyzx")], "doc_id long, text string")
    zipf = spark.createDataFrame([("the", 7.7), ("ledger", 4.1), ("waits", 4.5), ("here", 5.9), ("quokka", 2.6)], "word string, zipf double")
    known = spark.createDataFrame([("zzyzx",), ("here",)], "word string")
    got = {r.doc_id: r.score for r in scored(docs, lexicon=vocabulary.lexicon(zipf, known)).collect()}
    assert [values(got[k])["minZipf"] for k in (1, 2, 3)] == [4.1, 2.6, 4.1]
    assert [values(got[k])["meanZipf"] for k in (1, 2)] == [5.43, 4.93]
    assert 'Rare word: "quokka"' in got[2].reasons and not any("Rare word" in r for r in got[1].reasons)


def test_full_score_rates_by_the_corpus(spark, tmp_path):
    filler = " ".join(f"{a}{b}" for a in "abcdefghijk" for b in "abcdefghijk")  # more than the vocabulary's 100 words
    rows = [(k, f"{filler} ledger ledger ledger", "en", "s", 1) for k in range(5)] + [(9, "a quokka naps", "en", "s", 1), (10, "a ledger naps", "de", "s", 1), (11, "a ledger naps", None, "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["full_score"](spark, str(tmp_path)).collect()}
    assert len(got) == 8 and got[10].hover_md5 == got[11].hover_md5 and got[9].hover_md5 != got[10].hover_md5 and not any("Rare word" in r.reasons for r in got.values())


def test_comments_know_the_words_of_the_code(spark):
    files = spark.createDataFrame([("a.kt", "kotlin", '// Holds the quokka and the XQZ until flushed\nval s = "wombat"'), ("b.kt", "kotlin", "// Holds the wombat and the XQZ until flushed\nval s = 2"), ("c.kt", "kotlin", "val quokkaXqz = 1")], "path string, language_id string, text string")
    zipf = spark.createDataFrame([(w, 6.0) for w in ("holds", "the", "and", "until", "flushed")], "word string, zipf double")
    got = {r.path: r.score for r in scored_comments(files, zipf).collect()}
    assert values(got["a.kt"])["minZipf"] == 6.0 and values(got["b.kt"])["minZipf"] == 2.0
    assert values(got["a.kt"])["undefinedAcronyms"] == 0
    own = {r.path: r.score for r in scored_comments(files).select("path", "score").collect()}
    assert values(own["b.kt"])["minZipf"] > 3
