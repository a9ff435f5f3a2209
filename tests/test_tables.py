import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrade.operators import calibrate, vocabulary
from lexigrade.operators.score import PRIORS
from lexigrade.sources import files as S
from lexigrade.streaming import events as E


def test_vocabulary(spark):
    docs = spark.createDataFrame([("a", "red blue red"), ("b", "blue"), ("c", None)], "file string, text string")
    pairs = vocabulary.file_words(docs, "file", vocabulary.plain_words(F.col("text")))
    assert [tuple(r) for r in vocabulary.vocabulary(pairs, 1).collect()] == [("blue", 2)]
    assert vocabulary.removed(pairs, "a").count() == 1
    assert {r.file for r in vocabulary.renamed(pairs, "a", "z").collect()} == {"z", "b"}
    zipf = {r.word: r.zipf for r in vocabulary.zipf_table(docs).collect()}
    assert zipf == {"blue": 8.7, "red": 8.7}
    buckets = spark.createDataFrame([(0, ["the", "of", "x1"]), (1, ["the", "a"])], "bucket int, words array<string>")
    assert {r.word: r.zipf for r in vocabulary.zipf_of_buckets(buckets).collect()} == {"the": 9.0, "of": 9.0, "a": 8.99}


def test_path_rules(spark):
    rows = spark.createDataFrame([("src/a.ts",), ("node_modules/a.ts",), ("a.min.JS",), ("README",), ("vendor",)], "p string")
    got = rows.select("p", S.is_scanned(F.col("p")).alias("s"), S.language_for_path(F.col("p")).alias("l"), S.is_within(F.col("p"), "src").alias("w")).collect()
    assert [(bool(r.s), r.l, r.w) for r in got] == [(True, "typescript", True), (False, "typescript", False), (True, "javascript", False), (False, None, False), (False, None, False)]
    assert S.include_under("a[1]").startswith("a[[]1[]]/**/")


def test_scan_and_dictionaries(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("# hé\n")
    (tmp_path / "dist").mkdir()
    (tmp_path / "dist/b.py").write_text("# no\n")
    assert [(r.language_id, r.text) for r in S.scan(spark, str(tmp_path)).collect()] == [("python", "# hé\n")]
    (tmp_path / "zipf.json").write_text(json.dumps({"the": 7.7}))
    assert [tuple(r) for r in S.load_zipf(spark, str(tmp_path / "zipf.json")).collect()] == [("the", 7.7)]
    (tmp_path / "c.jsonl").write_text('{"id": 1, "label": "odd"}\n')
    with pytest.raises(Exception, match="unknown label odd"):
        S.labeled_comments(spark, str(tmp_path / "c.jsonl")).collect()


def test_settings():
    s = S.Settings.parse({"threshold": 11, "languages": ["go", 3], "weights": {"minZipf": 2, "x": 1}, "ramp_start": 5, "ramp_end": 2, "enabled": False})
    assert (s.threshold, s.languages, s.weights, s.ramp_start, s.enabled) == (0.0, ("go",), {"minZipf": 2.0}, 20, False)


def test_fit_moves_bands_and_evaluates(spark):
    rng = np.random.default_rng(1)
    label = rng.integers(0, 3, 90)
    hardness = np.clip(label[:, None] / 2 + rng.normal(0, 0.2, (90, len(PRIORS))), 0, 1)
    scale = np.ones_like(hardness)
    weights, bands = calibrate.fit(hardness, scale, label, iterations=400)
    assert list(weights) == [p[0] for p in PRIORS] and min(weights.values()) >= 0 and bands["ok"] < bands["hard"]
    assert calibrate.cross_validate(hardness, scale, label, iterations=200) > 0.8
    rows = spark.createDataFrame([("easy", 1.0), ("easy", 3.0), ("hard", 3.0), ("ok", 2.0)], "label string, raw double")
    got = {(r.lower, r.higher): (r.ordered, r.pairs) for r in calibrate.pair_order(rows).collect()}
    assert got == {("easy", "ok"): (1.0, 2), ("ok", "hard"): (1.0, 1), ("easy", "hard"): (1.5, 2)}
    judged = spark.createDataFrame([("easy", "easy"), ("hard", "ok")], "human string, predicted string")
    assert calibrate.agreement(judged).first()[0] == 0.5
    assert {r.human: (r.easy, r.ok, r.hard) for r in calibrate.confusion(judged).collect()} == {"easy": (1, 0, 0), "hard": (0, 1, 0)}


def test_samples_feed_the_fit(spark):
    rows = [(1, "// Adds one.", "kotlin", "line", "easy"), (2, "/** Gets `maxRetries`, which is not set. */", "kotlin", "doc", "hard"), (3, None, "kotlin", "line", "ok")]
    labelled = spark.createDataFrame(rows, "id int, text string, languageId string, kind string, label string")
    zipf = spark.createDataFrame([("adds", 4.0), ("one", 6.0)], "word string, zipf double")
    sampled = calibrate.samples(labelled, zipf)
    got = {r.id: r for r in sampled.collect()}
    assert got[1].text == "Adds one." and got[1].words == 2 and got[1].results.commentLength.value == 2
    assert got[2].identifiers == ["maxRetries"] and got[2].results.negationCount.value == 1 and got[3].words == 0
    hardness, scale, label = calibrate.matrix(sampled.orderBy("id"))
    assert hardness.shape == scale.shape == (3, len(PRIORS)) and list(label) == [0, 2, 1]
    assert ((hardness >= 0) & (hardness <= 1)).all()
    assert calibrate.fit(hardness, scale, label, iterations=5)[1]["ok"] > 0
    assert calibrate.matrix(sampled.where("false"))[0].shape == (0, len(PRIORS))


def test_vocabulary_of_a_workspace(spark, tmp_path):
    pairs = spark.createDataFrame([("src/a.ts", "red"), ("src/b.ts", "blue"), ("lib/a.ts", "old"), ("x.ts", "kept")], "file string, word string")
    assert vocabulary.file_count(pairs).first().files == 4
    of = lambda df: sorted(tuple(r) for r in df.collect())
    assert of(vocabulary.moved(pairs, "src", "lib")) == [("lib/a.ts", "red"), ("lib/b.ts", "blue"), ("x.ts", "kept")]
    assert of(vocabulary.moved(pairs, "src", "dist")) == [("lib/a.ts", "old"), ("x.ts", "kept")]
    assert of(vocabulary.moved(pairs, "x.ts", "x.txt"))[-1] == ("src/b.ts", "blue")
    changes = spark.createDataFrame([("a", 5), ("n2", 3), ("n1", 3), ("n3", 1), ("n3", 9), (None, 0)], "file string, at long")
    tracked = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "file string")
    for most, files in ((2, {"a"}), (3, {"a", "n3"}), (4, {"a", "n1", "n3"}), (9, {"a", "n1", "n2", "n3"})):
        assert {r.file for r in vocabulary.admitted(changes, tracked, "at", most).collect()} == files
    calls = []
    make = lambda: calls.append(1) or pairs
    for _ in range(2):
        assert vocabulary.kept(str(tmp_path / "words"), make, spark).count() == 4
    assert calls == [1]
    assert of(E.evicted(pairs, spark.createDataFrame([("x.ts",), (None,)], "file string"), "file"))[0] == ("lib/a.ts", "old")


def test_events(spark, tmp_path):
    rows = [("f", 1, "upsert", "red blue"), ("f", 2, "upsert", "blue green"), ("g", 1, "upsert", "blue"), ("f", 1, "upsert", "stale"), ("g", 2, "delete", None)]
    df = spark.createDataFrame(rows, "file string, version long, kind string, text string")
    assert {(r.file, r.version) for r in E.latest(df, "file", "version").collect()} == {("f", 2), ("g", 2)}
    for k, row in enumerate(rows):
        spark.createDataFrame([row], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    deltas = E.vocabulary_updates(stream, vocabulary.plain_words(F.col("text")))
    query = deltas.writeStream.format("memory").queryName("deltas").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.word: r.n for r in spark.sql("select word, sum(delta) as n from deltas group by word having sum(delta) <> 0").collect()}
    assert got == {"blue": 1, "green": 1}


def test_entry_lists_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 40
