"""All queries of the reading-difficulty engine, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexigrade.functions import licenses
from lexigrade.functions.identifiers import split_identifier
from lexigrade.functions.redundancy import content_words, redundancy
from lexigrade.functions.text import READABILITY, js_round, let, readability_weight, sentences, text_stats, words
from lexigrade.functions.tokens import tokens
from lexigrade.operators import calibrate, metrics, report, runs, vocabulary
from lexigrade.operators.extract import comments_of, html_comments
from lexigrade.operators.score import PRIORS, readability_score, scored
from lexigrade.plans.oracles import ORACLE_SQL  # noqa: F401
from lexigrade.sources.files import is_scanned, is_within, language_for_path
from lexigrade.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents; a table of fewer files than cores is spread, as text work is bound by CPU."""
    docs, cores = _table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if len(docs.inputFiles()) < cores else docs


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", "lang", text_stats(F.col("text")).alias("s"))


def _readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite of the four readability metrics of each document of three words or more."""
    df = _documents(spark, sf_dir).select("doc_id", "lang", readability_score(F.col("text")).alias("r")).where("r.words >= 3")
    return df.select("doc_id", "lang", "r.words", "r.score")


@_query
def sentence_split(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(sentences(F.col("text"))).alias("place", "sentence")).select("doc_id", F.col("place").cast("long").alias("place"), F.md5(F.col("sentence").cast("binary")).alias("sentence_md5"))


@_query
def word_match(spark, sf_dir):
    found = words(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n_words"), F.md5(F.array_join(found, " ").cast("binary")).alias("words_md5"))


@_query
def text_statistics(spark, sf_dir):
    return _stats(spark, sf_dir).select("doc_id", "s.*")


@_query
def readability_metrics(spark, sf_dir):
    values = let(text_stats(F.col("text")), lambda s: F.struct(*(metric(s).value.alias(name) for name, metric in READABILITY.items())))
    return _documents(spark, sf_dir).select("doc_id", values.alias("m")).select("doc_id", "m.*")


@_query
def readability_ramp(spark, sf_dir):
    return _stats(spark, sf_dir).groupBy(readability_weight(F.col("s.words")).alias("weight")).agg(F.count("*").alias("n"))


@_query
def composite_readability(spark, sf_dir):
    return _readable(spark, sf_dir).select("doc_id", "words", "score.score", "score.label", "score.readability", F.array_join("score.reasons", "; ").alias("reasons"))


@_query
def label_distribution(spark, sf_dir):
    return report.label_distribution(_readable(spark, sf_dir))


@_query
def language_report(spark, sf_dir):
    df = _readable(spark, sf_dir)
    return df.groupBy("lang").agg(F.count("*").alias("texts"), F.sum("words").alias("words"), F.sum((F.col("score.label") == "hard").cast("long")).alias("hard"))


@_query
def top_complex(spark, sf_dir):
    return _readable(spark, sf_dir).orderBy(F.desc("score.score"), "doc_id").limit(10).select("doc_id", F.col("score.score").alias("score"))


@_query
def above_threshold(spark, sf_dir):
    return report.above(_readable(spark, sf_dir), 5.0).select("doc_id", F.col("score.score").alias("score"))


@_query
def lens_title(spark, sf_dir):
    return _readable(spark, sf_dir).select("doc_id", report.lens_title(F.col("score")).alias("title"))


@_query
def diagnostic_message(spark, sf_dir):
    return _readable(spark, sf_dir).select("doc_id", report.diagnostic_message(F.col("score")).alias("message"))


@_query
def min_words_filter(spark, sf_dir):
    every = _documents(spark, sf_dir).select(F.lit("documents").alias("kind"), "text").union(_table(spark, sf_dir, "conversations").select(F.lit("conversations"), "text"))
    return every.groupBy("kind").agg(F.count("*").alias("texts"), F.sum((F.size(words(F.coalesce("text", F.lit("")))) >= 3).cast("long")).alias("long_enough"))


def _metric_query(name: str) -> None:
    metric = metrics.METRICS[name]

    def run(spark, sf_dir):
        return _documents(spark, sf_dir).select("doc_id", let(tokens(F.col("text")), lambda t: metric(t, metrics.Context())).alias("m")).select("doc_id", "m.value", F.md5(F.coalesce("m.reason", F.lit("")).cast("binary")).alias("reason_md5"))

    QUERIES[f"metric_{name}"] = run


for _name in ("nounStack", "clauseCount", "lexicalDensity", "negationCount", "danglingReference", "commentLength", "undefinedAcronyms"):
    _metric_query(_name)


@_query
def zipf_table(spark, sf_dir):
    return vocabulary.zipf_table(_documents(spark, sf_dir))


@_query
def zipf_metrics(spark, sf_dir):
    """Mean and least frequency of every document's words outside the 100 most used ones."""
    docs = _documents(spark, sf_dir)
    known = vocabulary.vocabulary(vocabulary.file_words(docs, "doc_id", vocabulary.plain_words(F.col("text"))), 100)
    rated = vocabulary.rated_words(docs, "doc_id", known, vocabulary.zipf_table(docs))
    return rated.groupBy("doc_id").agg(F.count("*").alias("rated"), js_round(F.sum(F.round(F.col("zipf") * 100).cast("long")) / F.count("*") / 100, 2).alias("mean_zipf"), F.least(F.lit(7.0), F.min("zipf")).alias("min_zipf"))


@_query
def vocabulary_topk(spark, sf_dir):
    return vocabulary.vocabulary(vocabulary.file_words(_documents(spark, sf_dir), "doc_id", vocabulary.plain_words(F.col("text"))))


@_query
def vocabulary_by_source(spark, sf_dir):
    """Words by the number of sources that use them, at least two."""
    docs = _documents(spark, sf_dir)
    pairs = vocabulary.file_words(docs, "source", vocabulary.plain_words(F.col("text"))).distinct()
    return vocabulary.file_counts(pairs).where("files > 1")


@_query
def vocabulary_files(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return vocabulary.file_count(vocabulary.file_words(docs, "source", vocabulary.plain_words(F.col("text"))))


@_query
def admitted_changes(spark, sf_dir):
    """Events of users that are customers, and of the first other users as far as the file limit goes."""
    changes = _table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), "event_id")
    return vocabulary.admitted(changes, _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file")), "event_id").select("event_id", F.col("file").alias("user_id"))


@_query
def evicted_results(spark, sf_dir):
    """Documents whose results stay when those with a label are closed."""
    docs = _documents(spark, sf_dir).select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("length"))
    return streams.evicted(docs, _table(spark, sf_dir, "labels"), "doc_id")


@_query
def hover_lookup(spark, sf_dir):
    """The comments under a grid of positions, one for every 25 columns of each row of a page."""
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("language_id"), F.col("html").alias("text"))
    rows = pages.select("path", F.posexplode(F.split("text", "\n", -1)).alias("row", "line"))
    rows = rows.select("path", "row", F.explode(F.sequence(F.lit(0), F.length("line"), F.lit(25))).alias("column"))
    return report.at(comments_of(pages), rows).select(F.col("path").cast("long").alias("page_id"), "row", "column", "raw_text")


@_query
def calibration_samples(spark, sf_dir):
    """Difficulties and scales of labelled documents under the corpus' own word frequencies."""
    docs, marks = _documents(spark, sf_dir), _table(spark, sf_dir, "labels")
    label = F.when(F.col("quality") == 1, F.lit("easy")).otherwise(F.lit("hard"))
    labelled = docs.join(marks.select("doc_id", label.alias("label")), "doc_id").select("doc_id", "text", F.lit("").alias("languageId"), F.lit("line").alias("kind"), "label")
    sampled = calibrate.samples(labelled, vocabulary.zipf_table(docs))
    return sampled.select("doc_id", "words", calibrate.features({m: F.col(f"results.{m}") for m, *_ in PRIORS}, F.col("words"), F.col("label")).alias("f")).select("doc_id", "words", "f.*")


@_query
def content_word_stems(spark, sf_dir):
    found = content_words(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, " ").cast("binary")).alias("stems_md5"))


@_query
def redundancy_of_names(spark, sf_dir):
    """How much of a part's type its name says."""
    r = redundancy(F.col("p_type"), F.regexp_replace("p_name", " ", "_"))
    return _table(spark, sf_dir, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.redundant", "r.overlap")


@_query
def split_identifiers(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return _table(spark, sf_dir, "pages").select("page_id", split_identifier(F.regexp_replace(path, r"[^A-Za-z0-9_.]", "_")).alias("words"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(lines).alias("row", "body"))


@_query
def license_lines(spark, sf_dir):
    flagged = _lines(spark, sf_dir).where(licenses.is_license_line(F.col("body")))
    return flagged.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.min("row").cast("long").alias("first_row"))


@_query
def license_texts(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    df = _documents(spark, sf_dir).select("doc_id", licenses.is_license_text(text).alias("strict"), licenses.has_license_word(text).alias("weak"))
    return df.where("strict or weak")


@_query
def structured_blocks(spark, sf_dir):
    props = F.replace(F.replace(F.col("props"), F.lit(","), F.lit(",\n")), F.lit("{"), F.lit("{\n"))
    return _table(spark, sf_dir, "events").select("event_id", licenses.is_structured(props).alias("structured")).groupBy("structured").agg(F.count("*").alias("n"))


@_query
def line_run_lengths(spark, sf_dir):
    """Runs of license lines and of other lines, as line comments with two openers."""
    lines = _lines(spark, sf_dir).where("body <> ''").withColumn("opener", F.when(licenses.is_license_line(F.col("body")), F.lit("©")).otherwise(F.lit("//")))
    comments = lines.select(F.col("doc_id").alias("path"), F.col("row").alias("start_row"), F.col("row").alias("end_row"), "opener", F.lit(False).alias("block"), F.lit(False).alias("trailing"), "body")
    return runs.line_runs(comments).groupBy("path", "run").agg(F.min("start_row").cast("long").alias("first_row"), F.count("*").alias("n"))


@_query
def license_cut(spark, sf_dir):
    """Lines that are left of each document when license parts are cut out."""
    cut = runs.without_license(_lines(spark, sf_dir), ["doc_id"], "row")
    return cut.groupBy("doc_id").agg(F.count("*").alias("n_left"), F.sum(F.col("row").cast("long")).alias("rows_sum"))


@_query
def page_comments(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", F.posexplode(html_comments(F.col("html"))).alias("place", "body")).where("body <> ''").select("page_id", F.col("place").cast("long").alias("place"), "body")


@_query
def scanned_page_comments(spark, sf_dir):
    """The lexical scanner on the same pages: rows, columns, kind and text of each comment."""
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("language_id"), F.col("html").alias("text"))
    return comments_of(pages).select(F.col("path").cast("long").alias("page_id"), "kind", "raw_text")


@_query
def path_filters(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    host = F.regexp_extract(path, "^([^/]*)", 1)
    return _table(spark, sf_dir, "pages").select("page_id", is_within(path, "example.com").alias("within"), F.coalesce(language_for_path(path), F.lit("")).alias("language"), F.coalesce(is_scanned(path), F.lit(False)).alias("scanned"), host.alias("host"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.lit("easy")).otherwise(F.lit("hard")).alias("human"))
    return _readable(spark, sf_dir).join(marks, "doc_id").select("doc_id", "human", F.col("score.label").alias("predicted"), F.col("score.raw").alias("raw"))


@_query
def confusion(spark, sf_dir):
    return calibrate.confusion(_judged(spark, sf_dir))


@_query
def agreement(spark, sf_dir):
    return calibrate.agreement(_judged(spark, sf_dir))


@_query
def pair_order(spark, sf_dir):
    return calibrate.pair_order(_judged(spark, sf_dir).select(F.col("human").alias("label"), js_round(F.col("raw"), 6).alias("raw")))


@_query
def fold_split(spark, sf_dir):
    return calibrate.folds(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@_query
def dedupe_score_join(spark, sf_dir):
    """Statistics of distinct texts, computed once each and joined back."""
    docs = _documents(spark, sf_dir).select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"), "text")
    once = docs.groupBy("key").agg(F.any_value("text").alias("text")).select("key", text_stats(F.col("text")).alias("s"))
    return docs.select("doc_id", "key").join(once, "key").select("doc_id", "s.words", "s.sentences")


@_query
def latest_version(spark, sf_dir):
    return streams.latest(_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@_query
def debounce(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return streams.debounced(events, "user_id", "ts", "event_id", 3_600_000).select("event_id", "user_id")


@_query
def full_score(spark, sf_dir):
    """All 13 metrics with the corpus' own word frequencies and its 100 most used words as vocabulary, for every document."""
    docs = _documents(spark, sf_dir)
    known = vocabulary.vocabulary(vocabulary.file_words(docs, "doc_id", vocabulary.plain_words(F.col("text"))), 100)
    df = scored(docs.select("doc_id", "text"), lexicon=vocabulary.lexicon(vocabulary.zipf_table(docs), known))
    return df.select("doc_id", "words", "score.score", "score.label", F.array_join("score.reasons", "; ").alias("reasons"), report.lens_title(F.col("score")).alias("title"), F.md5(report.hover_markdown(F.col("score"), F.col("words")).cast("binary")).alias("hover_md5"))


@_query
def conversation_turn_scores(spark, sf_dir):
    """Mean readability score of a role's messages."""
    df = _table(spark, sf_dir, "conversations").select("role", readability_score(F.col("text")).alias("r")).where("r.words >= 3").select("role", "r.score")
    return df.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.round(F.col("score.score") * 10).cast("long")).alias("tenths"))


@_query
def sentence_rank(spark, sf_dir):
    """The three documents of each language with most sentences."""
    top = Window.partitionBy("lang").orderBy(F.desc("sentences"), "doc_id")
    return _stats(spark, sf_dir).select("doc_id", "lang", F.col("s.sentences").alias("sentences")).withColumn("place", F.row_number().over(top)).where("place <= 3")
