"""Values that results depend on: license wording, directives, dialects; and files that don't parse."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrade.functions import licenses
from lexigrade.functions.lexicons import WEIGHTS
from lexigrade.operators import calibrate
from lexigrade.operators.extract import comments, comments_of, is_license_line
from lexigrade.operators.normalize import dialect_for

LINES = [
    ("Distributed under the Boost Software License, Version 1.0.", True),
    ("Neither the name of Google Inc. nor the names of its contributors may be used", True),
    ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"', True),
    ("SOFTWARE.", True),
    ("All rights reserved.", True),
    ("the license is GNU", False),
    ("Returns a copy of the software update queue", False),
    ("the permitted users of a queue", False),
    ("this file is licensed oddly", False),
]


@pytest.mark.parametrize(("line", "yes"), LINES)
def test_license_lines(spark, line, yes):
    assert is_license_line(line) is yes
    assert spark.createDataFrame([(line,)], "t string").select(licenses.is_license_line(F.col("t")).alias("x")).first().x is yes


@pytest.mark.parametrize(
    ("language", "line"),
    [
        ("javascript", "// oxlint-disable no-console"),
        ("typescript", "/* webpackChunkName: 'a' */"),
        ("javascript", "/* #__PURE__ */"),
        ("go", "//lint:ignore U1000 kept for later"),
        ("go", "// Code generated by stringer. DO NOT EDIT."),
        ("java", "// language=SQL"),
        ("java", "// NOPMD kept for later"),
        ("cpp", "// fallthrough"),
        ("c", "// LCOV_EXCL_LINE"),
        ("csharp", "// csharpier-ignore"),
        ("ruby", "# warn_indent: true"),
        ("php", "/* @var Foo $x */"),
        ("shellscript", "# vim: set ts=2"),
        ("css", "/* autoprefixer: off */"),
    ],
)
def test_directives_are_no_comments(language, line):
    assert comments(f"x\n{line}\ny", language) == []


def test_directives_that_only_look_like_ones():
    assert len(comments("// exported names are listed here", "go")) == 1
    assert len(comments("# encodings are guessed from the text", "ruby")) == 1


def test_a_python_file_with_an_error_keeps_its_comments(spark):
    text = '"""Explains the module."""\n\ndef run(x):\n    """Runs the thing."""\n    return x +\n\n# Keeps the cache warm\ny = 1\n'
    found = {(c["raw_text"], c["target_symbol"]) for c in comments(text, "python")}
    assert found == {('"""Explains the module."""', None), ('"""Runs the thing."""', "run"), ("# Keeps the cache warm", "y")}
    files = spark.createDataFrame([("a.py", "python", text)], "path string, language_id string, text string")
    assert comments_of(files).count() == 3
    assert comments_of(files, errors=True).where("error like 'SyntaxError%'").count() == 1


def test_inner_docs_belong_to_what_encloses_them():
    text = '//! About the file.\nmod store {\n    //! Keeps rows.\n    pub fn put(s: &str) {\n        /*! Puts one. */\n        let t = "}";\n        //! Still inside.\n    }\n    //! And back.\n}\n'
    assert [c["target_symbol"] for c in comments(text, "rust")] == [None, "store", "put", "put", "store"]


def test_a_target_behind_many_decorators():
    text = "# Runs the job\n" + "@mark(1)\n" * 12 + "def job():\n    pass\n"
    assert comments(text, "python")[0]["target_symbol"] == "job"


def test_dialects(spark):
    rows = [("go", "line", "godoc"), ("python", "doc", "python"), ("python", "line", "plain"), ("csharp", "doc", "xmldoc"), ("fsharp", "doc", "jsdoc"), ("rust", "doc", "markdown"), ("java", "doc", "jsdoc"), ("java", "block", "plain")]
    got = spark.createDataFrame(rows, "l string, k string, d string").select(dialect_for(F.col("l"), F.col("k")).alias("x"), "d").collect()
    assert all(r.x == r.d for r in got)


def test_features_feed_the_fit(spark):
    """Harder texts with harder labels: the fit's bands separate what the features number 0, 1, 2."""
    rows = [(float(k % 3) * 2, ("easy", "ok", "hard")[k % 3]) for k in range(60)]
    df = spark.createDataFrame(rows, "v double, label string")
    results = {m: F.struct((F.lit(float(easy)) + F.col("v") / 4 * F.lit(float(hard - easy))).alias("value")) for m, _, _, easy, hard, _ in WEIGHTS}
    made = [r.f for r in df.select(calibrate.features(results, F.lit(40), F.col("label")).alias("f")).collect()]
    assert {r.label for r in made} == {0, 1, 2}
    hardness, scale, label = (np.array([getattr(r, c) for r in made]) for c in ("difficulty", "scale", "label"))
    _, bands = calibrate.fit(hardness, scale, label, iterations=400)
    assert 0 < bands["ok"] < bands["hard"] < 10
