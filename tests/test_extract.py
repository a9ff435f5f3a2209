from pyspark.sql import functions as F

from lexigrade.operators.extract import comments, comments_of, html_comments
from lexigrade.operators.normalize import normalize
from lexigrade.operators.runs import line_runs, without_license
from lexigrade.plans.corpus import scored_comments


def found(language, *lines):
    return [(c["kind"], c["raw_text"]) for c in comments("\n".join(lines), language)]


def test_scanner_groups_and_skips_strings():
    assert found("kotlin", 'val a = "// no"', "// one", "// two", "", "// three") == [("line", "// one\n// two"), ("line", "// three")]
    assert found("kotlin", "/* a /* nested */ b */ val x = 1 // tail") == [("block", "/* a /* nested */ b */"), ("line", "// tail")]
    assert found("sql", "select 'it''s -- no' -- yes") == [("line", "-- yes")]
    assert found("yaml", "a: b#c # real") == [("line", "# real")]
    assert found("lua", "--[[ block", "more ]]", "--- doc") == [("block", "--[[ block\nmore ]]"), ("doc", "--- doc")]
    assert found("css", "/* open") == [("block", "/* open")]


def test_directives_licenses_and_code_go():
    assert found("kotlin", "// Copyright (c) 2020 X", "// Licensed under the Apache License", "", "// kept words") == [("line", "// kept words")]
    assert found("python", "#!/usr/bin/env python", "x = 1  # noqa", "# x = compute(1)", "# Explains the value") == [("line", "# x = compute(1)\n# Explains the value")]
    assert found("python", "# y = compute(1)") == []


def test_docstrings_and_targets():
    rows = comments('def load(x):\n    """Load the thing."""\n    return x\n\n# Holds state\nclass Box:\n    pass\n', "python")
    assert [(r["kind"], r["target_symbol"]) for r in rows] == [("doc", "load"), ("line", "Box")]
    assert comments("/** Adds. */\nexport function addAll(a) {}\n", "typescript")[0]["target_symbol"] == "addAll"


def test_targets_behind_many_decorators():
    marks = "".join(f"@mark{k}\n" for k in range(12))
    assert comments(f"# Holds state\n{marks}class Box:\n    pass\n", "python")[0]["target_symbol"] == "Box"
    assert comments(f"# Holds state\n{marks}\nclass Box:\n    pass\n", "python")[0]["target_symbol"] is None


def test_failures_are_rows(spark):
    files = spark.createDataFrame([("a.py", "python", "def f(:"), ("b.py", "python", "# fine words here"), ("c.py", "python", None)], "path string, language_id string, text string")
    got = {r.path: r.error for r in comments_of(files, errors=True).collect()}
    assert got["b.py"] is None and got["a.py"].startswith("SyntaxError")


def test_html_comments(spark):
    row = spark.createDataFrame([("<p><!-- a --><!--b",)], "h string").select(html_comments(F.col("h")).alias("c")).first()
    assert row.c == ["a", "b"]


def test_normalize():
    assert normalize("/** Gets the {@link UserName} of `maxRetries`. */", "jsdoc") == ("Gets the user name of max retries.", ["UserName", "maxRetries"])
    assert normalize("/**\n * Adds.\n * @param {number} count how many\n * @internal x\n */", "jsdoc") == ("Adds.\nhow many", ["count"])
    assert normalize('"""Reads.\n\n    Args:\n        path: where it is\n    """', "python") == ("Reads.\nwhere it is", ["path"])
    assert normalize("// see https://example.com/x for more", "plain") == ("see for more", [])
    assert normalize("// ```\n// code\n// ```\n// after", "plain") == ("after", [])
    assert normalize("// - one\n// - two", "plain") == ("one\ntwo", [])
    assert normalize("// ------ Helpers ------", "plain")[0] == "Helpers"


def test_runs_by_windows(spark):
    rows = [("f", 0, 0, "//", False, False, "a"), ("f", 1, 1, "//", False, False, "b"), ("f", 2, 2, "///", False, False, "c"), ("f", 5, 5, "///", False, False, "d")]
    df = spark.createDataFrame(rows, "path string, start_row int, end_row int, opener string, block boolean, trailing boolean, body string")
    assert [r.run for r in line_runs(df).orderBy("start_row").collect()] == [1, 1, 2, 3]
    cut = spark.createDataFrame([(1, 0, "Copyright (c) 2020 X"), (1, 1, "Licensed under the Apache License"), (1, 2, "prose stays here now")], "k int, row int, body string")
    assert [r.row for r in without_license(cut, ["k"], "row").collect()] == [2]


def test_corpus(spark):
    files = spark.createDataFrame([("a.kt", "kotlin", "// The cache is not flushed unless the XQZ flag is set.\nval x = 1"), ("b.kt", "kotlin", "// The cache is not flushed unless the XQZ flag is set.\nval y = 1")], "path string, language_id string, text string")
    got = scored_comments(files).select("path", "score.score", "score.reasons").orderBy("path").collect()
    assert len(got) == 2 and got[0].score == got[1].score > 0 and got[0].reasons


def test_python_sections():
    numpy = '"""Do it.\n\nParameters\n----------\nx, *rest : int\n    The count.\ny : str, optional\n    A name.\n\nReturns\n-------\nlist[int]\n    The total.\n\nRaises\n------\nValueError\n    When empty.\n\nExamples\n--------\n>>> go()\n\nNot read.\n"""'
    assert normalize(numpy, "python") == ("Do it.\nThe count.\nA name.\nThe total.\nWhen empty.", ["x", "rest", "y", "ValueError"])
    sphinx = '"""Go.\n\n:param str name: Who goes.\n:type name: str\n    or bytes\n:returns: Where to.\n"""'
    assert normalize(sphinx, "python") == ("Go.\nWho goes.\nWhere to.", ["name"])
    google = '"""Go.\n\nReturns:\n    bool: Whether it went.\n\nNote:\n    Slow.\n"""'
    assert normalize(google, "python") == ("Go.\nWhether it went.\nSlow.", [])


def test_link_definitions_over_lines():
    def prose(*lines):
        return normalize("\n".join(f"// {s}".rstrip() for s in lines), "plain")[0]

    assert prose("before", "[a]: http://x.y", "after") == "before\nafter"
    assert prose("[a]: http://x.y", '"Long', 'title"', "after") == "after"
    assert prose("[a]:", "http://x.y", "(a title)", "after") == "after"
    assert prose("[a]: http://x.y 'open", "", "after all") == "after all"
    assert prose("[a]:", "two words") == "two words"
    assert prose("[a]: http://x.y", "[b]: http://x.z", "'t'", "'quoted' words") == "'quoted' words"


def test_columns_of_comments_and_the_lookup(spark):
    from lexigrade.operators.report import at

    got = comments('é = 1  # tail\ndef f():\n    """Says\n    more."""\n', "python")
    assert [(c["start_row"], c["start_column"], c["end_row"], c["end_column"]) for c in got] == [(0, 7, 0, 13), (2, 4, 3, 12)]
    broken = comments('def f():\n    """Says."""\n    x = = 1\n', "python")
    assert [(c["start_column"], c["end_column"]) for c in broken] == [(4, 15)]
    text = "/* one */ a // two\n/* three\nlines */ b\n"
    rows = comments_of(spark.createDataFrame([("f", "kotlin", text), ("g", "kotlin", "// x")], "path string, language_id string, text string"))
    places = [("f", r, c) for r in range(4) for c in range(20)] + [("f", None, 1), (None, 0, 0), ("h", 0, 0)]
    held = {(p.row, p.column): p.raw_text for p in at(rows, spark.createDataFrame(places, "path string, row int, column int")).collect()}
    want = {(0, c): "/* one */" for c in range(10)} | {(0, c): "// two" for c in range(12, 19)} | {(1, c): "/* three\nlines */" for c in range(20)} | {(2, c): "/* three\nlines */" for c in range(9)}
    assert held == want


def test_settings_reach_the_score(spark):
    from lexigrade.sources.files import Settings

    files = spark.createDataFrame([("a.kt", "kotlin", "// The ZQX flag is not read unless it is set, because it never works.\nval a = 1\n"), ("b.lua", "lua", "-- Nothing of this is read here at all.")], "path string, language_id string, text string")
    plain = scored_comments(files).collect()
    assert {r.path for r in plain} == {"a.kt", "b.lua"}
    settings = Settings.parse({"languages": ["kotlin"], "acronyms": [" zqx ", "no-word"], "weights": {"negationCount": 0}})
    assert settings.acronyms == ("zqx",)
    (told,) = scored_comments(files, settings=settings).collect()
    of = lambda row: {c.metric: c for c in row.score.contributions}
    before = of(next(r for r in plain if r.path == "a.kt"))
    assert before["undefinedAcronyms"].value == 1 and of(told)["undefinedAcronyms"].value == 0
    assert before["negationCount"].points > 0 and of(told)["negationCount"].points == 0
    assert scored_comments(files, settings=Settings.parse({"show_only_above": True, "threshold": 10})).count() == 0
