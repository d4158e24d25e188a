"""Language of prose, dependencies, layers of settings, parse quality."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import config, parse_quality, prose

SF = "/root/testdata/sf0.01"


def test_languages_of_documents_left_out_of_the_profiles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = prose.profiles(docs.where("doc_id % 2 = 0"), "text", "lang", ("de", "en", "es", "fr"))
    found = prose.languages_of(docs.where("doc_id % 2 = 1"), "doc_id", "text", known, ("de", "en", "es", "fr")).join(docs.select("doc_id", "lang"), "doc_id")
    met, n = found.select(F.count_if(F.col("lang") == F.col("language")), F.count("*")).first()
    assert met / n >= 0.95


def test_language_cases(spark):
    learnt = spark.createDataFrame([("aa bb", "de"), ("cc dd", "fr"), ("aa", None), ("xx", "zz"), (None, "de")], "t string, l string")
    known = prose.profiles(learnt, "t", "l", ("de", "fr"), 3)
    assert known.groupBy("language").agg(F.max("weight"), F.count("*")).sort("language").collect() == [("de", 3, 3), ("fr", 3, 3)]
    texts = [(1, "AA, aa!"), (1, "cc"), (None, None), (2, ""), (3, "12 ?"), (4, "zz"), (None, "dd"), (5, "aa " * 200_000)]
    rows = spark.createDataFrame(texts, "k int, t string").withColumns({"gram": F.lit(1), "language": F.lit("no"), "weight": F.lit("x"), "row__": F.lit(7)})
    got = sorted(((r.k, r.language, r.score > 0) for r in prose.languages_of(rows, "k", "t", known, ("de", "fr")).collect()), key=str)
    assert got == sorted([(1, "de", True), (1, "fr", True), (None, "en", False), (2, "en", False), (3, "en", False), (4, "en", False), (None, "fr", True), (5, "de", True)], key=str)
    assert prose.languages_of(rows.where("false"), "k", "t", known, ("de", "fr")).count() == 0
    assert {r.language for r in prose.languages_of(rows, "k", "t", known.where("false"), ("de", "fr")).collect()} == {"en"}


def test_equal_scores_go_to_the_first_language(spark):
    known = spark.createDataFrame([("fr", "_a_", 2), ("de", "_a_", 2)], "language string, gram string, weight long")
    assert prose.languages_of(spark.createDataFrame([(1, "a")], "k int, t string"), "k", "t", known, ("de", "fr")).first() == (1, "de", 2)


def test_dependencies(spark):
    pytest.importorskip("yaml")
    files = [
        (1, '{"dependencies": {"a": "^1", "b": {"version": 2}, "c": null, "d": 3}, "devDependencies": ["x"], "peerDependencies": {"p": "*"}}'),
        (1, ' \n {"devDependencies": {"é": ""}}'),
        (2, "dependencies:\n- a\n- name: b\n  version: 1.5\n- {}\n- 7\nrequires: [x, {name: null}]\npackages: {p: 1}\n"),
        (3, "[1, 2]"), (4, "{broken"), (5, ""), (6, None), (None, "packages: [z]"), (7, "a: [unclosed"), (8, "just text"), (9, '{"dependencies": {"a": 1, "a": 2}}'), (10, "requires: [" + "y," * 20_000 + "y]"),
    ]
    rows = spark.createDataFrame(files, "k int, t string").withColumns({"name": F.lit("n"), "d": F.lit(1)})
    got = config.dependencies(rows, "k", "t").collect()
    assert sum(r.k == 10 for r in got) == 20_001
    assert {tuple(r) for r in got if r.k != 10} == {
        (1, "a", "^1", "dependencies"), (1, "b", '{"version":2}', "dependencies"), (1, "c", "null", "dependencies"), (1, "d", "3", "dependencies"), (1, "p", "*", "peerDependencies"), (1, "é", "", "devDependencies"),
        (2, "a", "unspecified", "dependencies"), (2, "b", "1.5", "dependencies"), (2, "unknown", "unspecified", "dependencies"), (2, "x", "unspecified", "requires"), (2, None, "unspecified", "requires"), (None, "z", "unspecified", "packages"),
    }
    assert config.dependencies(rows.where("false"), "k", "t").count() == 0


def test_deep_merge(spark):
    cases = [
        (['{"a": {"b": 1, "c": 2}, "x": 1}', '{"a": {"c": {"d": 3}}, "x": {"y": 2}}'], {"a": {"b": 1, "c": {"d": 3}}, "x": {"y": 2}}),
        (['{"a": {"b": 1}}', '{"a": null}', None], {"a": None}),
        (['{"a": [1, 2]}', '{"a": [3]}', '{"é": "ü"}'], {"a": [3], "é": "ü"}),
        ([], {}), (None, None), (["[1]"], None), (["{"], None), (['{"a":' * 100_000], None),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, l array<string>")
    got = {r.i: r.j and json.loads(r.j) for r in rows.select("i", config.deep_merge("l").alias("j")).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


def test_python_nodes_after_errors():
    assert parse_quality.python_nodes("import os\n\ndef f(x):\n    return x\n") == (0, 8)
    assert parse_quality.python_nodes("import os\n\ndef f(x):\n    y = = 1\n    return x\n") == (1, 9)  # the line is lost, nothing else
    assert parse_quality.python_nodes('"""\nwords on\nlines\n"""\nimport os\n)\n') == (1, 5)  # a long string is one statement
    assert parse_quality.python_nodes("try:\n    a = 1\nexcept:\n    b = (\n") == (1, 7)
    assert parse_quality.python_nodes("no code here\nat all, is it?\n") == (2, 2)
    assert parse_quality.python_nodes("") == (0, 0) == parse_quality.braced_nodes("")


def test_braced_nodes_after_errors():
    assert parse_quality.braced_nodes("f(a, [b]); // c )\n/* } */") == (0, 9)
    assert parse_quality.braced_nodes("f { return (1; }") == (1, 6)  # the parenthesis stands open within the braces
    assert parse_quality.braced_nodes("}}} ((( 'x") == (7, 7)
    assert parse_quality.braced_nodes('val s = """a\nb"""; f("x\\"y", `t\n`)') == (0, 10)


@pytest.mark.parametrize("text", ["/*a" * 300_000, "`" + "\\`" * 300_000, "({[" * 200_000 + "}" * 100_000, '"""a' * 200_000, "'" * 500_000])
def test_braced_nodes_are_counted_in_one_scan(text):
    began = time.time()
    errors, total = parse_quality.braced_nodes(text)
    assert 0 <= errors <= total and time.time() - began < 10


def test_parse_gate(spark):
    files = [(1, "python", "x = = 1\ny = 2\n"), (1, "python", "x = = 1\n"), (2, "java", "class A { }"), (3, "kotlin", "((("), (4, "cobol", "((("), (5, "python", None), (None, None, "x"), (6, "typescript", "")]
    rows = spark.createDataFrame(files, "k int, language string, content string").withColumn("error_nodes", F.lit("old"))
    measured = parse_quality.parse_metrics(rows)
    got = sorted(((r.k, r.error_nodes, r.total_nodes, r.has_errors, r.valid_ratio) for r in measured.collect()), key=str)
    assert got == sorted([(1, 1, 5, True, 0.8), (1, 1, 1, True, 0.0), (2, 0, 3, False, 1.0), (3, 3, 3, True, 0.0), (4, None, None, None, None), (5, 0, 0, False, 1.0), (None, None, None, None, None), (6, 0, 0, False, 1.0)], key=str)
    assert sorted(str(r.k) for r in parse_quality.readable(measured).collect()) == ["1", "2", "4", "5", "6", "None"]
    assert parse_quality.parse_metrics(rows.where("false")).count() == 0
