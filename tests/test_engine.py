"""Stored index, classes, references, resembling names, on small inputs."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators import extract, fuzzy, keyword, lines, references
from lodestone.operators.index import PostingsIndex


def posted(spark, rows):
    return keyword.postings(spark.createDataFrame(rows, "id long, text string"), "id", {"text": 1.0})


def held(df):
    return Counter((r.id, r.token_hash, round(r.weight, 9)) for r in df.collect())


def test_index_keeps_versions_and_reads_only_the_terms_buckets(spark, tmp_path):
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    texts = {i: " ".join(rnd.choices(words, k=8)) for i in range(40)} | {40: "alone", 41: "", 42: None}
    index = PostingsIndex(spark, f"file://{tmp_path}/index", buckets=16)
    assert index.state()["version"] == 0 and index.lookup(posted(spark, [(1, "word1")])).count() == 0
    first = index.write(posted(spark, list(texts.items())), 43)
    assert index.state() == first and first["version"] == 1 and first["total"] == 43
    everything = [(i, w) for i, w in enumerate(words)]
    assert held(index.lookup(posted(spark, everything))) - held(posted(spark, list(texts.items()))) == Counter()
    one = index.lookup(posted(spark, [(0, "word7")]))
    assert len({f.split("bucket=")[1].split("/")[0] for f in one.inputFiles()}) == 1
    changed = {3: "word1 word2 brand new", 40: None, 50: "word5"}
    older = index.lookup(posted(spark, everything))
    second = index.replace(spark.createDataFrame([(i,) for i in changed], "id long"), posted(spark, list(changed.items())), 44)
    now = texts | changed
    assert second["version"] == 2 and second["postings"] == posted(spark, list(now.items())).count()
    assert any(second["buckets"][b] == first["buckets"][b] for b in second["buckets"] if b in first["buckets"])
    every = index._read(second["buckets"])
    assert held(every) == held(posted(spark, list(now.items())))
    assert older.count() > 0  # readers of the first version go on
    assert index.vacuum() > 0 and held(index._read(index.state()["buckets"])) == held(every)
    assert {p.name for p in Path(tmp_path, "index").glob("manifest-*")} == {"manifest-2"}
    emptied = index.replace(spark.createDataFrame([(i,) for i in now], "id long"), posted(spark, []), 0)
    assert emptied["postings"] == 0 and index.state() == emptied


def plain_lines(text, cost, budget, free=0):
    runs, size = [], 0
    for line in text.split("\n"):
        c = cost(line)
        if not runs or size + c - free > budget:
            runs.append([])
            size = 0
        runs[-1].append(line)
        size += c
    return ["\n".join(r) for r in runs]


def test_lines_are_packed(spark):
    rnd = random.Random(2)
    texts = ["\n".join("x" * rnd.randint(0, 90) for _ in range(rnd.randint(1, 60))) for _ in range(40)] + ["", None, "y" * 5000, "\n\n"]
    rows = spark.createDataFrame([(i % 30, t) for i, t in enumerate(texts)], "k long, t string")
    got = Counter((r.k, r.chunk_index, r.content, r.token_count) for r in lines.line_chunks(rows, "k", "t", 40).collect())
    want = Counter()
    for i, t in enumerate(texts):
        want.update((i % 30, k, c, sum(len(x) // 4 for x in c.split("\n"))) for k, c in enumerate(plain_lines(t or "", lambda x: len(x) // 4, 40)))
    assert got == want
    chunks = lines.config_chunks(rows, "k", "t", 200).collect()
    assert Counter((r.k, r.chunk_index, r.content) for r in chunks) == Counter((i % 30, k, c) for i, t in enumerate(texts) for k, c in enumerate([t or ""] if len(t or "") <= 200 else plain_lines(t, lambda x: len(x) + 1, 200, 1)))
    assert all(r.end - r.start in (len(r.content), len(r.content) + 1) for r in chunks)


def test_large_classes_are_split(spark):
    method = "    def m{i}(self):\n        return {i}\n"
    many = "class Many(Base):\n    '''Doc.'''\n    limit = 3\n" + "".join(method.format(i=i) for i in range(21))
    long = "class Long:\n    def one(self):\n" + "".join(f"        x{i} = {i}\n" for i in range(200))
    small = "class Small:\n" + method.format(i=1)
    java = "class J {\n  int size;\n  void go() {\n" + "    run();\n" * 300 + "  }\n}\n"
    files = spark.createDataFrame([("a.py", "python", many), ("b.py", "python", long), ("c.py", "python", small), ("d.java", "java", java), ("e.py", "python", None)], "file_path string, language string, content string")
    rows = extract.objects(extract.split_classes(extract.extract(files))).collect()
    classes = {r.name: r for r in rows if r.object_type == "class"}
    assert {n: r.is_summary for n, r in classes.items()} == {"Many": True, "Long": True, "Small": False, "J": True}
    assert classes["Many"].content.split("\n\n") == ["class Many(Base):", "Doc.", "limit = 3", *[f"def m{i}(self)" for i in range(21)]]
    assert classes["J"].content.split("\n\n") == ["class J", "int size;", "void go()"]
    assert classes["Small"].content == small.rstrip("\n")
    methods = [r for r in rows if r.object_type == "method"]
    assert len(methods) == 24 and not any(r.is_summary for r in methods) and all("return" in r.content or "x1" in r.content or "run" in r.content for r in methods)
    assert {r.parent_id for r in methods} == {r.id for r in classes.values()}


def test_markdown_references(spark):
    text = "See `run` and `go()`.\n```py\nx = 1\ny = 2\n```\nthen [the file](src/a.py), [no](b.txt)\n```\n" + "z" * 300 + "\n```\n"
    rows = spark.createDataFrame([(1, text), (1, None), (2, "")], "k long, t string")
    got = [(r.type, r.name, r.text) for r in references.markdown_references(rows, "k", "t").orderBy("k", "n").collect()]
    assert got[0] == ("inline_code", "run", text[:59]) and got[1][:2] == ("inline_code", "go()")
    assert [x for x in got if x[0] == "code_block"] == [("code_block", "py", "x = 1\ny = 2"), ("code_block", "unknown", "z" * 200)]
    assert got[-1] == ("file_reference", "src/a.py", "the file")
    import time

    began = time.process_time()
    assert not [r for r in references.references_of("```\nab" * 50_000) if r["type"] == "code_block"]
    assert time.process_time() - began < 5


def test_fences_against_the_plain_pattern():
    rnd = random.Random(6)
    for _ in range(300):
        text = "".join(rnd.choice(("```", "\n", "py", "x`y`", "\n```\n", "a b")) for _ in range(30))
        want = [(m[1] or "unknown", m[2][:200]) for m in re.finditer(references.FENCED, text, re.DOTALL)]
        assert [(r["name"], r["text"]) for r in references.references_of(text) if r["type"] == "code_block"] == want


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_similar_names_against_all_pairs(spark, threshold):
    rnd = random.Random(9)
    syllables = ["shop", "cart", "pay", "ment", "api", "-", "core", "x", "Web", "é", "user", "s"]
    names = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 5))) for _ in range(1000)]
    projects = [(f"p{i % 990}", n) for i, n in enumerate(names)] + [(None, "shop"), ("z", None), ("", "")]
    queries = [*rnd.sample(names, 25), "payment", "P12", "zzz", "a", None, ""]
    want = {}
    for q in {x for x in queries if x}:
        for pid, name in projects:
            sides = [x.lower() for x in (name, pid) if x]
            if pid is None or not sides:
                continue
            ratio = max(SequenceMatcher(None, q.lower(), s).ratio() for s in sides)
            if any(q.lower() in s for s in sides):
                ratio = max(ratio, 0.8)
            if ratio >= threshold:
                want[q, pid] = max(ratio, want.get((q, pid), 0))
    df = fuzzy.similar(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame(projects, "project_id string, name string"), threshold)
    got = {(r["query"], r.project_id): r.ratio for r in df.where(F.col("project_id").isNotNull()).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "Cartesian" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_names_with_common_beginnings_are_dealt_to_cells(spark, monkeypatch):
    """No join by what many names share: rows of a cell are bounded."""
    monkeypatch.setattr(fuzzy, "SIDE", 8)
    names = spark.createDataFrame([(f"https://host/{i}",) for i in range(200)], "s string")
    asked = names.limit(20).withColumnRenamed("s", "q")
    plan = fuzzy._rated(asked, names, 0.6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and fuzzy._rated(asked, names, 0.6).rdd.getNumPartitions() == 75


def plain_pairs(queries, names, threshold):
    rated = ((q, s, max(SequenceMatcher(None, q, s).ratio(), 0.8 * (q in s))) for q in queries for s in names)
    return {(q, s): r for q, s, r in rated if r >= threshold}


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_pairs_rated_together_against_one_by_one(threshold, monkeypatch):
    rnd = random.Random(11)
    monkeypatch.setattr(fuzzy, "STEP_BYTES", 20_000)
    pieces = ["https://", "www.", "shop", "aba", "ab", "x", "/", "?page=2", "é", "검색", "\U0001f600", "\0"]
    of = lambda n, most: list({"".join(rnd.choice(pieces) for _ in range(rnd.randint(1, most))) for _ in range(n)})
    wide = [chr(0x4E00 + i) + chr(0x5000 + i) + "ab" for i in range(300)]  # more characters than a byte holds
    queries, names = of(40, 10) + of(8, 40) + ["a" * 450, "b", *wide[:3]], of(120, 10) + of(20, 45) + ["ab" * 110, "a" * 199, "a" * 200, *wide]
    i, j, ratio = fuzzy.rated_pairs(queries, names, threshold)
    assert {(queries[a], names[b]): r for a, b, r in zip(i.tolist(), j.tolist(), ratio.tolist(), strict=True)} == plain_pairs(queries, names, threshold)
    assert [len(x) for x in fuzzy.rated_pairs(["zz"], ["ab", "c"], threshold)] == [0, 0, 0]


def test_many_pairs_take_little_time():
    import time

    rnd = random.Random(12)
    urls = [f"https://{rnd.choice(('www', 'm', 'blog'))}.th{rnd.randint(1, 99)}.example.{rnd.choice(('org', 'net'))}/en/{rnd.randint(1, 9999)}?page=2&ref=x" for _ in range(600)]
    began = time.process_time()
    assert len(fuzzy.rated_pairs(urls[:300], urls[300:], 0.6)[0]) > 50_000
    assert time.process_time() - began < 4


def test_projects_of_several_names_have_one_row(spark):
    projects = [("p", "shop cart"), ("p", "shop card"), ("p", None), (None, "shop"), (None, "shop cart"), ("shop cart", "other"), ("z", ""), ("q", "Shop Cart")]
    df = fuzzy.similar(spark.createDataFrame([("Shop Cart",), ("shop cart",)], "query string"), spark.createDataFrame(projects, "project_id string, name string"))
    assert sorted((r["query"], r.project_id or "", r.ratio) for r in df.collect()) == [(q, p, 1.0) for q in ("Shop Cart", "shop cart") for p in ("", "p", "q", "shop cart")]
