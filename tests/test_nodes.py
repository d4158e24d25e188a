"""Nodes of documents against plain folds, and rows that come back as they were."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import nodes

FILES = "file_path string, relative_path string, content string, config_format string, title string"


def markdown(spark, *texts):
    rows = [(f"/r/{i}.md", f"{i}.md", t, None, "clash") for i, t in enumerate(texts)]
    found = nodes.markdown_nodes(spark.createDataFrame(rows, FILES), F.to_timestamp(F.lit("2024-01-02 03:04:05.25")))
    return sorted(found.collect(), key=lambda r: (r.file_path, r.chunk_index))


def test_titles_lines_and_code(spark):
    text = "Intro `Engine`\n# One\nsee src/a.py\n## Two\nb\n### Three\nc\n#### Four"
    a, b, c, d = markdown(spark, text)
    assert [x.title for x in (a, b, c, d)] == ["One", "One", "Two", "One"]
    assert [(x.start_line, x.end_line) for x in (a, b, c, d)] == [(1, 1), (2, 3), (4, 5), (6, 8)]
    assert [[(y.name, y.type) for y in x.related_code or []] for x in (a, b, c)] == [[("Engine", "class")], [("src/a.py", "file")], []]
    assert {x.total_chunks for x in (a, b, c, d)} == {4} and a.parent_doc_id == "/r/0.md"


def test_texts_without_nodes_and_long_texts(spark):
    assert not markdown(spark, None, "", " \n ")
    long = "\n".join(f"## T{i}\n" + "word " * (i % 300) for i in range(3000))
    found = markdown(spark, long, long)
    assert len(found) == 2 * found[0].total_chunks
    lines = long.split("\n")
    for x in found[:: len(found) // 50]:
        assert x.content in "\n".join(lines[x.start_line - 1 : x.end_line])
        assert x.content not in "\n".join(lines[: x.end_line - 1]) or "\n" not in x.content


@pytest.mark.parametrize("text", ["", "a\nb\na\nb", "x", "\n\n\n"])
def test_places_are_the_first(text):
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            at = text.index(text[i:j])
            first = text[:at].count("\n") + 1
            assert list(nodes.places(text, [text[i:j]])) == [(first, first + text[i:j].count("\n"))]
    assert list(nodes.places(text, ["none", ""])) == [(1, 1), (1, 1)]


def test_config_nodes(spark):
    large = "{" + ", ".join(f'"key{i}": "{"v" * 90}${{NAME_{i}}}"' for i in range(12)) + "}"
    rows = [("/c/a.json", "a.json", f'{{"small": 1, "large": {large}, "last": {{"x": {{"y": 2}}}}}}', "json", None), ("/c/b.yaml", "b.yaml", "a: [", "yaml", None), (None, None, None, None, None)]
    found = sorted(nodes.config_nodes(spark.createDataFrame(rows, FILES)).collect(), key=lambda r: r.chunk_index)
    assert {r.file_path for r in found} == {"/c/a.json"} and {r.config_format for r in found} == {"json"}
    assert " + ".join(r.title for r in found) == "small + large + last"
    assert {k for r in found for k in r.config_keys} >= {"small", "large.key3", "last.x.y"}
    assert {k for r in found for k in r.env_references} == {f"NAME_{i}" for i in range(12)}


def test_rows_come_back(spark):
    rows = [("/r/a.md", "a.md", "# A `Code` b\nc", None, None), ("/r/b.md", "b.md", "plain", None, None)]
    made = nodes.markdown_nodes(spark.createDataFrame(rows, FILES), F.to_timestamp(F.lit("2024-01-02 03:04:05.25")))
    stored = nodes.document_payload(made)
    assert len(stored.columns) == 27 and [r.title for r in stored.orderBy("name").collect()] == ["A `Code` b", ""]
    back = nodes.document_nodes(stored)
    assert set(back.columns) == set(made.columns)
    lists = ("related_code", "config_keys", "env_references", "metadata")
    plain = [c for c in made.columns if c not in lists]
    assert back.select(plain).orderBy("file_path").collect() == made.select(plain).orderBy("file_path").collect()
    assert [len(r.related_code) for r in back.orderBy("file_path").collect()] == [1, 0]
    assert nodes.document_payload(back).orderBy("name").collect() == stored.orderBy("name").collect()


def test_shown_documents(spark):
    columns = "file_path string, relative_path string, title string, node_type string, chunk_index int, total_chunks int, start_line int, end_line int, related_code string, config_keys string, env_references string, section_depth string, config_format string"
    rows = [("/a/b.md", "../b.md", "", "markdown", None, None, None, None, "no json", None, None, None, None), ("", None, None, "config", 1, 2, 3, 4, None, '["k"]', "", None, None), (None,) * 13]
    a, b, c = nodes.shown_documents(spark.createDataFrame(rows, columns)).collect()
    assert (a.name, a.relative_path, a.related_code, a.config_keys, a.total_chunks) == ("b.md", "b.md", [], None, 1)
    assert (b.name, b.config_keys, b.env_references, b.section_depth, b.config_format) == ("Untitled", ["k"], [], "1", "")
    assert (c.name, c.node_type, c.related_code, c.relative_path) == ("Untitled", "markdown", None, "")


def test_registered_query_against_a_fold(spark):
    """Sections line by line, chunks by their spans, lines by counting."""
    from lodestone.operators.chunk import chunk_spans
    from lodestone.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    found = {(r.relative_path, r.chunk_index): (r.title, r.start_line, r.end_line, r.content, r.total_chunks) for r in QUERIES["markdown_nodes"](spark, sf_dir).collect()}
    wanted = {}
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect():
        text, sections = f"# {row.lang}\n" + row.text.replace(". ", "\n## "), []
        for line in text.split("\n"):
            if line.startswith(("# ", "## ")) or not sections:
                sections.append([line])
            else:
                sections[-1].append(line)
        chunks = []
        for lines in sections:
            content = "\n".join(lines)
            chunks += [(lines[0].lstrip("#").strip(), content[a:b]) for a, b in chunk_spans(content) if content[a:b].strip()]
        for i, (title, content) in enumerate(chunks):
            first = text[: text.index(content)].count("\n") + 1
            wanted[f"{row.doc_id}.md", i] = (title, first, first + content.count("\n"), content, len(chunks))
    assert found == wanted


@pytest.mark.parametrize(("name", "columns"), [("config_nodes", "id AS c_custkey, id % 5 AS c_nationkey"), ("class_chunks", "id AS s_suppkey, id % 5 AS s_nationkey")])
def test_small_files_are_dealt_to_all_cores(spark, tmp_path, monkeypatch, name, columns):
    """A file of few bytes is one row group, and made much work of one task."""
    from lodestone import queries

    dealt = []
    monkeypatch.setattr(queries, "spread", lambda df: dealt.append(df.columns) or df)
    spark.range(10).selectExpr(*columns.split(", ")).write.parquet(str(tmp_path / ("customer.parquet" if "c_" in columns else "supplier.parquet")))
    queries.QUERIES[name](spark, str(tmp_path))
    assert len(dealt) == 1 and "content" in dealt[0]
