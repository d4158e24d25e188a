"""The search engine's queries against SQL, and its parts on small inputs."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import tokenize, vector
from lodestone.operators import chunk, extract, graph, keyword, tables
from lodestone.plans import retriever
from lodestone.queries import ORACLE, QUERIES
from lodestone.sources import files
from lodestone.streaming import incremental

from .compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE[name], SF) is None


def test_chunks_cover_the_text(spark):
    rows = QUERIES["recursive_chunks"](spark, SF)
    assert rows.where(F.length("content") > chunk.CHUNK_SIZE + chunk.CHUNK_OVERLAP).count() == 0
    assert rows.groupBy("doc_id").agg(F.max("chunk_index").alias("m"), F.max("total_chunks").alias("t"), F.count("*").alias("n")).where("m + 1 <> t or n <> t").count() == 0


def pieces(text, *args):
    return [text[a:b] for a, b in chunk.chunk_spans(text, *args)]


def test_recursive_split():
    assert pieces("a" * 100, 50, 10) == ["a" * 50, "a" * 50, "a" * 20]  # each begins with the last ten of the one before
    assert pieces("one two three", 8, 0) == ["one two", "three"]
    assert pieces("", 5) == [] and pieces("abcdefgh", 3, 1, ()) == ["abc", "cde", "efg", "gh"]
    assert pieces("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]


def piece_by_piece(text, size, overlap, separators):
    """The stated rule, one piece after the other."""
    if len(text) <= size or not separators:
        return [text[i : i + size] for i in range(0, len(text), max(1, size - overlap) if len(text) > size else size)]
    sep, out, held, fresh = separators[0], [], [], True

    def close():
        if held:
            out.append(sep.join(held))

    for piece in text.split(sep) if sep else text:
        if len(piece) + len(sep) > size:
            close()
            held, fresh = [], True
            out += piece_by_piece(piece, size, overlap, separators[1:])
            continue
        if held and len(sep.join([*held, piece])) + len(sep) * fresh > size:
            close()
            while held and sum(len(x) + len(sep) for x in held) > overlap:
                held = held[1:]
            if not overlap:
                held = []
            fresh = False
        held = [*held, piece]
    close()
    return out


@pytest.mark.parametrize(("size", "overlap"), [(10, 0), (10, 4), (25, 12), (60, 20), (7, 6)])
def test_recursive_split_against_pieces(size, overlap):
    rnd = random.Random(size)
    for _ in range(150):
        text = "".join(rnd.choice(("a", "bb", "word", "x" * 12, " ", " ", "\n", "\n\n")) for _ in range(rnd.randint(0, 60)))
        assert pieces(text, size, overlap) == piece_by_piece(text, size, overlap, chunk.SEPARATORS), text


def test_rows_that_share_an_id_do_not_mix(spark):
    docs = spark.createDataFrame([(1, "# A\nx"), (1, "# B\ny"), (None, "## C\nz"), (None, "## D\n\n## E f\nw"), (2, None), (3, "")], "id long, text string")
    got = sorted((r.id or 0, r.section, r.level, r.title or "", r.content) for r in chunk.markdown_sections(docs, "id", "text").collect())
    assert got == [(0, 0, 2, "C", "## C\nz"), (0, 0, 2, "D", "## D\n"), (0, 1, 2, "E f", "## E f\nw"), (1, 0, 1, "A", "# A\nx"), (1, 0, 1, "B", "# B\ny")]
    bare = [r.content for r in chunk.markdown_sections(docs.where("id = 1"), "id", "text", strip_headers=True).collect()]
    assert sorted(bare) == ["x", "y"]
    heads = sorted((r.id or 0, r.depth, r.title, r.start_line, r.end_line, r.content) for r in chunk.header_sections(docs, "id", "text").collect())
    assert heads == [(0, 2, "C", 1, 2, "## C\nz"), (0, 2, "D", 1, 2, "## D\n"), (0, 2, "E f", 3, 4, "## E f\nw")]
    entries = spark.createDataFrame([("f", "a.x=1\na.y=2"), ("f", "a.x=3")], "id string, text string")
    assert sorted(r.content for r in chunk.properties_sections(entries, "id", "text").collect()) == ["a.x=1\na.y=2", "a.x=3"]


def test_file_names_of_any_kind(spark, tmp_path):
    names = ["a b.py", "c#d.py", "e[1].py", "f%20g.py", "ü.py", "h?i.py", "j+k&l.py", "dir x#/m:n.py"]
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    assert {r.file_path: r.content for r in files.scan(spark, str(tmp_path)).collect()} == {n: n for n in names}
    assert {r.file_path for r in files.scan(spark, f"file://{tmp_path}", includes=["*.py", "!x"], ignores=["c*"]).collect()} == set(names) - {"c#d.py"}
    assert {r.file_path for r in files.scan(spark, str(tmp_path), includes=["dir*/"]).collect()} == {"dir x#/m:n.py"}


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("word", "parts"),
    [("getUserById", ["get", "user", "by", "id"]), ("HTTPHandler", ["http", "handler"]), ("ABC123", ["123"]), ("handle_HTTPRequest", ["handle", "httprequest"]),
     ("user-profile-view", ["user", "profile", "view"]), ("café x", ["caf"]), ("검색 엔진test", ["검색", "엔진", "test"]), (None, [])],
)
def test_tokens(spark, word, parts):
    assert one(spark, word, tokenize.tokens) == parts


def test_both_ways_in_partitions_that_grow_in_number(spark, monkeypatch):
    from lodestone.sources import tables as sources

    monkeypatch.setattr(sources, "PART_BYTES", 1 << 10)
    edges = spark.range(1000).selectExpr("concat('a', id % 500) AS source_id", "concat('b', id % 500) AS target_id", "'CALLS' AS relation_type")
    both = graph.with_reverse(edges)
    assert both.count() == 1000 and both.rdd.getNumPartitions() > 20


def test_rows_of_unknown_size_and_joins_are_dealt_too(spark, tmp_path):
    """Spark takes both to be larger than any number of partitions could hold."""
    from lodestone.sources import tables as sources

    rdd = spark.createDataFrame([("a", "b", "CALLS")], "source_id string, target_id string, relation_type string")
    assert graph.with_reverse(rdd).count() == 2
    spark.range(3000).selectExpr("id", "repeat(md5(string(id)), 99) AS x").write.parquet(f"{tmp_path}/t")
    joined = spark.read.parquet(f"{tmp_path}/t")
    for i in range(4):
        joined = joined.join(spark.read.parquet(f"{tmp_path}/t").withColumnRenamed("x", f"x{i}").hint("merge"), "id")
    found = sources.dealt(joined, "id")
    assert found.count() == 3000 and found.rdd.getNumPartitions() == 4


def test_chunks_go_to_python_in_small_batches(spark):
    from lodestone.functions import batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "64m")
    try:
        rows = spark.createDataFrame([(1, "a b")], "k long, t string")
        assert chunk.recursive_chunks(rows, "k", "t").count() == 1 and int(spark.conf.get(name)) <= batches.STEP_BYTES
    finally:
        spark.conf.set(name, before)


def test_capitals_before_digits_as_in_sql(spark, tmp_path):
    """The four token queries over texts with keys of capitals and digits."""
    import duckdb

    from lodestone import queries

    texts = ["key AKIAMD62HKU6VBL", "AB1 ABc2 aB3CD4ef X9Y", "AB-C1 A_BC2 HTTPServer2x", "ABC\uac00DE5", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("SRC1")).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("token_frequencies", "field_postings", "inverse_document_frequencies", "token_count_columns"):
        df, want = queries.QUERIES[name](spark, str(tmp_path)), con.sql(queries.ORACLE[name])
        got = sorted(tuple(r[c] for c in want.columns) for r in df.where("doc_id < 4" if name == "token_count_columns" else "true").collect())
        assert got == sorted(r for r in want.fetchall() if None not in r), name


def test_text_functions(spark):
    assert one(spark, "a/b/My.PY", T.language_of) == "python" and one(spark, "a/none", T.language_of) is None
    assert one(spark, "../a/b", T.normal_path) == "a/b" and one(spark, "x/src/a/b.py", T.module_path) == "a.b"
    assert one(spark, "My Project!", T.normal_project_id) == "my-project" and one(spark, "--", T.normal_project_id) == "default-project"
    assert len(one(spark, "p" * 70, T.normal_project_id)) == 61
    assert one(spark, "${DB_URL} $HOME %TEMP% ${x:y}", T.env_references) == ["DB_URL", "HOME", "TEMP"]
    assert one(spark, "def f():\n  a = 1\n  pass\n  return a\n  b = 2", T.essential_lines) == ["def f():", "  a = 1", "  return a"]
    assert one(spark, '{"a": 1}', T.config_format) == "json" and one(spark, "a=1", T.config_format) == "properties" and one(spark, "a: 1", T.config_format) == "yaml"
    assert one(spark, "x\n# The Title\n", T.file_title) == "The Title"
    assert one(spark, "a\nb\nc", lambda c: T.chunk_lines(c, F.lit("b\nc"))) == (2, 3) and one(spark, "a", lambda c: T.chunk_lines(c, F.lit("z"))) == (1, 1)
    assert [x.name for x in one(spark, "`OrderService` in app/order.py", T.code_references)] == ["OrderService", "app/order.py"]
    assert one(spark, "calls", T.reverse_relation) == "CALLED_BY" and one(spark, "xx", T.translation_code) == "eng_Latn"
    assert [one(spark, str(n), lambda c: T.batch_size(c.cast("int"), F.lit(32))) for n in (100, 5000, 70_000)] == [32, 16, 1]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, None), (5, [])], "i int, v array<double>")
    assert [r.i for r in rows.where(vector.finite(F.col("v"))).orderBy("i").collect()] == [1, 2]
    assert rows.where("i = 1").select(vector.normalised(F.col("v")).alias("x")).first().x == pytest.approx([0.6, 0.8])
    assert rows.where("i = 3").select(vector.without_nan(F.col("v")).alias("x")).first().x == [0.0, 1.0]
    made = spark.createDataFrame([("order service",), ("",)], "t string").select(vector.hashed_embedding(F.col("t"), 8).alias("v")).collect()
    assert sum(x * x for x in made[0].v) == pytest.approx(1.0) and made[1].v == [0.0] * 8


def test_config_sections(spark):
    rows = [("a.json", json.dumps({"app": {"db": {"url": "u"}}, "n": [1, {"k": 2}]}), "json"), ("b.yaml", "x: 1\n---\ny:\n  z: 2\n", "yaml"), ("c.json", "[1]", "json"), ("d.yaml", "a: [", "yaml"), ("e.json", None, "json")]
    got = {(r.path, r.chunk_index): r for r in chunk.config_sections(spark.createDataFrame(rows, "path string, text string, kind string").withColumnRenamed("path", "file"), "file", "text", "kind").collect()}
    assert set(got) == {("app", 0), ("n", 1), ("x", 0), ("y", 1)}
    assert got["app", 0]["keys"] == ["app.db", "app.db.url"] and got["app", 0].depth == 2
    props = spark.createDataFrame([("f", "# note\ndb.url = a\ndb.user=b\nlog.level=x=y\n\n")], "file string, text string")
    assert {(r.prefix, r.n_keys) for r in chunk.properties_sections(props, "file", "text").collect()} == {("db", 2), ("log", 1)}


PYTHON = '''import os
from shop.stock import Stock as S
class Order(Base):
    """An order."""
    def total(self, tax=1):
        for x in self.items:
            if x:
                add(x)
        return add(tax)
class Kind(Enum):
    A = 1
def add(a):
    return a
'''
KOTLIN = """package shop
import shop.stock.Stock
// class Ghost {
class Cart(val n: Int) {
    fun total(): Int { if (n > 0) { return add(n) } ; return 0 }
}
fun add(a: Int): Int { return a }
"""
TS = """import { A } from './lib/a'
export interface Shape { area(): number }
const draw = (s: Shape) => { paint(s) }
export class Box { paint(s: string) { return draw(s) } }
"""


def test_extraction_and_relationships(spark):
    rows = [("shop/order.py", "python", PYTHON), ("shop/Cart.kt", "kotlin", KOTLIN), ("web/box.ts", "typescript", TS), ("bad.py", "python", "def ("), ("none.py", "python", None)]
    found = extract.extract(spark.createDataFrame(rows, "file_path string, language string, content string")).cache()
    objects = extract.objects(found)
    got = {(r.file_path, r.object_type, r.qualified_name): r for r in objects.collect()}
    assert {k[1:] for k in got if k[0] == "shop/order.py"} == {("class", "Order"), ("method", "Order.total"), ("class", "Kind"), ("enum", "Kind"), ("function", "add")}
    total = got["shop/order.py", "method", "Order.total"]
    assert (total.start_line, total.end_line, total.cyclomatic, total.nesting, total.calls) == (5, 9, 3, 2, ["add"])
    assert total.parent_id == got["shop/order.py", "class", "Order"].id and got["shop/order.py", "class", "Order"].docstring == "An order."
    assert {k[1:] for k in got if k[0] == "shop/Cart.kt"} == {("class", "shop.Cart"), ("method", "shop.Cart.total"), ("function", "shop.add")}
    assert {k[1:] for k in got if k[0] == "web/box.ts"} >= {("interface", "Shape"), ("function", "draw"), ("class", "Box"), ("method", "Box.paint")}
    imports = {r.file_path: r.imports for r in found.collect()}
    assert imports["shop/order.py"] == ["os", "shop.stock.Stock"] and imports["shop/Cart.kt"] == ["shop.stock.Stock"] and imports["bad.py"] == []
    assert graph.contains_edges(objects).count() == 4 or graph.contains_edges(objects).count() == 3
    calls = objects.select(F.col("id").alias("source_id"), F.explode("calls").alias("name"))
    edges = {(r.source_id, r.target_id) for r in graph.resolve_calls(calls, objects).collect()}
    assert any(s == total.id for s, _ in edges)
    wanted = found.select("file_path", F.explode("imports").alias("imported"))
    stock = objects.select("id", "name", "file_path", "ordinal", F.lit("x").alias("module_path")).unionByName(objects.limit(1).select(F.lit("stock-id").alias("id"), F.lit("Stock").alias("name"), F.lit("shop/stock.py").alias("file_path"), "ordinal", F.lit("shop.stock").alias("module_path")))
    assert {r.target_id for r in graph.resolve_imports(wanted, stock).collect()} == {"stock-id"}


def test_scan_of_a_file_in_another_encoding(spark, tmp_path):
    (tmp_path / "a.py").write_bytes("x = 'caf\u00e9'\n".encode("latin-1"))
    (tmp_path / "b.py").write_text("y = 1\n")
    got = {r.file_path: r.content for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "x = 'caf\ufffd'\n", "b.py": "y = 1\n"}


def test_many_queries_go_in_slices(spark, monkeypatch):
    from lodestone.operators import ranking

    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<double>")
    asked = rows.selectExpr("vec_id AS query_id", "embedding")
    whole = sorted(map(tuple, ranking.nearest(rows, "vec_id", "embedding", asked, 3).collect()))
    monkeypatch.setattr(ranking, "SLICE_QUERIES", 9)
    assert sorted(map(tuple, ranking.nearest(rows, "vec_id", "embedding", asked, 3).collect())) == whole and len(whole) == 180


def test_postings_shuffle_texts_once_and_tokens_never(spark):
    rows = spark.createDataFrame([(1, "a file", "two two words"), (1, "b", "two rows"), (None, "c", "no id"), (2, None, None)], "doc_id long, source string, text string")
    posted = keyword.postings(rows, "doc_id", {"source": 5.0, "text": 5.0})
    plan = posted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert {(r.id, r.n) for r in posted.groupBy("id").agg(F.count("*").alias("n")).collect()} == {(1, 4), (None, 2)}


def test_nearest_meets_in_blocks_and_is_exact(spark, monkeypatch):
    """Copies, null ids, other lengths, zero vectors and ids of text, in blocks
    of few rows; no join of all rows with all queries is in the plan."""
    from lodestone.functions import vector
    from lodestone.operators import ranking

    rnd = random.Random(3)
    rows = [(f"v{i}", [rnd.uniform(-1, 1) for _ in range(5)]) for i in range(300)]
    rows += [(f"w{i}", list(rows[i % 7][1])) for i in range(120)] + [(None, list(rows[0][1])), ("z", [0.0] * 5), ("nan", [float("nan")] * 5), ("none", None)]
    rows += [(f"s{i}", [float(i), 1.0]) for i in range(3)]
    table = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    asked = table.where("vec_id like 'v%0' or vec_id in ('z', 's1')").selectExpr("vec_id AS query_id", "embedding")
    a, b = (table.where(vector.finite(F.col("embedding"))).select(F.col("vec_id").alias(n), vector.normalised(F.col("embedding")).alias(v)) for n, v in (("id", "v"), ("query_id", "q")))
    pairs = a.join(b.join(asked.select("query_id"), "query_id", "left_semi")).where("size(v) = size(q)")
    want = sorted(map(repr, ranking.top_k(pairs.select("query_id", "id", vector.dot(F.col("v"), F.col("q")).alias("score")), 4, ["query_id"]).collect()))
    for block, exact in ((1024, 1 << 14), (7, 5)):
        monkeypatch.setattr(ranking, "BLOCK_ROWS", block)
        monkeypatch.setattr(ranking, "EXACT_PAIRS", exact)
        monkeypatch.setattr(ranking, "BLOCK_QUERIES", block)
        got = ranking.nearest(table, "vec_id", "embedding", asked, 4)
        assert sorted(map(repr, got.collect())) == want and len(want) == 4 * 31 + 3
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert ranking.nearest(table.limit(0), "vec_id", "embedding", asked, 4).count() == 0
    assert ranking.nearest(table, "vec_id", "embedding", asked.limit(0), 4).count() == 0


def test_scan(spark, tmp_path):
    for name, body in {"a/x.py": "x = 1", "a/build/y.py": "y", "docs/r.md": "# r", "conf/c.yml": "a: 1", "keep.log.py": "z", "skip/me.py": "m", "skip/not.py": "n", "image.bin": "b", "pom.xml": "<a/>", "a/big.py": "b" * 3000}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = files.scan(spark, str(tmp_path), ["skip/*", "!skip/not.py", "*.log.py"], max_mb=2000 / (1 << 20))
    assert {(r.file_path, r.kind) for r in got.collect()} == {("a/x.py", "code"), ("docs/r.md", "markdown"), ("conf/c.yml", "config"), ("skip/not.py", "code")}
    assert {r.kind: r.n_files for r in files.statistics(got).collect()} == {"code": 2, "markdown": 1, "config": 1, "total": 4}
    listing = spark.createDataFrame([("pom.xml",), ("a/package.json",), ("a/b/c/d/e/setup.py",)], "file_path string")
    assert {r.module for r in files.modules(listing).collect()} == {".", "a"}
    assert files.ignore_lines("# c\n\n a \n!b\n") == ["a", "!b"]


def objects_table(spark):
    rows = [("a", "OrderService", "shop.OrderService", "class", "shop/order.py", "creates an order and totals it"), ("b", "total", "shop.OrderService.total", "method", "shop/order.py", "sums the order lines"),
            ("c", "PaymentGateway", "pay.PaymentGateway", "class", "pay/gate.py", "sends money for an order"), ("d", "read me", None, "document", "docs/r.md", "how to place an order")]
    df = spark.createDataFrame(rows, "id string, name string, qualified_name string, object_type string, file_path string, content string")
    return df.withColumn("embedding", vector.hashed_embedding(F.concat_ws(" ", "name", "content"), 32)).withColumn("language", F.lit("python")).withColumn("score_weight", F.lit(1.0)).withColumn("result_type", F.when(F.col("object_type") == "document", "document").otherwise("code"))


@pytest.mark.parametrize("fusion", ["rrf", "dbsf"])
def test_search_plan(spark, fusion):
    rows = objects_table(spark)
    queries = spark.createDataFrame([(1, "OrderService"), (2, "money gateway")], "query_id long, text string").withColumn("embedding", vector.hashed_embedding(F.col("text"), 32))
    edges = graph.with_reverse(spark.createDataFrame([("a", "b", "CONTAINS"), ("c", "a", "CALLS")], "source_id string, target_id string, relation_type string"))
    found = retriever.search(rows, queries, keyword.CODE_FIELDS | {"name": 15.0} if False else {"name": 15.0, "content": 6.0}, retriever.SearchOptions(limit=3, fusion=fusion, threshold=0.001), edges)
    got = {(r.query_id, r.position): r.id for r in found.collect()}
    assert got[1, 1] == "a" and got[2, 1] == "c" and max(p for _, p in got) <= 3
    assert json.loads(retriever.as_json(found).where("query_id = 1 and position = 1").first().json)["name"] == "OrderService"
    folder = retriever.search(rows, queries, {"name": 15.0, "content": 6.0}, retriever.SearchOptions(file="pay"))
    assert {r.file_path for r in folder.collect()} == {"pay/gate.py"}
    for bad in ({"limit": 0}, {"min_score": 2.0}, {"fusion": "sum"}):
        with pytest.raises(ValueError):
            retriever.SearchOptions(**bad)


def test_stream_merges_only_changes(spark, tmp_path):
    table, arriving = f"{tmp_path}/table", f"{tmp_path}/in"
    columns = "file_path string, content string, at long"
    first = spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], columns).withColumn("checksum", T.checksum(F.col("content")))
    tables.save_version(first, table)
    spark.createDataFrame([("a", "2", 2), ("a", "3", 3), ("b", "1", 9), ("c", "1", 2)], columns).write.parquet(arriving)
    incremental.follow(spark.readStream.schema(columns).parquet(arriving), table, "file_path", "content", "at", f"{tmp_path}/state").awaitTermination(120)
    time.sleep(0.1)
    got = {(r.file_path, r.content, r.at) for r in tables.load_current(spark, table).collect()}
    assert got == {("a", "3", 3), ("b", "1", 1), ("c", "1", 2)}


def test_edges_attach(spark):
    objects = spark.createDataFrame([("a",), ("b",), ("z",)], "id string")
    edges = spark.createDataFrame([("a", "b", "CALLS")], "source_id string, target_id string, relation_type string")
    got = {r.id: (r.outgoing, r.incoming) for r in tables.attach_edges(objects, edges).collect()}
    assert got["a"][0][0].target_id == "b" and got["b"][1][0].source_id == "a" and got["z"] == (None, None)


def test_hybrid_chunks_hold_all_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\nshort\n## B\n" + "word " * 60), (2, None), (3, " ")], "doc_id long, text string")
    got = sorted((r.doc_id, r.section, r.part, r.title, r.content) for r in chunk.hybrid_chunks(docs, "doc_id", "text", 100, 20).collect())
    assert [(s, p, t) for _, s, p, t, _ in got[:2]] == [(0, 0, None), (1, 0, "A")] and {s for _, s, *_ in got} == {0, 1, 2}
    assert len(got) > 5 and all(len(c) <= 100 for *_, c in got)


def test_lines_of_offsets_and_state(spark):
    assert [one(spark, "é\nb\n", lambda c, n=n: T.line_of_offset(c, F.lit(n))) for n in (0, 2, 3, 5, 99)] == [1, 1, 2, 3, 3]
    state = tables.set_state(spark.createDataFrame([], "key string, value string"), spark.createDataFrame([("a", "é")], "key string, value string"))
    assert state.first().value == "w6k=" and {(r.key, r.value) for r in tables.get_state(state, spark.createDataFrame([("a",), ("b",)], "key string")).collect()} == {("a", "é"), ("b", None)}


def plain_merge(chunks, least, most):
    out, small = [], []
    for c in [*chunks, None]:
        if c is not None and len(c) // 4 < least:
            small.append(c)
            if sum(len(x) // 4 for x in small) >= least:
                out, small = [*out, "\n\n".join(small)], []
        elif c is not None:
            out, small = [*out, *(["\n\n".join(small)] if small else []), c], []
    if small and out and len(out[-1]) // 4 + sum(len(x) // 4 for x in small) < most:
        small = [out.pop(), *small]
    return [*out, *(["\n\n".join(small)] if small else [])]


@pytest.mark.parametrize("lengths", [[], [3], [40, 40], [8, 8, 8, 40, 8], [40, 8, 8], [8] * 9, [8, 40, 8, 8, 8, 8], [300, 8], [0, 0, 40, 0]])
def test_small_chunks_merge(spark, lengths):
    parts = [chr(97 + i) * n for i, n in enumerate(lengths)]
    rows = spark.createDataFrame([(1, i, str(i), [str(i)], c) for i, c in enumerate(parts)], "f int, chunk_index int, path string, keys array<string>, content string")
    got = chunk.merge_small(rows, "f", 6, 60).orderBy("chunk_index").collect()
    assert [r.content for r in got] == plain_merge(parts, 6, 60) and sum(r.merged_count for r in got) == len(parts)


def test_heading_chunks(spark):
    def plain(text, size):
        out, held, start, at = [], [], 0, 0
        for line in text.split("\n"):
            if line.startswith("#") and line.lstrip("#")[:1].isspace() and line.lstrip("#").strip() and len("\n".join(held)) > size:
                out, held, start = [*out, ("\n".join(held), start, at)], [line], at
            else:
                held.append(line)
            at += len(line) + 1
        return [*out, ("\n".join(held), start, len(text))]

    text = "# a\nxx\n## b\n" + "y" * 30 + "\n#no\n# c\n\n#\nz\n### d\nend\n"
    for size in (0, 3, 10, 100):
        assert chunk.cut_at_headings(text, size) == plain(text, size)
    rows = chunk.heading_chunks(spark.createDataFrame([(1, text), (2, None)], "i int, t string"), "i", "t", 10).collect()
    assert [(r.content, r.start, r.end) for r in rows if r.i == 1] == plain(text, 10) and [r.content for r in rows if r.i == 2] == [""]


def test_edges_of_unknown_kinds_do_not_expand(spark):
    results = spark.createDataFrame([(1, "a", 1.0)], "query_id int, id string, score double")
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("a", "c", "LIKES")], "source_id string, target_id string, relation_type string")
    assert [r.id for r in graph.expand(results, edges, threshold=0.0).collect()] == ["b"]
