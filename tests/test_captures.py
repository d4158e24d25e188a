"""Captures of five languages, and what they mean."""

import random
from collections import Counter

import pytest

from lodestone.operators import extract, graph

FILES = {
    "python": """import os

@decorate
class Cart(Base, shop.Thing):
    def total(self, rate=default()):
        return sum(x.price for x in self.items) * rate

    async def pay(self): return Cart(total)

def main():
    def inner(): pay(1)
    Cart.total(print)
""",
    "typescript": """export class Store extends Base implements Reader, Writer<Item> {
  get(key: string) { return this.find(key); }
  put(item) { check(item); return new Box(item, { key: item }); }
}
function check(x) {
  if (x) { fail(Store); }
}
""",
    "javascript": """class Cat extends Animal {
  speak() { // not(a, call)
    log("meow(x)");
  }
}
function* run(a = {}) { return make(Cat, a.b); }
outside(Cat);
""",
    "java": """public class Shop<T extends Item> extends Base<T>
    implements Reader, pkg.Writer<T> {
  class Inner implements Closeable { }
}
""",
    "kotlin": """class Order(val id: Int, val f: (Int) -> Int) : Base(id), Reader, Writer<Item> {
  class Line
}
class Plain
class Two :
    Reader
""",
}

EXPECTED = {
    "python": {("EXTENDS", "Base", 4, "Cart"), ("EXTENDS", "shop.Thing", 4, "Cart"), ("REFERENCES", "Cart", 4, "Cart"), ("REFERENCES", "Base", 4, "Cart"), ("REFERENCES", "shop", 4, "Cart"), ("REFERENCES", "Thing", 4, "Cart"),
               ("REFERENCES", "total", 5, "total"), ("REFERENCES", "self", 5, "total"), ("REFERENCES", "rate", 5, "total"), ("CALLS", "default", 5, "total"), ("CALLS", "sum", 6, "total"), ("REFERENCES", "x", 6, "total"),
               ("REFERENCES", "price", 6, "total"), ("REFERENCES", "self", 6, "total"), ("REFERENCES", "items", 6, "total"), ("REFERENCES", "rate", 6, "total"), ("REFERENCES", "pay", 8, "pay"), ("REFERENCES", "self", 8, "pay"),
               ("CALLS", "Cart", 8, "pay"), ("REFERENCES", "total", 8, "pay"), ("REFERENCES", "main", 10, "main"), ("REFERENCES", "inner", 11, "inner"), ("CALLS", "pay", 11, "inner"), ("REFERENCES", "Cart", 12, "main"),
               ("REFERENCES", "total", 12, "main"), ("REFERENCES", "print", 12, "main")},
    "typescript": {("REFERENCES", "Store", 1, "Store"), ("EXTENDS", "Base", 1, "Store"), ("REFERENCES", "Base", 1, "Store"), ("IMPLEMENTS", "Reader", 1, "Store"), ("IMPLEMENTS", "Writer", 1, "Store"),
                   ("REFERENCES", "key", 2, "get"), ("REFERENCES", "item", 3, "put"), ("CALLS", "check", 3, "put"), ("REFERENCES", "Box", 3, "put"), ("REFERENCES", "check", 5, "check"), ("REFERENCES", "x", 5, "check"),
                   ("REFERENCES", "x", 6, "check"), ("CALLS", "fail", 6, "check"), ("REFERENCES", "Store", 6, "check")},
    "javascript": {("REFERENCES", "Cat", 1, "Cat"), ("EXTENDS", "Animal", 1, "Cat"), ("REFERENCES", "Animal", 1, "Cat"), ("CALLS", "log", 3, "speak"), ("REFERENCES", "run", 6, "run"), ("REFERENCES", "a", 6, "run"),
                   ("CALLS", "make", 6, "run"), ("REFERENCES", "Cat", 6, "run")},
    "java": {("EXTENDS", "Base", 1, "Shop"), ("IMPLEMENTS", "Reader", 2, "Shop"), ("IMPLEMENTS", "pkg.Writer", 2, "Shop"), ("IMPLEMENTS", "Closeable", 3, "Inner")},
    "kotlin": {("EXTENDS", "Base", 1, "Order"), ("IMPLEMENTS", "Reader", 1, "Order"), ("IMPLEMENTS", "Writer", 1, "Order"), ("IMPLEMENTS", "Reader", 6, "Two")},
}


@pytest.mark.parametrize("language", sorted(FILES))
def test_captures(language):
    got = {(c["kind"], c["name"], c["line"], c["scope_name"]) for c in extract.captures_of(FILES[language], language)}
    assert got == EXPECTED[language]


@pytest.mark.parametrize("language", sorted(FILES))
def test_captures_of_odd_files(language):
    for text in ("", "class", "}}}{{{", "def (", "class A extends", "\x00", "function", "class B implements", "'" * 7, "é" * 50, "class X : ", "(" * 300):
        extract.captures_of(text, language)


def test_edges_of_five_languages(spark):
    files = spark.createDataFrame([(f"src/{g}", g, t) for g, t in FILES.items()] + [("src/none", "python", None)], "file_path string, language string, content string")
    found = extract.extract(files)
    objects = extract.objects(found)
    names = {r.id: r.name for r in objects.collect()}
    edges = {(names[r.source_id], r.relation_type, names[r.target_id]) for r in graph.capture_edges(extract.captures(found), objects).collect()}
    assert edges == {
        ("total", "REFERENCES", "total"), ("pay", "CALLS", "Cart"), ("pay", "REFERENCES", "total"), ("inner", "CALLS", "pay"), ("main", "REFERENCES", "Cart"), ("main", "REFERENCES", "total"),
        ("put", "CALLS", "check"), ("check", "REFERENCES", "Store"), ("run", "REFERENCES", "Cat"),
    } - {("total", "REFERENCES", "total")}


def plain_nearest(captures, objects):
    out = []
    for cid, path, name, line, own in captures:
        there = sorted((o, i, at) for i, p, n, at, o in objects if (p, n) == (path, name))
        if there and None not in (path, name):
            best = min([(abs(own - line), there[0][0], there[0][1]), *[(abs(at - line), o, i) for o, i, at in there[1:]]])
            out.append((cid, best[2], best[0]))
    return sorted(out)


def test_nearest_targets_against_all_pairs(spark):
    rnd = random.Random(4)
    spot = lambda: (rnd.choice(("f", "f", "g", None)), rnd.choice(("n", "n", "n", "m", None)))
    objects = [(f"o{i}", *spot(), rnd.choice((rnd.randint(1, 900), rnd.randint(300, 320))), i) for i in range(150)]
    captures = [(i, *spot(), rnd.randint(1, 1200), rnd.randint(1, 900)) for i in range(600)] + [(9000, "x", "n", 1, 1)]
    got = graph.nearest_target(spark.createDataFrame(captures, "capture_id long, file_path string, name string, line long, source_line long"), spark.createDataFrame(objects, "id string, file_path string, name string, start_line long, ordinal long"))
    assert sorted(map(tuple, got.collect())) == plain_nearest(captures, objects)
    assert len(plain_nearest(captures, objects)) > 250


def test_scopes_prefer_the_object_on_their_line(spark):
    objects = spark.createDataFrame([("a", "f", "go", 1, 0), ("b", "f", "go", 9, 1), ("c", "f", "go", 9, 2)], "id string, file_path string, name string, start_line int, ordinal int")
    rows = [("f", "CALLS", "x", 3, "go", 9), ("f", "CALLS", "x", 4, "go", 5), ("f", "CALLS", "x", 5, "gone", 1), (None, "CALLS", "x", 5, "go", 1)]
    got = graph.scope_object(spark.createDataFrame(rows, "file_path string, kind string, name string, line int, scope_name string, scope_line int"), objects)
    assert Counter((r.line, r.source_id, r.source_line) for r in got.collect()) == {(3, "b", 9): 1, (4, "a", 1): 1}


def test_no_side_of_the_edges_is_broadcast(spark, tmp_path):
    """A file of few bytes makes captures of many, and the driver would hold them."""
    from lodestone import queries

    spark.range(40).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    df = queries.QUERIES["captured_edges"](spark, str(tmp_path))
    assert df.count() == 400 and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def plain_edges(captures, objects):
    out = set()
    for path, kind, name, line, scope, scope_line in captures:
        of = lambda n: sorted((o, i, at) for i, p, m, at, o in objects if (p, m) == (path, n))  # noqa: B023, E731
        around, there = of(scope), of(name)
        if path is None or None in (name, scope, line) or not around or not there:
            continue
        same = [x for x in around if x[2] == scope_line]
        _, source, source_line = (same or around)[0]
        best = min([(abs(source_line - line), *there[0][:2]), *[(abs(at - line), o, i) for o, i, at in there[1:]]])[2]
        if not (kind == "REFERENCES" and len(there) == 1 and best == source):
            out.add((source, best, kind))
    return sorted(out)


def test_edges_against_one_capture_after_the_other(spark):
    rnd = random.Random(8)
    path, name = lambda: rnd.choice(("f", "f", "g", None)), lambda: rnd.choice(("n", "n", "m", "k", None))
    objects = [(f"o{i}", path(), name(), rnd.choice((rnd.randint(1, 900), rnd.randint(300, 310))), i) for i in range(120)] + [("z", "h", "only", 5, 200)]
    captures = [(path(), rnd.choice(("CALLS", "REFERENCES")), name(), rnd.choice((rnd.randint(1, 900), rnd.randint(300, 310), None)), name(), rnd.choice((rnd.randint(300, 310), 7, None))) for _ in range(700)]
    captures += [("h", "REFERENCES", "only", 6, "only", 5), ("h", "CALLS", "only", 6, "only", 5), ("h", "CALLS", "gone", 6, "only", 5), ("h", "CALLS", "only", 6, "gone", 5)]
    held = spark.createDataFrame(objects, "id string, file_path string, name string, start_line int, ordinal int")
    got = graph.capture_edges(spark.createDataFrame(captures * 2, "file_path string, kind string, name string, line int, scope_name string, scope_line int"), held)
    assert sorted(map(tuple, got.collect())) == plain_edges(captures, objects)
    assert len(plain_edges(captures, objects)) > 150


def test_files_are_dealt_once_and_never_kept(spark, tmp_path, monkeypatch):
    """In partitions that grow in number; what a task holds is bounded."""
    from lodestone import queries

    monkeypatch.setattr(extract, "FILE_BYTES", 1 << 10)
    spark.range(100).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    df = queries.QUERIES["captured_edges"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "InMemoryTableScan" not in plan
    assert df.rdd.getNumPartitions() > 20 and df.count() == 1000
