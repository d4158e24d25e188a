"""Relationships between code objects, and expansion along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import REVERSE_RELATION, reverse_relation
from ..sources.tables import dealt

# --- fixed values: edge weights and expansion constants ---
EDGE_WEIGHT = {
    "CONTAINS": 0.8, "CONTAINED_BY": 0.8, "CALLS": 0.7, "CALLED_BY": 0.7, "REFERENCES": 0.6, "REFERENCED_BY": 0.6,
    "EXTENDS": 0.5, "EXTENDED_BY": 0.5, "IMPLEMENTS": 0.5, "IMPLEMENTED_BY": 0.5, "IMPORTS": 0.4, "IMPORTED_BY": 0.4,
}
DAMPING, KEEP_SHARE, SEEDS, THRESHOLD = 0.85, 0.3, 5, 0.4
# --- end of fixed values ---

EDGE = ("source_id", "target_id", "relation_type")


def with_reverse(edges: DataFrame) -> DataFrame:
    """The edges and the opposite of each forward one, each once; the edges
    are read once."""
    back = F.when(F.upper("relation_type").isin(*REVERSE_RELATION), F.struct(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), reverse_relation(F.col("relation_type")).alias("relation_type")))
    both = F.filter(F.array(F.struct(*EDGE), back), lambda e: e.isNotNull())
    return dealt(edges.select(F.explode(both).alias("e")).select("e.*"), *EDGE).dropDuplicates(list(EDGE))


def contains_edges(objects: DataFrame) -> DataFrame:
    """CONTAINS edges from each parent that exists to its children."""
    parents = objects.select(F.col("id").alias("source_id"))
    return objects.where("parent_id is not null").select(F.col("parent_id").alias("source_id"), F.col("id").alias("target_id")).join(parents, "source_id", "left_semi").withColumn("relation_type", F.lit("CONTAINS"))


def edge_weight(kind: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in EDGE_WEIGHT.items() for x in pair])
    return F.coalesce(weights[F.upper(kind)], F.lit(0.5))


def expand(results: DataFrame, edges: DataFrame, seeds: int = SEEDS, threshold: float = THRESHOLD) -> DataFrame:
    """Neighbours of each query's best results: ``query_id, id, score``.

    A neighbour's rank is the seed's score, the edge's weight and 1 - damping
    multiplied; the largest counts, if it reaches ``threshold``, and a fixed
    share of it becomes the score.  Results that are there already, and edges
    of a kind without weight, are left out.  The seeds, few per query, meet the edges in an equi-join.
    """
    first = results.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("n") <= seeds).select("query_id", F.col("id").alias("source_id"), F.col("score").alias("seed"))
    rank = F.col("seed") * edge_weight(F.col("relation_type")) * (1 - DAMPING)
    known = edges.select(*EDGE).where(F.upper("relation_type").isin(*EDGE_WEIGHT))
    reached = first.join(known, "source_id").groupBy("query_id", F.col("target_id").alias("id")).agg(F.max(rank).alias("ppr"))
    new = reached.where(F.col("ppr") >= threshold).join(results.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return new.select("query_id", "id", (F.col("ppr") * KEEP_SHARE).alias("score"))


def summarise(edges: DataFrame) -> DataFrame:
    """Per object and relation: the number of other ends, and up to ten of
    them in order."""
    numbered = edges.select(*EDGE).distinct().withColumn("n", F.row_number().over(Window.partitionBy("source_id", "relation_type").orderBy("target_id")))
    return numbered.groupBy(F.col("source_id").alias("id"), "relation_type").agg(F.count("*").alias("total_count"), F.array_sort(F.collect_list(F.when(F.col("n") <= 10, F.col("target_id")))).alias("items"))


def direct_callers(edges: DataFrame) -> DataFrame:
    return edges.where(F.upper("relation_type") == "CALLS").groupBy(F.col("target_id").alias("id")).agg(F.count_distinct("source_id").alias("direct_callers"))


#: Lines of a block within which a capture is compared with every object.
BLOCK_LINES = 64


def _with_nearest(captures: DataFrame, objects: DataFrame) -> DataFrame:
    """``captures`` (file_path, name, line, source_line and more) with
    ``target_id``, ``distance`` and ``n_targets`` (objects of file and name).

    An as-of join without pairs.  Objects of one line count by their first.  A
    file and name's lines are cut into blocks; a block has at most one object a
    line, and is handed the nearest object before and after it by a window over
    blocks.  So every capture meets one row of bounded size, and a name that
    very many captures have is an ordinary hot key of an equi-join whose other
    side is unique.  All sides grow with the files, so none is broadcast: read
    from small files, they are far larger than Spark takes them to be.
    """
    key = ["file_path", "name"]
    block = lambda line: F.floor(F.col(line) / BLOCK_LINES).alias("block")
    first = objects.groupBy(*key).agg(F.min_by(F.struct("id", "ordinal"), "ordinal").alias("first"), F.count_distinct("id").alias("n_targets"))
    # the first object counts from the capture's own source, wherever it stands itself
    later = objects.join(first.select(*key, F.col("first.ordinal").alias("o__")).hint("merge"), key).where("ordinal > o__").groupBy(*key, "start_line").agg(F.min("ordinal").alias("ordinal"), F.min_by("id", "ordinal").alias("id"))
    item = F.struct("start_line", "ordinal", "id")
    none = F.lit(None).cast(later.select(item.alias("i")).schema["i"].dataType)
    held = later.select(*key, block("start_line"), item.alias("item")).unionByName(captures.select(*key, block("line")).distinct().withColumn("item", none))
    blocks = held.groupBy(*key, "block").agg(F.collect_list("item").alias("items"))
    near = Window.partitionBy(*key).orderBy("block")
    before = F.last(F.when(F.size("items") > 0, F.array_max("items")), ignorenulls=True).over(near.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(F.size("items") > 0, F.array_min("items")), ignorenulls=True).over(near.rowsBetween(1, Window.unboundedFollowing))
    blocks = blocks.withColumns({"before": before, "after": after}).join(first.hint("merge"), key)
    met = captures.withColumn("block", block("line")).join(blocks.hint("merge"), [*key, "block"])
    far = lambda x: F.struct(F.abs(x["start_line"] - F.col("line")).alias("distance"), x["ordinal"].alias("ordinal"), x["id"].alias("id"))
    own = F.struct(F.abs(F.col("source_line") - F.col("line")).alias("distance"), F.col("first.ordinal").alias("ordinal"), F.col("first.id").alias("id"))
    others = F.transform(F.array_compact(F.concat("items", F.array("before", "after"))), far)
    best = F.array_min(F.concat(F.array(own), others))
    return met.withColumn("best", best).select(*captures.columns, F.col("best.id").alias("target_id"), F.col("best.distance").alias("distance"), "n_targets")


def nearest_target(captures: DataFrame, objects: DataFrame) -> DataFrame:
    """The object that a captured name means: among those of the same file and
    name, the nearest by line.  The first candidate counts with the distance
    of the capture's own source; a later one must be strictly nearer.
    ``captures``: capture_id, file_path, name, line, source_line; ``objects``:
    id, file_path, name, start_line, ordinal.

    Captures without an object of their file and name, or with a null in
    either, have no row; repeated captures have a row each.
    """
    asked = captures.select("capture_id", "file_path", "name", "line", "source_line")
    return _with_nearest(asked, objects).select("capture_id", "target_id", "distance")


def scope_object(captures: DataFrame, objects: DataFrame) -> DataFrame:
    """``captures`` with ``source_id`` and ``source_line``: the object that the
    enclosing scope (scope_name, scope_line) means.  Of the objects of file and
    name, that which starts on the scope's line, else the first; a capture
    whose scope has no such object has no row."""
    first = objects.groupBy("file_path", F.col("name").alias("scope_name")).agg(F.min_by(F.struct("id", "start_line"), "ordinal").alias("first"))
    same = objects.groupBy("file_path", F.col("name").alias("scope_name"), F.col("start_line").alias("scope_line")).agg(F.min_by("id", "ordinal").alias("same"))
    found = captures.join(first.hint("merge"), ["file_path", "scope_name"]).join(same.hint("merge"), ["file_path", "scope_name", "scope_line"], "left")
    line = F.when(F.col("same").isNotNull(), F.col("scope_line")).otherwise(F.col("first.start_line"))
    return found.select(*captures.columns, F.coalesce("same", "first.id").alias("source_id"), line.alias("source_line"))


def capture_edges(captures: DataFrame, objects: DataFrame) -> DataFrame:
    """CALLS, EXTENDS, IMPLEMENTS and REFERENCES edges within files, each once.

    ``captures``: file_path, kind, name, line, scope_name, scope_line;
    ``objects``: id, file_path, name, start_line, ordinal.  The edge starts at
    the object of the capture's scope and ends at the nearest object of its
    name.  A reference of which that object is the only meaning is none.
    """
    own = objects.select("file_path", F.struct("ordinal", "id", "name", "start_line").alias("o"))
    asked = captures.select("file_path", F.struct("kind", "name", "line", "scope_name", "scope_line").alias("c"))
    rows = dealt(own.unionByName(asked, allowMissingColumns=True), "file_path")
    return edges_of_files(rows).select("source.id", F.col("target.id").alias("target_id"), "relation_type").toDF(*EDGE)


def edges_of_files(rows: DataFrame) -> DataFrame:
    """``file_path, source, target, relation_type``: ``capture_edges`` with
    whole objects at the ends.  ``rows``: file_path with either ``o`` (ordinal,
    id, name, start_line and more) or ``c`` (a capture).

    Every step is a window over parts of one file, so rows that are dealt by
    file_path are read once, stay where they are and are sorted there; no side
    is kept or sent again.  The scope is the object that ``scope_object``
    finds, the target that of ``nearest_target``: objects of a name but the
    first, by lines in both directions, hand themselves on to the captures.
    """
    is_object = F.col("o").isNotNull()
    valid = is_object & F.col("o.name").isNotNull() | F.col("c.name").isNotNull() & F.col("c.line").isNotNull() & F.col("c.scope_name").isNotNull()
    rows = rows.where(F.col("file_path").isNotNull() & valid)
    first = lambda *by: F.min(F.when(F.col("o").isNotNull(), F.struct("o.ordinal", "o"))).over(Window.partitionBy(*by))["o"]

    scopes = rows.withColumns({"at": F.coalesce("o.name", "c.scope_name"), "place": F.coalesce("o.start_line", "c.scope_line")})
    same = F.when(F.col("place").isNotNull(), first("file_path", "at", "place"))
    scopes = scopes.withColumn("same", same).withColumn("source", F.coalesce("same", first("file_path", "at")))
    scopes = scopes.withColumn("source_line", F.when(F.col("same").isNotNull(), F.col("place")).otherwise(F.col("source.start_line")))

    met = scopes.where(is_object | F.col("source").isNotNull()).select("file_path", "o", F.when(is_object, F.lit(None)).otherwise(F.col("source")).alias("source"), "source_line", F.col("c.kind").alias("relation_type"), F.coalesce("o.name", "c.name").alias("at"), F.coalesce("o.start_line", "c.line").alias("line"))
    every = Window.partitionBy("file_path", "at")
    met = met.withColumns({"first": first("file_path", "at"), "one": F.min("o.id").over(every) == F.max("o.id").over(every)})
    later = F.when(F.col("o.ordinal") > F.col("first.ordinal"), F.when(F.col("o.start_line").isNotNull(), F.col("o")))
    reach = lambda line: F.last(later, ignorenulls=True).over(every.orderBy(line, F.col("o").isNull(), F.desc("o.ordinal")).rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumns({"before": reach(F.asc("line")), "after": reach(F.desc("line"))}).where(~is_object & F.col("first").isNotNull())

    far = lambda x, line: F.struct(F.abs(line - F.col("line")).alias("distance"), x["ordinal"].alias("ordinal"), x.alias("o"))
    others = [F.when(F.col(side).isNotNull(), far(F.col(side), F.col(f"{side}.start_line"))) for side in ("before", "after")]
    target = F.array_min(F.array_compact(F.array(far(F.col("first"), F.col("source_line")), *others)))["o"]
    met = met.select("file_path", "source", target.alias("target"), "relation_type", "one")
    own = (F.col("relation_type") == "REFERENCES") & F.col("one") & (F.col("target.id") == F.col("source.id"))
    return met.where(~own).select("file_path", "source", "target", "relation_type").distinct()


def enclosing_scope(captures: DataFrame, objects: DataFrame, bin_lines: int = 64) -> DataFrame:
    """The innermost object whose lines hold each capture's line.

    Lines are binned: an object is entered in every bin that it touches, so
    that the interval join is an equi-join on file and bin."""
    bins = F.explode(F.sequence(F.floor(F.col("start_line") / bin_lines), F.floor(F.col("end_line") / bin_lines)))
    held = objects.select("file_path", "id", "start_line", "end_line", bins.alias("bin"))
    pairs = captures.withColumn("bin", F.floor(F.col("line") / bin_lines)).join(held, ["file_path", "bin"]).where("line between start_line and end_line")
    return pairs.groupBy("capture_id").agg(F.max_by("id", F.struct("start_line", -F.col("end_line"), "id")).alias("scope_id"))


def resolve_imports(imports: DataFrame, objects: DataFrame) -> DataFrame:
    """IMPORTS edges: an imported name matches objects by its whole, by its
    last dotted part, or as the module path of their file; the edge starts at
    the importing file's first object.  ``imports``: file_path, imported;
    ``objects``: id, name, file_path, module_path, ordinal."""
    first = objects.groupBy("file_path").agg(F.min_by("id", "ordinal").alias("source_id"))
    wanted = imports.select("file_path", "imported").distinct()
    by = lambda key, column: wanted.withColumn("k", key).join(objects.select(F.col(column).alias("k"), F.col("id").alias("target_id")), "k").select("file_path", "target_id")
    last = F.element_at(F.split("imported", r"\."), -1)
    found = by(F.col("imported"), "name").unionByName(by(last, "name")).unionByName(by(F.col("imported"), "module_path")).distinct()
    return found.join(first, "file_path").where("source_id <> target_id").select("source_id", "target_id", F.lit("IMPORTS").alias("relation_type")).distinct()


def resolve_calls(calls: DataFrame, objects: DataFrame) -> DataFrame:
    """CALLS edges by name within the project: the first object, in order, of
    the called name other than the caller.  ``calls``: source_id, name."""
    # the caller itself is one object, so the first two of a name are enough
    order = Window.partitionBy("name").orderBy("ordinal")
    two = objects.select("name", "id", "ordinal").withColumn("n", F.row_number().over(order)).where("n <= 2")
    pairs = calls.select("source_id", "name").distinct().join(two, "name").where("id <> source_id")
    return pairs.groupBy("source_id", "name").agg(F.min_by("id", "ordinal").alias("target_id")).select("source_id", "target_id", F.lit("CALLS").alias("relation_type"))
