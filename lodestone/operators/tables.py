"""Table maintenance: lookups, upserts, deletes and incremental differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is among ``ids``; missing ids are skipped."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, that of the greatest version."""
    order = Window.partitionBy(key).orderBy(F.desc(version))
    return rows.withColumn("n__", F.row_number().over(order)).where("n__ = 1").drop("n__")


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` replaces rows of the same key; the last writer wins."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def delete(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is not among ``ids``."""
    return table.join(ids.select(key), key, "left_anti")


def changed_files(current: DataFrame, cached: DataFrame, key: str = "file_path") -> DataFrame:
    """``status`` of every current file: unchanged only if its checksum is
    known and equals the cached one."""
    old = cached.select(key, F.col("checksum").alias("cached"))
    same = F.col("checksum").isNotNull() & (F.col("checksum") == F.col("cached"))
    return current.join(old, key, "left").select(key, F.when(same, "unchanged").otherwise("changed").alias("status"))


def difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``status`` of every key of two snapshots with checksums: new, changed,
    unchanged or deleted."""
    a, b = old.select(key, F.col("checksum").alias("old__"), F.lit(True).alias("was__")), new.select(key, F.col("checksum").alias("new__"), F.lit(True).alias("is__"))
    status = F.when(F.col("was__").isNull(), "new").when(F.col("is__").isNull(), "deleted").when(F.col("old__") == F.col("new__"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def reuse_embeddings(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """``new`` with the embedding of the old row of the same key and checksum,
    and whether it was reused."""
    held = old.where("embedding is not null").select(F.col(key).alias("k__"), F.col("checksum").alias("c__"), F.col("embedding").alias("e__"))
    joined = new.join(held, (new[key] == held["k__"]) & (new["checksum"] == held["c__"]), "left")
    return joined.withColumn("reused", F.col("e__").isNotNull()).withColumn("embedding", F.coalesce("e__", "embedding")).drop("k__", "c__", "e__")


def attach_edges(objects: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Objects with the lists of their outgoing and incoming edges."""
    out = edges.groupBy(F.col("source_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("relation_type", "target_id"))).alias("outgoing"))
    into = edges.groupBy(F.col("target_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("relation_type", "source_id"))).alias("incoming"))
    return objects.join(out, key, "left").join(into, key, "left")


def save_version(df: DataFrame, root: str) -> str:
    """Writes a new version of a table beside the older ones, whose readers go
    on undisturbed, and names it current in a one-row table."""
    import uuid

    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").json(f"{root.rstrip('/')}/current")
    return path


def load_current(spark, root: str) -> DataFrame:
    return spark.read.parquet(spark.read.schema("path string").json(f"{root.rstrip('/')}/current").first().path)


def fetch(ids: DataFrame, code: DataFrame, documents: DataFrame, key: str = "id") -> DataFrame:
    """The rows of wanted ids: code objects first, what is not among these
    from the documents.  Both tables have the same columns; ``result_type``
    names where a row comes from.  Ids in neither are skipped."""
    wanted = ids.select(key).distinct()
    found = code.join(wanted, key, "left_semi").withColumn("result_type", F.lit("code"))
    rest = wanted.join(code.select(key), key, "left_anti")
    return found.unionByName(documents.join(rest, key, "left_semi").withColumn("result_type", F.lit("document")))


def indexed_files(table: DataFrame) -> DataFrame:
    """Each file path of a table once, without bound."""
    return table.select("file_path").where("file_path is not null").distinct()


def enrich(registry: DataFrame, states: DataFrame, key: str = "project_id") -> DataFrame:
    """Registered projects and stored index states, each kept without the
    other: counts default to 0, a name to the id."""
    joined = registry.join(states, key, "full_outer")
    return joined.withColumn("name", F.coalesce("name", F.col(key).cast("string"))).withColumn("total_objects", F.coalesce("total_objects", F.lit(0).cast("long")))


def resolve(queries: DataFrame, projects: DataFrame) -> DataFrame:
    """``query, project_id``: a query means the project of this id or, if there
    is none, of this name whatever its case; of several the one with the most
    objects, then the last indexed.  ``queries``: query; ``projects``:
    project_id, name, total_objects, last_indexed."""
    asked = queries.select("query").distinct()
    columns = ("project_id", "total_objects", "last_indexed")
    by_id = asked.join(projects.select(*columns), F.col("query") == F.col("project_id")).withColumn("by_name", F.lit(0))
    named = projects.select(*columns, F.lower("name").alias("lower_name"))
    by_name = asked.join(named, F.lower("query") == F.col("lower_name")).drop("lower_name").withColumn("by_name", F.lit(1))
    best = F.struct(-F.col("by_name"), F.coalesce("total_objects", F.lit(0)), "last_indexed", "project_id")
    return by_id.unionByName(by_name).groupBy("query").agg(F.max_by("project_id", best).alias("project_id"))


def invalid_rows(objects: DataFrame) -> DataFrame:
    """Rows that break a rule, with the ``problems``: an empty id or checksum,
    lines below 1 or in the wrong order."""
    rules = {
        "id": F.coalesce(F.col("id"), F.lit("")) == "",
        "checksum": F.coalesce(F.col("checksum"), F.lit("")) == "",
        "start_line": F.coalesce(F.col("start_line") < 1, F.lit(True)),
        "end_line": F.coalesce(F.col("end_line") < F.col("start_line"), F.lit(True)),
    }
    problems = F.array_compact(F.array(*[F.when(wrong, F.lit(name)) for name, wrong in rules.items()]))
    return objects.withColumn("problems", problems).where(F.size("problems") > 0)


def set_state(state: DataFrame, new: DataFrame) -> DataFrame:
    """Key-value state after writing ``new`` (key, value): values are kept in
    base 64, a later value replaces an earlier one."""
    return upsert(state, new.select("key", F.base64(F.col("value").cast("binary")).alias("value")), "key")


def get_state(state: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, value`` of the wanted keys, null where there is none."""
    return keys.select("key").distinct().join(state, "key", "left").select("key", F.unbase64("value").cast("string").alias("value"))


def relevance(truth: DataFrame, results: DataFrame, least_coverage: int = 2, least_precision: float = 0.3) -> DataFrame:
    """Per query with results: ``coverage`` (0 to 3), ``precision`` and whether
    both suffice.  ``truth``: query_id, category, priority, path, symbol;
    ``results``: query_id, file_path, name.

    An item of the truth counts if its path is part of a result's path and,
    for implementations and domain models, its symbol (or the part after the
    last ``::``) is part of the result's name.  Coverage has a point each for
    an implementation, for a domain model or documentation, and for context,
    which either of them gives too.  Precision sets the distinct symbols (or
    paths, without one) of H1 items with such a result against the query's H1
    items.  The join is on the query.
    """
    symbol = F.coalesce("symbol", F.lit(""))
    named = F.contains("name", symbol) | F.contains("name", F.element_at(F.split(symbol, "::"), -1))
    first = F.coalesce(F.col("priority") == "H1", F.lit(False))
    near = results.join(truth, "query_id").where(F.contains("file_path", "path"))
    hit = lambda *kinds: F.col("category").isin(*kinds)
    seen = near.groupBy("query_id").agg(
        F.max(hit("implementation") & named).alias("implementation"),
        F.max((hit("domain_model") & F.contains("name", symbol)) | hit("documentation")).alias("domain"),
        F.max(hit("context")).alias("context"),
        F.count_distinct(F.when(first & F.contains("name", F.element_at(F.split(F.coalesce("symbol", "path"), "::"), -1)), F.coalesce("symbol", "path"))).alias("hits"),
    )
    symbols = truth.groupBy("query_id").agg(F.count_if(first).alias("symbols"))
    both = results.select("query_id").distinct().join(seen, "query_id", "left").join(symbols, "query_id", "left").na.fill(False).na.fill(0)
    point = lambda c: c.cast("long")
    some = F.col("implementation") | F.col("domain")
    scored = both.withColumn("coverage", point(F.col("implementation")) + point(F.col("domain")) + point(F.col("context") | some)).withColumn("precision", F.when(F.col("symbols") > 0, F.col("hits") / F.col("symbols")).otherwise(0.0))
    return scored.select("query_id", "coverage", "precision", ((F.col("coverage") >= least_coverage) & (F.col("precision") >= least_precision)).alias("passes"))


def latencies(runs: DataFrame, name: str, seconds: str) -> DataFrame:
    """Least, most and mean duration of each kind of run, and runs a second."""
    r = lambda c: F.round(c, 6)
    return runs.groupBy(name).agg(F.count("*").alias("runs"), r(F.min(seconds)).alias("least"), r(F.max(seconds)).alias("most"), r(F.avg(seconds)).alias("average"), r(F.count("*") / F.sum(seconds)).alias("per_second"))
