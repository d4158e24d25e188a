"""The registered queries of the search engine, with their DuckDB SQL.

Each query reads whole tables.  Where a search needs queries of its own, every
row whose id is divisible by 100 is one.  Floating-point results are rounded to
six decimals on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import tokenize, vector
from .operators import chunk, config, extract, fuzzy, graph, keyword, lines, nodes, parse_quality, prose, ranking, references, tables
from .operators.index import PostingsIndex
from .sources.tables import dealt, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SEARCH_TEXT = "the and estion"


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one(spark: SparkSession, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("query_id"), F.lit(text).alias("text"))


# --- SQL pieces; the word pattern is that of functions.tokenize ---

_WORDS = r"regexp_extract_all({0}, '[a-zA-Z0-9_\-]+|[\x{{AC00}}-\x{{D7A3}}\x{{1100}}-\x{{11FF}}\x{{3130}}-\x{{318F}}]+|[\x{{3040}}-\x{{309F}}\x{{30A0}}-\x{{30FF}}]+|[\x{{4E00}}-\x{{9FFF}}]+')"
_SPLIT = r"""(CASE WHEN contains(w, '_') THEN list_filter(string_split(w, '_'), lambda p: p <> '')
 WHEN contains(w, '-') THEN list_filter(string_split(w, '-'), lambda p: p <> '')
 WHEN unicode(w) < 128 THEN regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')
 ELSE [w] END)"""


def _tokens(text: str) -> str:
    split = _SPLIT.replace("w, ", "w_, ").replace("(w)", "(w_)").replace("[w]", "[w_]")
    return f"list_filter(flatten(list_transform({_WORDS.format(text)}, lambda w_: list_transform({split}, lambda x: lower(x)))), lambda t: length(t) > 1 OR unicode(t) >= 128)"


_HASH = "('0x' || left(sha256({0}), 8))::BIGINT"
_COSINE = "list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])"

_POSTED = f"""
tok AS (SELECT doc_id AS id, field, boost, unnest(t) AS token, greatest(1, n) AS len FROM (
  SELECT doc_id, 0 AS field, 5.0 AS boost, {_tokens("source")} AS t, len({_tokens("source")}) + len({_tokens("text")}) AS n FROM documents
  UNION ALL SELECT doc_id, 1, 5.0, {_tokens("text")}, len({_tokens("source")}) + len({_tokens("text")}) FROM documents)),
tf AS (SELECT id, field, boost, len, token, count(*) AS tf FROM tok GROUP BY ALL),
posted AS (SELECT id, {_HASH.format("token")} AS token_hash, sum(boost * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / 100.0))) AS weight FROM tf GROUP BY 1, 2),
idf AS (SELECT token_hash, count(*) AS df, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posted GROUP BY 1)"""

_SCORED = f"""{_POSTED},
terms AS (SELECT {_HASH.format("t")} AS token_hash, count(*) AS qtf FROM (SELECT unnest({_tokens("'" + SEARCH_TEXT + "'")}) AS t) GROUP BY 1),
sparse AS (SELECT id, sum(weight * qtf * idf) AS score FROM posted JOIN terms USING (token_hash) JOIN idf USING (token_hash) GROUP BY 1)"""

FIELDS = {"source": 5.0, "text": 5.0}


def _sparse(spark, sf_dir) -> DataFrame:
    docs = spread(_read(spark, sf_dir, "documents").select("doc_id", *FIELDS))
    asked = _one(spark, SEARCH_TEXT)
    posted = keyword.postings(docs, "doc_id", FIELDS, wanted=keyword.wanted_tokens(asked, "text", True), capitals=True)
    return keyword.keyword_scores(posted, keyword.query_terms(asked, "query_id", "text", True), docs.count())


# --- keyword search (X1-X4, A1-A5, J16, L1) ---


@query(f"WITH {_SCORED} SELECT id AS doc_id, round(score, 6) AS score FROM sparse ORDER BY sparse.score DESC, id LIMIT 10")
def keyword_search(spark, sf_dir):
    """The ten best documents for a text: the limit is the feature."""
    return ranking.top_k(_sparse(spark, sf_dir), 10, ["query_id"]).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents) GROUP BY ALL")
def token_frequencies(spark, sf_dir):
    docs = spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.explode(tokenize.tokens(F.col("text"), True)).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


@query(f"WITH {_POSTED} SELECT id, token_hash, round(weight, 6) AS weight FROM posted")
def field_postings(spark, sf_dir):
    return keyword.postings(spread(_read(spark, sf_dir, "documents").select("doc_id", *FIELDS)), "doc_id", FIELDS, capitals=True).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_POSTED} SELECT token_hash, df, round(idf, 6) AS idf FROM idf")
def inverse_document_frequencies(spark, sf_dir):
    docs = spread(_read(spark, sf_dir, "documents").select("doc_id", *FIELDS))
    return keyword.document_frequencies(keyword.postings(docs, "doc_id", FIELDS, capitals=True), docs.count()).withColumn("idf", F.round("idf", 6))


@query(f"""SELECT doc_id, len({_tokens("text")}) AS token_count, len(list_distinct({_tokens("text")})) AS unique_token_count FROM documents""")
def token_count_columns(spark, sf_dir):
    a, b = tokenize.token_counts(F.col("text"), True)
    return _read(spark, sf_dir, "documents").select("doc_id", a.alias("token_count"), b.alias("unique_token_count"))


# --- dense search and fusion (X11, F3, F4, J15, J17, W1, W9, R2) ---

_NEAR = f"""near AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COSINE.format("e.embedding", "q.embedding")} AS score
 FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)"""


def _near(spark, sf_dir, k):
    rows = _read(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return ranking.nearest(rows, "vec_id", "embedding", asked, k)


@query(f"WITH {_NEAR} SELECT query_id, id, round(score, 6) AS score, row_number() OVER w AS rank FROM near WINDOW w AS (PARTITION BY query_id ORDER BY near.score DESC, id) QUALIFY rank <= 5")
def vector_search(spark, sf_dir):
    return _near(spark, sf_dir, 5).withColumn("score", F.round("score", 6))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, len(embedding) AS dimension FROM embeddings")
def vector_norms(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").where(vector.finite(F.col("embedding")))
    return rows.select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").alias("dimension"))


_DENSE = f"""dense AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, score FROM (
 SELECT vec_id AS id, {_COSINE.format("embedding", "(SELECT embedding FROM embeddings WHERE vec_id = 0)")} AS score FROM embeddings) ORDER BY score DESC, id LIMIT 210),
top AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, score FROM sparse ORDER BY score DESC, id LIMIT 90)"""


def _branches(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings")
    dense_k, sparse_k = ranking.prefetch(30)
    asked = rows.where("vec_id = 0").select(F.lit(0).cast("long").alias("query_id"), "embedding")
    return [ranking.nearest(rows, "vec_id", "embedding", asked, dense_k), ranking.top_k(_sparse(spark, sf_dir), sparse_k, ["query_id"])]


@query(f"WITH {_SCORED}, {_DENSE}, fused AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT id, rank FROM dense UNION ALL SELECT id, rank FROM top) GROUP BY 1) SELECT id, round(score, 6) AS score FROM fused")
def hybrid_rank_fusion(spark, sf_dir):
    return ranking.fuse_ranks(_branches(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


_Z = "least(greatest(((score - avg(score) OVER ()) / stddev_pop(score) OVER () + 3) / 6, 0), 1)"


@query(f"WITH {_SCORED}, {_DENSE} SELECT id, round(sum(z), 6) AS score FROM (SELECT id, {_Z} AS z FROM dense UNION ALL SELECT id, {_Z} FROM top) GROUP BY 1")
def hybrid_distribution_fusion(spark, sf_dir):
    return ranking.fuse_distributions(_branches(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


# --- boosts and diversity (X10, X15, U5, U6, F5, W2, L4, L5) ---

_PARTS = f"""parts AS (SELECT p_partkey AS id, p_name AS name, p_brand AS file_path, {_tokens("'steel part'")} AS qt, list_distinct({_tokens("lower(p_name)")}) AS nt,
  p_size / 50.0 AS base, CASE p_size % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'enum' WHEN 3 THEN 'interface' ELSE 'variable' END AS kind FROM part),
boosted AS (SELECT id, file_path, base * (1 + CASE kind WHEN 'class' THEN 0.12 WHEN 'method' THEN 0.10 WHEN 'enum' THEN 0.08 WHEN 'interface' THEN 0.06 ELSE 0 END
  + CASE WHEN lower(name) = 'steel part' THEN 0.25 WHEN contains(lower(name), 'steel part') THEN 0.20
    WHEN len(nt) > 0 AND len(list_filter(nt, lambda x: NOT list_contains(qt, x))) = 0 THEN 0.15
    WHEN len(nt) > 0 AND len(list_filter(qt, lambda x: NOT list_contains(nt, x))) = 0 THEN 0.12
    WHEN len(list_intersect(qt, nt)) > 0 THEN 0.05 * len(list_intersect(qt, nt)) / len(qt) ELSE 0 END) AS score FROM parts)"""


def _parts(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ("class", "method", "enum", "interface", "variable"))), F.col("p_size") % 5 + 1)
    rows = _read(spark, sf_dir, "part").select(
        F.lit(0).alias("query_id"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"), F.col("p_brand").alias("file_path"),
        (F.col("p_size") / 50.0).alias("score"), kinds.alias("object_type"), F.lit("code").alias("result_type"), F.lit(1.0).alias("score_weight"))
    return ranking.boosted(rows, F.lit("steel part"))


@query(f"WITH {_PARTS} SELECT id, round(score, 6) AS score FROM boosted")
def boosted_scores(spark, sf_dir):
    return _parts(spark, sf_dir).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {_PARTS}, rounded AS (SELECT id, file_path, round(score, 6) AS score FROM boosted WHERE round(score, 6) >= 0.5), ranked AS (SELECT *, row_number() OVER (ORDER BY rounded.score DESC, id) AS position FROM rounded),
numbered AS (SELECT *, sum((position > 1)::INT) OVER (PARTITION BY file_path ORDER BY position) AS nth FROM ranked)
SELECT id, score, position FROM numbered WHERE position <= 1 OR nth <= 2""")
def diverse_results(spark, sf_dir):
    scored = _parts(spark, sf_dir).withColumn("score", F.round("score", 6)).where("score >= 0.5")
    return ranking.diverse(scored, 1).select("id", "score", F.col("position").cast("long").alias("position"))


@query(f"""SELECT doc_id, round(least(greatest(CASE WHEN n >= 20 THEN 1.0::DOUBLE WHEN n >= 10 THEN 0.5::DOUBLE + (n - 10) / 20.0::DOUBLE ELSE greatest(0.1::DOUBLE, n / 10.0::DOUBLE) END
 * (1.0::DOUBLE + CASE WHEN lang = 'en' THEN 0.15 ELSE 0 END + CASE WHEN source = 'src1' THEN 0.10 ELSE 0 END), 0.1), 1.2), 6) AS weight
FROM (SELECT *, len({_tokens("text")}) AS n FROM documents)""")
def score_weights(spark, sf_dir):
    n, _ = tokenize.token_counts(F.col("text"), True)
    return _read(spark, sf_dir, "documents").withColumn("n", n).select("doc_id", F.round(T.score_weight(F.col("n"), F.col("lang") == "en", F.col("source") == "src1"), 6).alias("weight"))


# --- relationships (U2, U7, J3-J6, J18, A6, A10, A11, X13, X14, X17) ---

_EDGES = """edges AS (
  SELECT 'n' || c_nationkey AS source_id, 'c' || c_custkey AS target_id, 'CONTAINS' AS relation_type FROM customer
  UNION SELECT 'c' || o_custkey, 'o' || o_orderkey, 'CALLS' FROM orders
  UNION SELECT 'o' || l_orderkey, 'p' || l_partkey, 'REFERENCES' FROM lineitem
  UNION SELECT 's' || l_suppkey, 'p' || l_partkey, 'IMPORTS' FROM lineitem),
both_ways AS (SELECT * FROM edges UNION SELECT target_id, source_id, CASE relation_type WHEN 'CONTAINS' THEN 'CONTAINED_BY' WHEN 'CALLS' THEN 'CALLED_BY' WHEN 'REFERENCES' THEN 'REFERENCED_BY' ELSE 'IMPORTED_BY' END FROM edges)"""


def _edges(spark, sf_dir):
    def side(table, a, source, b, target, kind):
        return _read(spark, sf_dir, table).select(F.concat(F.lit(a), source).alias("source_id"), F.concat(F.lit(b), target).alias("target_id"), F.lit(kind).alias("relation_type"))

    every = (
        side("customer", "n", "c_nationkey", "c", "c_custkey", "CONTAINS")
        .unionByName(side("orders", "c", "o_custkey", "o", "o_orderkey", "CALLS"))
        .unionByName(side("lineitem", "o", "l_orderkey", "p", "l_partkey", "REFERENCES"))
        .unionByName(side("lineitem", "s", "l_suppkey", "p", "l_partkey", "IMPORTS"))
    )
    return dealt(every, *graph.EDGE).distinct()


@query(f"WITH {_EDGES} SELECT * FROM both_ways")
def edges_both_ways(spark, sf_dir):
    return graph.with_reverse(_edges(spark, sf_dir))


@query(f"""WITH {_EDGES}, n AS (SELECT *, row_number() OVER (PARTITION BY source_id, relation_type ORDER BY target_id) AS i FROM edges)
SELECT source_id AS id, relation_type, count(*) AS total_count, array_to_string(list_sort(list(target_id) FILTER (i <= 10)), ',') AS items FROM n GROUP BY ALL""")
def relationship_summary(spark, sf_dir):
    return graph.summarise(_edges(spark, sf_dir)).withColumn("items", F.array_join("items", ","))


@query(f"WITH {_EDGES} SELECT target_id AS id, count(*) AS direct_callers FROM edges WHERE relation_type = 'CALLS' GROUP BY 1")
def direct_callers(spark, sf_dir):
    return graph.direct_callers(_edges(spark, sf_dir))


@query("SELECT 'r' || n_regionkey AS source_id, 'n' || n_nationkey AS target_id, 'CONTAINS' AS relation_type FROM nation")
def containment(spark, sf_dir):
    nations = _read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    regions = _read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    return graph.contains_edges(nations.unionByName(regions))


@query(f"""WITH {_EDGES}, seeds AS (SELECT 'c' || c_custkey AS id, 1.0 / (1 + c_custkey % 7) AS score, c_nationkey AS query_id FROM customer),
first AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM seeds),
reached AS (SELECT query_id, target_id AS id, max(score * CASE relation_type WHEN 'CONTAINED_BY' THEN 0.8 ELSE 0.7 END * 0.15) AS ppr FROM first JOIN both_ways ON first.id = source_id WHERE n <= 5 GROUP BY 1, 2)
SELECT query_id, id, round(ppr * 0.3, 6) AS score FROM reached WHERE ppr >= 0.01 AND NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = reached.query_id AND s.id = reached.id)""")
def graph_expansion(spark, sf_dir):
    results = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query_id"), F.concat(F.lit("c"), "c_custkey").alias("id"), (1.0 / (1 + F.col("c_custkey") % 7)).alias("score"))
    return graph.expand(results, graph.with_reverse(_edges(spark, sf_dir)), threshold=0.01).withColumn("score", F.round("score", 6))


@query("""SELECT capture_id, target_id, distance FROM (
 SELECT c.event_id AS capture_id, o.event_id AS target_id, abs(CASE WHEN o.event_id = min(o.event_id) OVER (PARTITION BY c.event_id) THEN c.event_id % 97 ELSE o.event_id % 1009 END - c.event_id % 211) AS distance
 FROM events c JOIN events o ON c.user_id = o.user_id AND c.event_type = o.event_type)
QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY distance, target_id) = 1""")
def nearest_targets(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    key = [F.col("user_id").alias("file_path"), F.col("event_type").alias("name")]
    captures = events.select(F.col("event_id").alias("capture_id"), *key, (F.col("event_id") % 211).alias("line"), (F.col("event_id") % 97).alias("source_line"))
    objects = events.select(F.col("event_id").alias("id"), *key, (F.col("event_id") % 1009).alias("start_line"), F.col("event_id").alias("ordinal"))
    return graph.nearest_target(captures, objects)


_SOURCE = """class A{k}:
    def run(self):
        return helper(self)

class B{c}(A{k}):
    def go(self):
        run = A{k}
        return B{c}(run)

def helper(x):
    return x

def helper(x, y):
    return run(B{c}, x.helper)
"""


@query("""WITH f AS (SELECT c_custkey AS c, 'A' || (c_custkey % 5) AS a, 'B' || c_custkey AS b FROM customer), e(source, target, relation_type) AS (VALUES
 ('run', 'helper:10', 'CALLS'), ('B', 'A', 'EXTENDS'), ('B', 'A', 'REFERENCES'), ('go', 'A', 'REFERENCES'), ('go', 'run', 'REFERENCES'), ('go', 'B', 'CALLS'),
 ('helper:10', 'helper:10', 'REFERENCES'), ('helper:13', 'helper:10', 'REFERENCES'), ('helper:13', 'run', 'CALLS'), ('helper:13', 'B', 'REFERENCES'))
SELECT c AS customer, CASE source WHEN 'A' THEN a WHEN 'B' THEN b ELSE split_part(source, ':', 1) END AS source, CASE target WHEN 'A' THEN a WHEN 'B' THEN b ELSE split_part(target, ':', 1) END AS target,
 (CASE split_part(target, ':', 2) WHEN '10' THEN 10 WHEN '13' THEN 13 ELSE CASE target WHEN 'A' THEN 1 WHEN 'run' THEN 2 ELSE 5 END END)::INTEGER AS target_line, relation_type FROM f, e""")
def captured_edges(spark, sf_dir):
    """Edges within files: for each customer a Python file that uses its names."""
    body = F.replace(F.replace(F.lit(_SOURCE), F.lit("{k}"), (F.col("c_custkey") % 5).cast("string")), F.lit("{c}"), F.col("c_custkey").cast("string"))
    files = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("file_path"), F.lit("python").alias("language"), body.alias("content"))
    edges = graph.edges_of_files(extract.captures_and_objects(files))
    return edges.select(F.col("file_path").cast("long").alias("customer"), F.col("source.name").alias("source"), F.col("target.name").alias("target"), F.col("target.start_line").alias("target_line"), "relation_type")


@query("""SELECT l_orderkey * 10 + l_linenumber AS capture_id, max_by(o.o_orderkey, o.o_orderkey) AS scope_id
FROM lineitem JOIN orders o ON l_orderkey % 50 = o.o_orderkey % 50 AND l_orderkey BETWEEN o.o_orderkey AND o.o_orderkey + 120 GROUP BY 1""")
def enclosing_scopes(spark, sf_dir):
    captures = _read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("capture_id"), (F.col("l_orderkey") % 50).alias("file_path"), F.col("l_orderkey").alias("line")).distinct()
    scopes = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 50).alias("file_path"), F.col("o_orderkey").alias("start_line"), (F.col("o_orderkey") + 120).alias("end_line"))
    return graph.enclosing_scope(captures, scopes)


# --- tables and snapshots (J10-J14, S10-S22, U4) ---

_SNAPSHOTS = """old AS (SELECT doc_id, md5(text) AS checksum FROM documents WHERE doc_id % 13 <> 0),
new AS (SELECT doc_id, md5(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS checksum FROM documents WHERE doc_id % 17 <> 0)"""


def _snapshots(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    edited = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return docs.where("doc_id % 13 <> 0").select("doc_id", F.md5(F.col("text").cast("binary")).alias("checksum")), docs.where("doc_id % 17 <> 0").select("doc_id", F.md5(edited.cast("binary")).alias("checksum"))


@query(f"WITH {_SNAPSHOTS} SELECT new.doc_id, CASE WHEN new.checksum = old.checksum THEN 'unchanged' ELSE 'changed' END AS status FROM new LEFT JOIN old USING (doc_id)")
def changed_files(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return tables.changed_files(new, old, "doc_id")


@query(f"""WITH {_SNAPSHOTS} SELECT coalesce(new.doc_id, old.doc_id) AS doc_id, CASE WHEN old.doc_id IS NULL THEN 'new' WHEN new.doc_id IS NULL THEN 'deleted'
 WHEN new.checksum = old.checksum THEN 'unchanged' ELSE 'changed' END AS status FROM new FULL JOIN old ON new.doc_id = old.doc_id""")
def snapshot_difference(spark, sf_dir):
    return tables.difference(*_snapshots(spark, sf_dir), "doc_id")


@query(f"WITH {_SNAPSHOTS} SELECT * FROM new UNION ALL SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)")
def upserted_table(spark, sf_dir):
    return tables.upsert(*_snapshots(spark, sf_dir), "doc_id")


@query(f"WITH {_SNAPSHOTS} SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)")
def deleted_rows(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return tables.delete(old, "doc_id", new)


@query(f"WITH {_SNAPSHOTS} SELECT new.doc_id, new.checksum, old.doc_id IS NOT NULL AS reused FROM new LEFT JOIN old ON new.doc_id = old.doc_id AND new.checksum = old.checksum")
def reused_embeddings(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    none = F.lit(None).cast("array<float>")
    return tables.reuse_embeddings(new.withColumn("embedding", none), old.withColumn("embedding", F.array(F.lit(1.0).cast("float"))), "doc_id").drop("embedding")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def batch_lookup(spark, sf_dir):
    ids = _read(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return tables.lookup(_read(spark, sf_dir, "part"), "p_partkey", ids).select("p_partkey", "p_name")


# --- counts and reports (A7-A9, A17-A20, S8, L6-L8, J22, J23) ---


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def language_counts(spark, sf_dir):
    return _read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT coalesce(source, 'total') AS source, count(*) AS n_rows, count(*) FILTER (contains(text, '#')) AS with_marks FROM documents GROUP BY ROLLUP (source)")
def collection_statistics(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").rollup("source").agg(F.count("*").alias("n_rows"), F.count_if(F.contains("text", F.lit("#"))).alias("with_marks"))
    return rows.withColumn("source", F.coalesce("source", F.lit("total")))


_WORDS_OF = r"CASE WHEN trim(regexp_replace({0}, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' ')) END"


@query(f"SELECT role, count(*) AS requests, sum(n) AS tokens, round(sum(n) * 0.00002, 6) AS cost, round(avg(n), 6) AS average FROM (SELECT role, floor({_WORDS_OF.format('text')} * 1.3)::BIGINT AS n FROM conversations) GROUP BY 1")
def cost_summary(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select("role", T.billed_tokens(F.col("text")).cast("long").alias("n"))
    return rows.groupBy("role").agg(F.count("*").alias("requests"), F.sum("n").alias("tokens"), F.round(F.sum("n") * 0.00002, 6).alias("cost"), F.round(F.avg("n"), 6).alias("average"))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 20")
def recent_records(spark, sf_dir):
    """The twenty latest records: the limit is the feature."""
    return _read(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "ts", "event_type")


@query("""SELECT source, max(quality = 1) AS has_good, max(toxic = 1) AS has_toxic, count(DISTINCT lang) AS n_languages, round(avg(quality), 6) AS precision_rate
FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def relevance_report(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.max(F.col("quality") == 1).alias("has_good"), F.max(F.col("toxic") == 1).alias("has_toxic"), F.count_distinct("lang").alias("n_languages"), F.round(F.avg("quality"), 6).alias("precision_rate"))


# --- texts, names and paths (X5-X9, X16, X17, X22-X26, X34-X39, F8-F12, C1, C3) ---


@query("SELECT doc_id, left(sha256(concat_ws(':', source, lang, doc_id::VARCHAR)), 32) AS id, left(sha256(concat_ws(':', source, lang, doc_id::VARCHAR)), 16) AS chunk_id FROM documents")
def deterministic_ids(spark, sf_dir):
    parts = [F.col(c) for c in ("source", "lang", "doc_id")]
    return _read(spark, sf_dir, "documents").select("doc_id", T.object_id(*parts).alias("id"), T.short_id(*parts).alias("chunk_id"))


@query(r"""WITH p AS (SELECT page_id, url, trim(regexp_replace(lower(url), '[^a-z0-9-]', '-', 'g'), '-') AS c FROM pages)
SELECT page_id, string_split(url, '/')[-1] AS base, CASE WHEN c = '' THEN 'default-project' WHEN length(c) > 63 THEN left(c, 50) || '-' || left(sha1(c), 10) ELSE c END AS project_id,
replace(regexp_replace(string_split(url, '/src/')[-1], '\.py$', ''), '/', '.') AS module FROM p""")
def path_functions(spark, sf_dir):
    url = F.col("url")
    return _read(spark, sf_dir, "pages").select("page_id", T.basename(url).alias("base"), T.normal_project_id(url).alias("project_id"), T.module_path(url).alias("module"))


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '\$\{([A-Z_][A-Z0-9_]*)\}', 1) || regexp_extract_all(html, '\$([A-Z_][A-Z0-9_]*)', 1) || regexp_extract_all(html, '%([A-Z_][A-Z0-9_]*)%', 1))), ',') AS env,
len(regexp_extract_all(html, '`([A-Z][A-Za-z0-9_]*)`', 1)) AS n_classes FROM pages""")
def reference_extraction(spark, sf_dir):
    html = F.col("html")
    refs = F.filter(T.code_references(html), lambda x: x["type"] == "class")
    return _read(spark, sf_dir, "pages").select("page_id", F.array_join(T.env_references(html), ",").alias("env"), F.size(refs).alias("n_classes"))


@query(r"""WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT rid, doc_id, text, unnest(l) AS line, unnest(range(len(l))) AS no FROM rows),
parts AS (SELECT *, sum((regexp_extract(trim(line), '^(#{1,3}) ', 1) <> '')::INT) OVER (PARTITION BY rid ORDER BY no) AS part FROM lines),
chunk AS (SELECT rid, doc_id, part, any_value(text) AS text, string_agg(line, chr(10) ORDER BY no) AS content FROM parts GROUP BY 1, 2, 3),
placed AS (SELECT *, 1 + length(left(text, instr(text, content) - 1)) - length(replace(left(text, instr(text, content) - 1), chr(10), '')) AS first, string_split(content, chr(10)) AS l FROM chunk WHERE regexp_matches(content, '\S'))
SELECT doc_id, first AS start_line, first + len(l) - 1 AS end_line, floor(length(content) / 4)::INTEGER AS estimate,
 len(list_filter(l[2:], lambda y: regexp_matches(y, 'return|=|await|raise|yield'))) AS n_key_lines FROM placed""")
def chunk_places(spark, sf_dir):
    """The lines of every section in its document."""
    docs = _read(spark, sf_dir, "documents").select("text", F.struct("doc_id", "text").alias("doc"))
    found = chunk.markdown_sections(docs, "doc", "text").withColumn("lines", F.split("content", "\n"))
    place = T.chunk_lines(F.col("doc.text"), F.col("content"))
    later = F.filter(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), lambda x: F.rlike(x, F.lit("return|=|await|raise|yield")))
    return found.select("doc.doc_id", place["start_line"].cast("long").alias("start_line"), place["end_line"].cast("long").alias("end_line"), T.token_estimate(F.col("content")).alias("estimate"), F.size(later).cast("long").alias("n_key_lines"))


@query(r"""WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT rid, doc_id, unnest(l) AS line, unnest(range(len(l))) AS no FROM rows),
marked AS (SELECT *, length(regexp_extract(trim(line), '^(#{1,3}) ', 1)) AS level FROM lines),
parts AS (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY rid ORDER BY no) AS part FROM marked),
joined AS (SELECT rid, doc_id, part, max(level) AS level, string_agg(line, chr(10) ORDER BY no) AS content FROM parts GROUP BY 1, 2, 3)
SELECT doc_id, row_number() OVER (PARTITION BY rid ORDER BY part) - 1 AS section, level, md5(content) AS content_md5 FROM joined WHERE regexp_matches(content, '\S')""")
def markdown_sections(spark, sf_dir):
    found = chunk.markdown_sections(_read(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.col("section").cast("long").alias("section"), F.col("level").cast("long").alias("level"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query()
def recursive_chunks(spark, sf_dir):
    """Tested against properties of the chunks: SQL has no recursion over
    separators."""
    return chunk.recursive_chunks(spread(_read(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


@query("SELECT DISTINCT lang, CASE lang WHEN 'fr' THEN 'fra_Latn' WHEN 'de' THEN 'deu_Latn' WHEN 'es' THEN 'spa_Latn' ELSE 'eng_Latn' END AS code FROM documents")
def translation_codes(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("lang", T.translation_code(F.col("lang")).alias("code")).distinct()


# --- Markdown headers, config references, offsets (C3, C5, X24, X39) ---


@query(r"""WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, string_split(replace(replace(text, '. ', chr(10) || '## '), ', ', chr(10) || '#### '), chr(10)) AS l FROM documents),
lines AS (SELECT rid, doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM rows),
parts AS (SELECT *, sum(regexp_matches(line, '^(#{2,6})\s+(.+)$')::INT) OVER (PARTITION BY rid ORDER BY n) AS part FROM lines)
SELECT doc_id, length(regexp_extract(arg_min(line, n), '^(#{2,6})\s+(.+)$', 1)) AS depth, trim(regexp_extract(arg_min(line, n), '^(#{2,6})\s+(.+)$', 2)) AS title, min(n) AS start_line, max(n) AS end_line,
 md5(string_agg(line, chr(10) ORDER BY n)) AS content_md5 FROM parts WHERE part > 0 GROUP BY rid, doc_id, part""")
def header_sections(spark, sf_dir):
    """Over the documents with each sentence and clause made a header."""
    docs = _read(spark, sf_dir, "documents").withColumn("text", F.replace(F.replace("text", F.lit(". "), F.lit("\n## ")), F.lit(", "), F.lit("\n#### ")))
    found = chunk.header_sections(docs, "doc_id", "text")
    return found.select("doc_id", F.col("depth").cast("long").alias("depth"), "title", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query()
def hybrid_chunks(spark, sf_dir):
    """Tested against the sections put together again: SQL has no recursion
    over separators."""
    return chunk.hybrid_chunks(_read(spark, sf_dir, "documents"), "doc_id", "text")


@query(r"""WITH pages AS (SELECT page_id, html || ' org.shop.Item' || page_id || ' "src/' || page_id || '.py" ' || url || '/blob/main' AS html FROM pages),
r AS (SELECT page_id, unnest(regexp_extract_all(html, '([a-z][a-z0-9_]*\.)+[A-Z][a-zA-Z0-9_]*')) AS name, 'class_reference' AS type FROM pages
UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '[''"]([^''"]*\.(?:py|js|ts|java|kt|go|rs|cpp|c|h|sh))[''"]', 1)), 'file_reference' FROM pages
UNION ALL SELECT page_id, unnest(regexp_extract_all(html, 'https?://[^\s"'']+(?:\.git|/blob/|/tree/)')), 'repository_url' FROM pages)
SELECT page_id, type, name, count(*) AS n FROM r GROUP BY ALL""")
def config_references(spark, sf_dir):
    """Over the pages, each with a class, a path and an address added."""
    page = F.col("page_id").cast("string")
    html = F.concat("html", F.lit(" org.shop.Item"), page, F.lit(' "src/'), page, F.lit('.py" '), "url", F.lit("/blob/main"))
    refs = _read(spark, sf_dir, "pages").select("page_id", F.explode(T.config_references(html)).alias("r")).select("page_id", "r.*")
    return refs.groupBy("page_id", "type", "name").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, 1 + len(list_filter(range(1, least(octet_length(encode(text)), n_chars // 2) + 1), lambda i: substr(hex(encode(text)), 2 * i - 1, 2) = '0A')) AS line
FROM documents""")
def line_offsets(spark, sf_dir):
    """The line of the byte at half of each document's length."""
    return _read(spark, sf_dir, "documents").select("doc_id", T.line_of_offset(F.col("text"), F.floor(F.col("n_chars") / 2)).cast("long").alias("line"))


# --- fetches, projects, checks, state (S11, S21, J19, J20, J22, F13) ---


@query("""WITH wanted AS (SELECT DISTINCT l_partkey AS id FROM lineitem), code AS (SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size > 25), docs AS (SELECT s_suppkey AS id, s_name AS name FROM supplier)
SELECT id, name, 'code' AS result_type FROM code WHERE id IN (FROM wanted) UNION ALL SELECT id, name, 'document' FROM docs WHERE id IN (FROM wanted) AND id NOT IN (SELECT id FROM code)""")
def entity_fetch(spark, sf_dir):
    code = _read(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    docs = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return tables.fetch(_read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")), code, docs)


@query("SELECT DISTINCT url AS file_path FROM pages WHERE url IS NOT NULL")
def indexed_files(spark, sf_dir):
    return tables.indexed_files(_read(spark, sf_dir, "pages").withColumnRenamed("url", "file_path"))


@query("""WITH q AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE 'p' || p_partkey END AS query FROM part),
p AS (SELECT 'p' || p_partkey AS project_id, p_brand AS name, p_size::BIGINT AS n, p_retailprice AS last FROM part),
m AS (SELECT query, project_id, 0 AS by_name, n, last FROM q JOIN p ON query = project_id UNION ALL SELECT query, project_id, 1, n, last FROM q JOIN p ON lower(query) = lower(name))
SELECT query, project_id FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY by_name, n DESC, last DESC, project_id DESC) = 1""")
def project_resolution(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    by_id = F.concat(F.lit("p"), "p_partkey")
    asked = part.select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(by_id).alias("query"))
    return tables.resolve(asked, part.select(by_id.alias("project_id"), F.col("p_brand").alias("name"), F.col("p_size").cast("long").alias("total_objects"), F.col("p_retailprice").alias("last_indexed")))


@query("""SELECT coalesce(c_custkey, o_custkey) AS project_id, coalesce(c_name, coalesce(c_custkey, o_custkey)::VARCHAR) AS name, coalesce(n, 0) AS total_objects
FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def registry_enrichment(spark, sf_dir):
    registry = _read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"))
    states = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(F.count("*").alias("total_objects"))
    return tables.enrich(registry, states)


@query("""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_returnflag = 'R' THEN 'checksum' END, CASE WHEN l_linenumber - 1 < 1 THEN 'start_line' END, CASE WHEN l_quantity < l_linenumber - 1 THEN 'end_line' END) AS problems
FROM lineitem WHERE l_returnflag = 'R' OR l_linenumber < 2 OR l_quantity < l_linenumber - 1""")
def invalid_rows(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").withColumns({"id": F.col("l_orderkey").cast("string"), "checksum": F.when(F.col("l_returnflag") != "R", "c"), "start_line": F.col("l_linenumber") - 1, "end_line": F.col("l_quantity")})
    return tables.invalid_rows(rows).select("l_orderkey", "l_linenumber", F.array_join("problems", ",").alias("problems"))


@query("SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 4 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS value FROM customer")
def stored_state(spark, sf_dir):
    """State written twice, the second time over a part of it, and read."""
    rows = _read(spark, sf_dir, "customer").withColumn("key", F.col("c_custkey").cast("string"))
    first = tables.set_state(rows.where("false").select("key", F.col("c_name").alias("value")), rows.where("c_custkey % 3 = 0").withColumn("value", F.col("c_mktsegment")))
    return tables.get_state(tables.set_state(first, rows.where("c_custkey % 4 = 0").withColumn("value", F.col("c_name"))), rows)


# --- relevance against expected results (A20, J23) ---

_EXPECTED = """truth AS (SELECT source AS query_id, CASE doc_id % 4 WHEN 0 THEN 'implementation' WHEN 1 THEN 'domain_model' WHEN 2 THEN 'documentation' ELSE 'context' END AS category,
 CASE WHEN quality = 1 THEN 'H1' ELSE 'H2' END AS priority, lang AS path, 'x::' || (doc_id % 50) AS symbol FROM documents JOIN labels USING (doc_id)),
results AS (SELECT DISTINCT source AS query_id, 'src/' || lang AS file_path, 'n' || (doc_id % 70) AS name FROM documents WHERE doc_id % 3 = 0),
near AS (SELECT * FROM results JOIN truth USING (query_id) WHERE contains(file_path, path)),
seen AS (SELECT query_id, max(category = 'implementation' AND contains(name, substr(symbol, 4))) AS i, max((category = 'domain_model' AND contains(name, symbol)) OR category = 'documentation') AS d,
 max(category = 'context') AS c, count(DISTINCT symbol) FILTER (priority = 'H1' AND contains(name, substr(symbol, 4))) AS hits FROM near GROUP BY 1),
symbols AS (SELECT query_id, count(*) FILTER (priority = 'H1') AS n FROM truth GROUP BY 1),
scored AS (SELECT query_id, coalesce(i, false)::BIGINT + coalesce(d, false)::BIGINT + coalesce(c OR i OR d, false)::BIGINT AS coverage, CASE WHEN n > 0 THEN coalesce(hits, 0) / n ELSE 0 END AS precision
 FROM (SELECT DISTINCT query_id FROM results) LEFT JOIN seen USING (query_id) LEFT JOIN symbols USING (query_id))"""


@query(f"WITH {_EXPECTED} SELECT query_id, coverage, round(precision, 6) AS precision, coverage >= 2 AND precision >= 0.3 AS passes FROM scored")
def relevance_gate(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    kinds = F.element_at(F.array(*map(F.lit, ("implementation", "domain_model", "documentation", "context"))), (F.col("doc_id") % 4 + 1).cast("int"))
    truth = docs.join(_read(spark, sf_dir, "labels"), "doc_id").select(
        F.col("source").alias("query_id"), kinds.alias("category"), F.when(F.col("quality") == 1, "H1").otherwise("H2").alias("priority"), F.col("lang").alias("path"), F.concat(F.lit("x::"), (F.col("doc_id") % 50).cast("string")).alias("symbol"))
    results = docs.where("doc_id % 3 = 0").select(F.col("source").alias("query_id"), F.concat(F.lit("src/"), "lang").alias("file_path"), F.concat(F.lit("n"), (F.col("doc_id") % 70).cast("string")).alias("name")).distinct()
    return tables.relevance(truth, results).withColumn("precision", F.round("precision", 6))


# --- small reports and folds (A19, L6, X45, W6, A15, C6) ---


@query("SELECT event_type, count(*) AS runs, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS average, round(count(*) / sum(value), 6) AS per_second FROM events GROUP BY 1")
def latency_summary(spark, sf_dir):
    return tables.latencies(_read(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY lower(c_name), c_custkey) AS place FROM customer QUALIFY place <= 100")
def project_list(spark, sf_dir):
    """The first hundred names in order: the limit is the feature."""
    first = _read(spark, sf_dir, "customer").orderBy(F.lower("c_name"), "c_custkey").limit(100)
    return first.select("c_custkey", "c_name", F.row_number().over(Window.orderBy(F.lower("c_name"), "c_custkey")).cast("long").alias("place"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, ts = strptime(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '%Y-%m-%dT%H:%M:%S.%f') AS same FROM events")
def iso_times(spark, sf_dir):
    """Times written as ISO 8601 text and read back."""
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    back = F.to_timestamp(F.date_format("ts", iso + ".SSSSSS"), iso + ".SSSSSS")
    return _read(spark, sf_dir, "events").select("event_id", F.date_format("ts", iso).alias("iso"), (back.cast("timestamp") == F.col("ts").cast("timestamp")).alias("same"))


@query()
def merged_chunks(spark, sf_dir):
    """Sections of documents with small neighbours merged; tested against a
    fold over lists."""
    pieces = chunk.recursive_chunks(_read(spark, sf_dir, "documents"), "doc_id", "text").withColumns({"path": F.col("chunk_index").cast("string"), "keys": F.array(F.left("content", F.lit(8)))})
    return chunk.merge_small(pieces, "doc_id")


@query()
def heading_chunks(spark, sf_dir):
    """Tested against a fold over lines."""
    return chunk.heading_chunks(_read(spark, sf_dir, "documents"), "doc_id", "text")


# --- the stored index (J16, S21, S23) ---

_ASKED = f"""{_POSTED},
asked AS (SELECT item_id AS query_id, unnest({_tokens("text")}) AS t FROM benchmark WHERE item_id % 100 = 0),
terms AS (SELECT query_id, {_HASH.format("t")} AS token_hash, count(*) AS qtf FROM asked GROUP BY 1, 2),
found AS (SELECT query_id, id, sum(weight * qtf * idf) AS score FROM posted JOIN terms USING (token_hash) JOIN idf USING (token_hash) GROUP BY 1, 2)"""


@query(f"WITH {_ASKED} SELECT query_id, id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY found.score DESC, id) AS rank, round(score, 6) AS score FROM found QUALIFY rank <= 10")
def indexed_search(spark, sf_dir):
    """The ten best documents for every benchmark item with an id divisible by
    100, from a stored index.  The index is first written with older texts and
    without some documents, and then brought up to date in its buckets."""
    docs = spread(_read(spark, sf_dir, "documents").select("doc_id", *FIELDS))
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    index = PostingsIndex(spark, f"{root.rstrip('/')}/index-{uuid.uuid4().hex}", buckets=32)
    older = docs.where("doc_id % 13 <> 0").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" older words"))).otherwise(F.col("text")))
    index.write(keyword.postings(older, "doc_id", FIELDS, capitals=True), older.count())
    changed = docs.where("doc_id % 10 = 0 or doc_id % 13 = 0")
    state = index.replace(changed.select(F.col("doc_id").alias("id")), keyword.postings(changed, "doc_id", FIELDS, capitals=True), docs.count())
    terms = keyword.query_terms(_read(spark, sf_dir, "benchmark").where("item_id % 100 = 0"), "item_id", "text", True)
    best = ranking.top_k(keyword.keyword_scores(index.lookup(terms), terms, state["total"]), 10, ["query_id"])
    return best.select("query_id", F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


# --- lines by a budget, large classes, references, names alike (C7, C14, C15, J21, W8, X23) ---

_PACKED = """WITH RECURSIVE l AS (SELECT rid, doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce({text}, ''), chr(10)) AS l FROM documents)),
f AS (SELECT rid, i, 0 AS chunk, {cost} AS held FROM l WHERE i = 1
 UNION ALL SELECT l.rid, l.i, chunk + (held + {cost} - {free} > {budget})::INT, CASE WHEN held + {cost} - {free} > {budget} THEN 0 ELSE held END + {cost} FROM f JOIN l ON l.rid = f.rid AND l.i = f.i + 1)"""


@query(_PACKED.format(text="replace(text, '. ', chr(10))", cost="(length(line) // 4)", free=0, budget=64) + """
SELECT doc_id, chunk AS chunk_index, min(i) AS start_line, max(i) AS end_line, sum(length(line) // 4)::BIGINT AS token_count, 'Lines ' || min(i) || '-' || max(i) AS name, md5(string_agg(line, chr(10) ORDER BY i)) AS content_md5
FROM f JOIN l USING (rid, i) GROUP BY rid, doc_id, chunk""")
def line_chunks(spark, sf_dir):
    """The documents' sentences as lines, packed by 64 tokens."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("\n")).alias("text"))
    found = lines.line_chunks(docs, "doc_id", "text", 64)
    return found.select("doc_id", "chunk_index", *[F.col(c).cast("long").alias(c) for c in ("start_line", "end_line", "token_count")], "name", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(_PACKED.format(text="text", cost="(length(line) + 1)", free=1, budget=1500) + """, whole AS (SELECT rid, sum(length(line) + 1) - 1 AS n FROM l GROUP BY 1),
chunks AS (SELECT rid, doc_id, CASE WHEN n <= 1500 THEN 0 ELSE chunk END AS chunk, n, sum(length(line) + 1) AS width, md5(string_agg(line, chr(10) ORDER BY i)) AS content_md5 FROM f JOIN l USING (rid, i) JOIN whole USING (rid) GROUP BY 1, 2, 3, 4)
SELECT doc_id, chunk AS chunk_index, (sum(width) OVER w - width)::BIGINT AS start, least(sum(width) OVER w, n)::BIGINT AS "end", content_md5 FROM chunks WINDOW w AS (PARTITION BY rid ORDER BY chunk)""")
def config_chunks(spark, sf_dir):
    found = lines.config_chunks(_read(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "chunk_index", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey + 1 AS n FROM supplier),
m AS (SELECT s_suppkey, n, unnest(range(1, n + 1)) AS i FROM s)
SELECT s_suppkey, 'S' || s_suppkey AS name, n > 20 AS is_summary, md5(CASE WHEN n > 20 THEN 'class S' || s_suppkey || ':' || chr(10) || chr(10) || 'About it.' || chr(10) || chr(10) || 'size = ' || n || chr(10) || chr(10) || string_agg('def m' || i || '(self, x)', chr(10) || chr(10) ORDER BY i)
 ELSE 'class S' || s_suppkey || ':' || chr(10) || '    ' || repeat(chr(34), 3) || 'About it.' || repeat(chr(34), 3) || chr(10) || '    size = ' || n || chr(10) || string_agg('    def m' || i || '(self, x):' || chr(10) || '        y = x + ' || i || chr(10) || '        return y', chr(10) ORDER BY i) END) AS content_md5
FROM m GROUP BY s_suppkey, n UNION ALL SELECT s_suppkey, 'm' || i, false, md5('    def m' || i || '(self, x):' || chr(10) || '        y = x + ' || i || chr(10) || '        return y') FROM m""")
def class_chunks(spark, sf_dir):
    """For each supplier a Python class of one to 25 methods."""
    n = F.col("s_nationkey") + 1
    body = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), n.cast("long")), lambda i: F.concat(F.lit("    def m"), i.cast("string"), F.lit("(self, x):\n        y = x + "), i.cast("string"), F.lit("\n        return y"))), "\n")
    text = F.concat(F.lit("class S"), F.col("s_suppkey").cast("string"), F.lit(':\n    """About it."""\n    size = '), n.cast("string"), F.lit("\n"), body)
    files = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("file_path"), F.lit("python").alias("language"), text.alias("content"))
    found = extract.objects(extract.split_classes(extract.extract(spread(files))))
    return found.select(F.col("file_path").cast("long").alias("s_suppkey"), "name", "is_summary", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query()
def markdown_references(spark, sf_dir):
    """Over the documents with clauses in back-ticks and sentences linked to
    files; tested against a plain scan, as SQL's patterns tell no places."""
    text = F.replace(F.replace("text", F.lit(", "), F.lit("`")), F.lit(". "), F.lit("\n```\n[see](a.py)"))
    return references.markdown_references(_read(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id", "text")


@query()
def similar_projects(spark, sf_dir):
    """Addresses like those of every hundredth page; tested against all pairs
    with the exact ratio, which SQL does not have."""
    pages = _read(spark, sf_dir, "pages")
    return fuzzy.similar(pages.where("page_id % 100 = 0").select(F.col("url").alias("query")), pages.select(F.col("page_id").cast("string").alias("project_id"), F.col("url").alias("name")))


# --- language of prose, dependencies, layers of settings, parse quality (A14, F17, X32, X40, X43) ---


@query(r"""WITH g AS (SELECT row_number() OVER () AS rid, doc_id, lang, '_' || regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', '_', 'g') || '_' AS p FROM documents),
t AS (SELECT rid, doc_id, lang, unnest(regexp_extract_all(p, '...') || regexp_extract_all(substr(p, 2), '...') || regexp_extract_all(substr(p, 3), '...')) AS gram FROM g),
k AS (SELECT lang AS language, gram, 401 - row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS weight FROM t WHERE doc_id % 2 = 0 AND lang IN ('de', 'en', 'es', 'fr') GROUP BY 1, 2 QUALIFY weight > 0),
s AS (SELECT rid, language, sum(weight)::BIGINT AS score FROM t JOIN k USING (gram) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY rid ORDER BY sum(weight) DESC, language) = 1)
SELECT doc_id, coalesce(language, 'en') AS language, coalesce(score, 0) AS score FROM g LEFT JOIN s USING (rid)""")
def detected_languages(spark, sf_dir):
    """Profiles from the documents with even ids, applied to all."""
    docs = spread(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    languages = ("de", "en", "es", "fr")
    return prose.languages_of(docs, "doc_id", "text", prose.profiles(docs.where("doc_id % 2 = 0"), "text", "lang", languages), languages)


@query("""WITH c AS (SELECT c_custkey, c_custkey::VARCHAR AS k, c_nationkey::VARCHAR AS n, (c_custkey % 7)::VARCHAR AS v, c_custkey % 2 = 0 AS j FROM customer)
SELECT c_custkey, 'lib' || n AS name, '^1.' || v AS version, 'dependencies' AS scope FROM c WHERE j UNION ALL SELECT c_custkey, 'own', v, 'dependencies' FROM c WHERE j
UNION ALL SELECT c_custkey, 'test' || v, '~2', 'devDependencies' FROM c WHERE j
UNION ALL SELECT c_custkey, 'lib' || k, 'unspecified', 'dependencies' FROM c WHERE NOT j UNION ALL SELECT c_custkey, 'n' || n, '1.' || v, 'dependencies' FROM c WHERE NOT j
UNION ALL SELECT c_custkey, 'unknown', v, 'dependencies' FROM c WHERE NOT j UNION ALL SELECT c_custkey, 'x', 'unspecified', 'packages' FROM c WHERE NOT j""")
def declared_dependencies(spark, sf_dir):
    """For each customer a project file, of JSON or YAML in turn."""
    npm = '{"name": "p%1$d", "dependencies": {"lib%2$d": "^1.%3$d", "own": %3$d}, "devDependencies": {"test%3$d": "~2"}, "peerDependencies": "none"}'
    yaml = "name: p%1$d\ndependencies:\n  - lib%1$d\n  - name: n%2$d\n    version: '1.%3$d'\n  - version: %3$d\n  - [a, b]\nrequires: none\npackages: [x]\n"
    values = ["c_custkey", "c_nationkey", F.col("c_custkey") % 7]
    text = F.when(F.col("c_custkey") % 2 == 0, F.format_string(npm, *values)).otherwise(F.format_string(yaml, *values))
    return config.dependencies(_read(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text")


@query("""WITH m AS (SELECT o_orderkey, json_merge_patch(json_merge_patch('{"store": {"url": "u", "size": {"w": 1, "h": 2}}, "log": "on"}', '{"store": {"name": "' || o_orderpriority || '", "size": {"h": ' || o_custkey || '}}}'),
 CASE WHEN o_orderkey % 3 = 0 THEN '{"log": {"level": ' || o_orderkey || '}, "store": {"size": {"d": 3}}}' ELSE '{"store": {"url": "v"}}' END) AS j FROM orders)
SELECT o_orderkey, j ->> '$.store.url' AS url, j ->> '$.store.name' AS name, (j ->> '$.store.size.w')::BIGINT AS w, (j ->> '$.store.size.h')::BIGINT AS h, (j ->> '$.store.size.d')::BIGINT AS d, coalesce(j ->> '$.log.level', j ->> '$.log') AS log FROM m""")
def merged_settings(spark, sf_dir):
    """Three layers of settings for each order: defaults, its own, and some for
    every third."""
    own = F.format_string('{"store": {"name": "%s", "size": {"h": %d}}}', "o_orderpriority", "o_custkey")
    third = F.when(F.col("o_orderkey") % 3 == 0, F.format_string('{"log": {"level": %d}, "store": {"size": {"d": 3}}}', "o_orderkey")).otherwise('{"store": {"url": "v"}}')
    merged = _read(spark, sf_dir, "orders").select("o_orderkey", config.deep_merge(F.array(F.lit('{"store": {"url": "u", "size": {"w": 1, "h": 2}}, "log": "on"}'), own, third)).alias("j"))
    at = lambda path: F.get_json_object("j", f"$.{path}")
    return merged.select("o_orderkey", at("store.url").alias("url"), at("store.name").alias("name"), *[at(f"store.size.{c}").cast("long").alias(c) for c in "whd"], F.coalesce(at("log.level"), at("log")).alias("log"))


@query("""WITH f AS (SELECT s_suppkey, s_nationkey AS errors, s_nationkey + 9 * (s_suppkey % 3) AS total FROM supplier)
SELECT s_suppkey, errors::BIGINT AS error_nodes, total::BIGINT AS total_nodes, CASE WHEN total = 0 THEN 1 ELSE round(1 - errors / total, 6) END AS valid_ratio, errors = 0 OR 1 - errors / total >= 0.5 AS readable FROM f""")
def parse_quality_gate(spark, sf_dir):
    """For each supplier a Python file of up to two functions and up to 24
    lines that do not parse."""
    good = F.repeat(F.lit("def f(x):\n    return x + 1\n"), (F.col("s_suppkey") % 3).cast("int"))
    files = _read(spark, sf_dir, "supplier").select("s_suppkey", F.lit("python").alias("language"), F.concat(good, F.repeat(F.lit("x = = 1\n"), F.col("s_nationkey").cast("int"))).alias("content"))
    measured = parse_quality.parse_metrics(files).select("s_suppkey", "error_nodes", "total_nodes", "has_errors", "valid_ratio")
    kept = parse_quality.readable(measured).select("s_suppkey").distinct().withColumn("readable", F.lit(True))
    return measured.join(kept, "s_suppkey", "left").select("s_suppkey", "error_nodes", "total_nodes", F.round("valid_ratio", 6).alias("valid_ratio"), F.coalesce("readable", F.lit(False)).alias("readable"))


# --- nodes of documents and stored rows (C4, C12, F9, F15, F16) ---


@query()
def markdown_nodes(spark, sf_dir):
    """The documents as Markdown of many headers; tested against a plain fold,
    as SQL has no recursive chunks."""
    text = F.concat(F.lit("# "), "lang", F.lit("\n"), F.replace("text", F.lit(". "), F.lit("\n## ")))
    files = _read(spark, sf_dir, "documents").select(F.format_string("/src/%d.md", "doc_id").alias("file_path"), F.format_string("%d.md", "doc_id").alias("relative_path"), text.alias("content"))
    return nodes.markdown_nodes(files).drop("created_at", "updated_at", "metadata", "language")


@query("""WITH c AS (SELECT c_custkey, c_custkey || '.' || CASE WHEN c_custkey % 2 = 0 THEN 'json' ELSE 'yaml' END AS f, CASE WHEN c_custkey % 2 = 0 THEN 'json' ELSE 'yaml' END AS k, chr(10) AS n FROM customer),
t AS (SELECT c.*, c_nationkey AS m, '{' || n || '  "port": ' || c_custkey || ',' || n || '  "host": "${HOST_' || c_nationkey || '}"' || n || '}' || n || n || '"on"' AS content FROM c JOIN customer USING (c_custkey))
SELECT '/etc/' || f AS file_path, left(sha256(f || ':config:0'), 32) AS deterministic_id, 0 AS chunk_index, 1 AS total_chunks, 'server + log' AS title, 1 AS start_line, 1 AS end_line, md5(content) AS content_md5,
 'log,server.host,server.port' AS config_keys, k AS config_format, 'HOST_' || m AS env_references, 1 AS section_depth FROM t""")
def config_nodes(spark, sf_dir):
    """For each customer a config file of two sections, JSON or YAML in turn."""
    kind = F.when(F.col("c_custkey") % 2 == 0, "json").otherwise("yaml")
    text = F.when(kind == "json", F.format_string('{"server": {"port": %d, "host": "${HOST_%d}"}, "log": "on"}', "c_custkey", "c_nationkey")).otherwise(F.format_string('server:\n  port: %d\n  host: "${HOST_%d}"\nlog: "on"\n', "c_custkey", "c_nationkey"))
    name = F.concat(F.col("c_custkey").cast("string"), F.lit("."), kind)
    files = _read(spark, sf_dir, "customer").select(F.concat(F.lit("/etc/"), name).alias("file_path"), name.alias("relative_path"), kind.alias("config_format"), text.alias("content"))
    joined = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return nodes.config_nodes(spread(files)).select("file_path", "deterministic_id", "chunk_index", "total_chunks", "title", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("content_md5"), joined("config_keys"), "config_format", joined("env_references"), "section_depth")


def _document_nodes(spark, sf_dir) -> DataFrame:
    """Every document as a node, Markdown or config in turn."""
    docs = _read(spark, sf_dir, "documents").withColumns({"lang": F.coalesce("lang", F.lit("")), "even": F.col("doc_id") % 2 == 0, "relative_path": F.format_string("../d/%d.md", "doc_id")})
    n = lambda k: (F.col("doc_id") % k).cast("int")
    kind, at = F.when(F.col("even"), "markdown").otherwise("config"), F.to_timestamp(F.lit("2024-01-02 03:04:05.5"))
    return docs.select(
        F.concat(F.lit("/src/"), "relative_path").alias("file_path"), "relative_path", kind.alias("node_type"), F.col("text").alias("content"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("checksum"),
        nodes.node_id(F.col("relative_path"), kind, n(4)).alias("deterministic_id"), n(4).alias("chunk_index"), F.lit(4).alias("total_chunks"), F.lit(None).cast("string").alias("parent_doc_id"), F.when(n(3) > 0, F.col("lang")).alias("title"),
        F.when(n(5) > 0, n(50)).alias("start_line"), F.when(n(5) > 0, n(50) + 2).alias("end_line"), F.col("lang").alias("language"), F.when(F.col("even"), F.array(F.struct(F.col("lang").alias("name"), F.lit("class").alias("type")))).alias("related_code"),
        F.when(~F.col("even"), F.array(F.lit("a"), "lang")).alias("config_keys"), F.when(~F.col("even"), "yaml").alias("config_format"), F.when(n(4) == 1, F.array(F.lit("HOME"))).alias("env_references"), F.when(~F.col("even"), n(3)).alias("section_depth"),
        F.when(n(7) == 0, F.create_map(F.lit("k"), F.col("lang"))).alias("metadata"), at.alias("created_at"), at.alias("updated_at"),
    )


_STORED = """WITH d AS (SELECT doc_id AS i, coalesce(lang, '') AS l, text, doc_id % 2 = 0 AS even, '../d/' || doc_id || '.md' AS p FROM documents),
t AS (SELECT *, CASE WHEN i % 3 > 0 AND l <> '' THEN l END AS title_, CASE WHEN even THEN 'markdown' ELSE 'config' END AS k FROM d),
stored AS (SELECT 'document' AS type, k AS node_type, 'document' AS object_type, coalesce(title_, i || '.md') AS name, p || coalesce('#' || title_, '') AS qualified_name, coalesce(title_, '') AS title, '' AS signature, left(coalesce(text, ''), 200) AS docstring, text AS content,
 '/src/' || p AS file_path, p AS relative_path, (CASE WHEN i % 5 > 0 THEN i % 50 ELSE 0 END)::INT AS start_line, (CASE WHEN i % 5 > 0 THEN i % 50 + 2 ELSE 0 END)::INT AS end_line, md5(coalesce(text, '')) AS checksum, l AS language, (i % 4)::INT AS chunk_index, 4 AS total_chunks, '' AS parent_doc_id,
 left(sha256(p || ':' || k || ':' || i % 4), 32) AS deterministic_id, CASE WHEN even THEN '[{"name":"' || l || '","type":"class"}]' ELSE '[]' END AS related_code, CASE WHEN even THEN '[]' ELSE '["a","' || l || '"]' END AS config_keys, CASE WHEN even THEN '' ELSE 'yaml' END AS config_format,
 CASE WHEN i % 4 = 1 THEN '["HOME"]' ELSE '[]' END AS env_references, CASE WHEN even THEN '0' ELSE (i % 3)::VARCHAR END AS section_depth, CASE WHEN i % 7 = 0 THEN '{"k":"' || l || '"}' ELSE '{}' END AS custom_metadata, '2024-01-02T03:04:05.500000' AS created_at, '2024-01-02T03:04:05.500000' AS updated_at FROM t)"""


@query(f"{_STORED} SELECT * FROM stored")
def document_payloads(spark, sf_dir):
    """Read back into nodes once, and stored again."""
    return nodes.document_payload(nodes.document_nodes(nodes.document_payload(_document_nodes(spark, sf_dir))))


@query(f"""{_STORED} SELECT deterministic_id, CASE WHEN title = '' THEN string_split(file_path, '/')[-1] ELSE title END AS name, title, node_type, chunk_index, total_chunks, start_line, end_line, regexp_replace(relative_path, '^\\.\\./', '') AS relative_path,
 CASE node_type WHEN 'markdown' THEN related_code END AS related_code, CASE node_type WHEN 'config' THEN config_keys END AS config_keys, CASE node_type WHEN 'config' THEN env_references END AS env_references, CASE node_type WHEN 'config' THEN section_depth END AS section_depth, CASE node_type WHEN 'config' THEN config_format END AS config_format FROM stored""")
def shown_documents(spark, sf_dir):
    shown = nodes.shown_documents(nodes.document_payload(_document_nodes(spark, sf_dir)), "deterministic_id")
    return shown.withColumns({c: F.to_json(c) for c in ("related_code", "config_keys", "env_references")})


@query("""SELECT 'code' AS type, 'class' AS object_type, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_brand || '.' || p_name ELSE '' END AS qualified_name, '' AS signature, p_type AS docstring, p_name || chr(10) || p_type AS content, '/s/' || p_partkey AS file_path, p_partkey::VARCHAR AS relative_path, p_size AS start_line, p_size + 1 AS end_line,
 md5(p_name) AS checksum, 'python' AS language, p_size AS token_count, 2 AS unique_token_count, p_retailprice AS score_weight, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS parent_id, left(sha256(p_partkey || ':' || p_name), 32) AS deterministic_id, 'v1' AS embedding_model_version, CASE WHEN p_size % 5 = 0 THEN '{"calls":["' || p_brand || '"]}' ELSE '' END AS ast_metadata,
 '2024-01-02T00:00:00.000000' AS created_at, '2024-01-02T00:00:00.000000' AS updated_at FROM part""")
def object_payloads(spark, sf_dir):
    """Each part as a code object: stored, read back, and stored again."""
    size, at, key = F.col("p_size"), F.to_timestamp(F.lit("2024-01-02 00:00:00")), F.col("p_partkey").cast("string")
    made = {
        "object_type": F.lit("class"), "name": F.col("p_name"), "qualified_name": F.when(size % 2 == 0, F.concat("p_brand", F.lit("."), "p_name")), "signature": F.lit(None).cast("string"), "docstring": F.col("p_type"), "content": F.concat("p_name", F.lit("\n"), "p_type"),
        "file_path": F.concat(F.lit("/s/"), key), "relative_path": key, "start_line": size, "end_line": size + 1, "checksum": F.md5(F.col("p_name").cast("binary")), "language": F.lit("python"), "token_count": size, "unique_token_count": F.lit(2), "score_weight": F.col("p_retailprice"),
        "parent_id": F.when(size % 3 != 0, F.col("p_brand")), "deterministic_id": T.object_id(key, F.col("p_name")), "embedding_model_version": F.lit("v1"), "ast_metadata": F.when(size % 5 == 0, F.format_string('{"calls":["%s"]}', "p_brand")), "created_at": at, "updated_at": at,
    }
    objects = _read(spark, sf_dir, "part").select(*[c.alias(name) for name, c in made.items()])
    return nodes.object_payload(nodes.code_objects(nodes.object_payload(objects)))
