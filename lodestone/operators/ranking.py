"""Ranks, fusion, boosts and diversity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokenize import tokens
from ..functions.vector import bound, finite, normalised
from ..sources.tables import spread

# --- fixed values: boosts and fusion constants ---
TYPE_BOOST = {"class": 0.12, "method": 0.10, "function": 0.10, "enum": 0.08, "interface": 0.06}
RRF_K = 60
DENSE_SHARE, SPARSE_SHARE = 7.0, 3.0
# --- end of fixed values ---

#: Query vectors that are broadcast together, about, and results that a task holds for them; more go in slices.
SLICE_QUERIES, SLICE_RESULTS = 100_000, 1_000_000
#: Rows and query vectors that meet at a time.
BLOCK_ROWS, BLOCK_QUERIES = 1024, 2048
#: Pairs that are scored exactly at a time.
EXACT_PAIRS = 1 << 14


def nearest(rows: DataFrame, key: str, vector: str, queries: DataFrame, k: int, query_key: str = "query_id") -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` rows nearest to each query by
    cosine, ties by id; vectors with NaN or infinities are left out, and a
    vector meets queries of its own length only.

    The queries, a stated set, are broadcast, so that each row meets them in its
    own task; beyond ``SLICE_QUERIES`` of them, a slice after the other, by a
    hash of their id.  Vectors are scaled to length one before they meet.  All
    pairs meet as products of matrices; those that come within rounding of a
    query's best ``k`` so far are scored again by sums in the order of the
    components, and these scores alone decide.  Only the rows' best are
    shuffled: each task keeps ``k`` per query before the final rank.
    """
    slices = -(-queries.count() // max(1, min(SLICE_QUERIES, SLICE_RESULTS // k)))
    held = queries.select(F.col(query_key).alias("query_id"), F.col(vector).alias("qv")).where(finite(F.col("qv"))).withColumn("qv", normalised(F.col("qv")))
    scaled = spread(rows.select(F.col(key).alias("id"), F.col(vector).alias("v"))).where(finite(F.col("v"))).withColumn("v", normalised(F.col("v")))
    schema = f"place int, id {scaled.schema['id'].dataType.simpleString()}, score double"
    found = None
    for k_ in range(max(1, slices)):
        some = held.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == k_) if slices > 1 else held
        asked = some.toArrow()
        places = rows.sparkSession.createDataFrame(asked.select(["query_id"]).append_column("place", pa.array(np.arange(asked.num_rows, dtype=np.int32))))
        near = scaled.mapInArrow(_best(rows.sparkSession.sparkContext.broadcast(_by_length(asked["qv"])), k), schema)
        best = top_k(near.join(F.broadcast(places), "place").select("query_id", "id", "score"), k, ["query_id"])
        found = best if found is None else found.unionByName(best)
    return found


def _by_length(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length, the places of the vectors of that length and a matrix of them."""
    sizes = np.asarray(pc.list_value_length(vectors), dtype=np.int64)
    flat, ends = np.asarray(pc.list_flatten(vectors), dtype=np.float64), np.cumsum(sizes)
    return {int(n): (at := np.flatnonzero(sizes == n), flat[(ends[at] - n)[:, None] + np.arange(n)]) for n in np.unique(sizes)}


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The dot product of each row of ``a`` and of ``b``, summed from the first component on."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += x * y
    return total


def _best(shared, k: int):
    """A function of batches of ``id, v`` that gives the best ``k`` rows of
    each query: ``place, id, score``."""
    order = [("place", "ascending"), ("score", "descending"), ("id", "ascending")]

    def cut(table: pa.Table) -> pa.Table:
        """The best ``k`` of each place; null ids come first, as in Spark."""
        table = table.take(pc.sort_indices(table, order, null_placement="at_start"))
        place = np.asarray(table["place"])
        first = np.searchsorted(place, place, "left")
        return table.filter(pa.array(np.arange(len(place)) - first < k))

    def run(batches):
        queries, best = shared.value, None
        total = sum(len(at) for at, _ in queries.values())
        least = {n: np.full(len(at), -np.inf) for n, (at, _) in queries.items()}
        for batch in batches:
            ids, vectors = batch.column(0), _by_length(pa.chunked_array([batch.column(1)]))
            for n, (rows, v) in vectors.items():
                if n not in queries:
                    continue
                places, q = queries[n]
                slack = 1e-15 * (n + 1)
                for i in range(0, len(v), BLOCK_ROWS):
                    for j in range(0, len(q), BLOCK_QUERIES):
                        block, own = v[i : i + BLOCK_ROWS], least[n][j : j + BLOCK_QUERIES]
                        scores = block @ q[j : j + BLOCK_QUERIES].T
                        bound = own
                        if len(block) > k and np.isneginf(own).any():
                            bound = np.maximum(own, np.partition(scores, len(block) - k, axis=0)[len(block) - k])
                        r, c = np.nonzero(scores >= bound - 2 * slack)
                        if not len(r):
                            continue
                        for x in range(0, len(r), EXACT_PAIRS):
                            a, b = r[x : x + EXACT_PAIRS], c[x : x + EXACT_PAIRS]
                            table = pa.table({"place": pa.array(places[j + b], pa.int32()), "id": ids.take(pa.array(rows[i + a])), "score": _exact(block[a], q[j + b])})
                            table = cut(table)
                            best = table if best is None else pa.concat_tables([best, table])
                        if best.num_rows > 2 * k * total or np.isneginf(own).any() or len(r) > EXACT_PAIRS:
                            best = cut(best.combine_chunks())
                            counts = np.bincount(np.asarray(best["place"]), minlength=total)
                            full = counts == k
                            kth = np.full(total, -np.inf)
                            kth[full] = np.asarray(best["score"])[np.cumsum(counts)[full] - 1]
                            for m, (at, _) in queries.items():
                                least[m] = np.maximum(least[m], kth[at])
        if best is not None:
            yield from cut(best.combine_chunks()).combine_chunks().to_batches(max_chunksize=1 << 16)

    return run


def top_k(scored: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The best ``k`` rows of each group by score, ties by id, with ``rank``.
    Spark keeps ``k`` per group and task before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse_ranks(branches: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: ``query_id, id, score``, the sum of 1/(k+rank)."""
    union = branches[0].select("query_id", "id", "rank")
    for b in branches[1:]:
        union = union.unionByName(b.select("query_id", "id", "rank"))
    return union.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def normalised_scores(scored: DataFrame) -> DataFrame:
    """Scores of each query mapped to 0..1 over three standard deviations on
    either side of the mean; 0.5 where all are equal."""
    w = Window.partitionBy("query_id")
    s = F.stddev_pop("score").over(w)
    z = (F.col("score") - F.avg("score").over(w)) / s
    return scored.withColumn("score", F.when(s == 0, 0.5).otherwise(F.least(F.greatest((z + 3) / 6, F.lit(0.0)), F.lit(1.0))))


def fuse_distributions(branches: list[DataFrame]) -> DataFrame:
    """Sum of each branch's normalised scores: ``query_id, id, score``."""
    union = None
    for b in branches:
        one = normalised_scores(b.select("query_id", "id", "score"))
        union = one if union is None else union.unionByName(one)
    return union.groupBy("query_id", "id").agg(F.sum("score").alias("score"))


def prefetch(limit: int) -> tuple[int, int]:
    """How many candidates the dense and the sparse branch give."""
    return int(DENSE_SHARE * limit), int(SPARSE_SHARE * limit)


def name_boost(query: Column, name: Column, qualified: Column) -> Column:
    """The first that holds: the query is the name; it is part of the
    qualified name; all name tokens are in the query; all query tokens are in
    the name; else by the share of query tokens in the name.  The name is
    lower-cased before it is split."""
    own = F.struct(
        F.lower(F.trim(query)).alias("q"), F.lower(name).alias("n"), F.lower(F.coalesce(qualified, F.lit(""))).alias("full"),
        F.array_distinct(tokens(query)).alias("qt"), F.array_distinct(tokens(F.lower(name))).alias("nt"),
    )

    def boost(x: Column) -> Column:
        some = (F.size(x["qt"]) > 0) & (F.size(x["nt"]) > 0)
        both = F.size(F.array_intersect(x["qt"], x["nt"]))
        return (
            F.when(x["q"] == x["n"], 0.25)
            .when(F.contains(x["full"], x["q"]), 0.20)
            .when(some & (F.size(F.array_except(x["nt"], x["qt"])) == 0), 0.15)
            .when(some & (F.size(F.array_except(x["qt"], x["nt"])) == 0), 0.12)
            .when(some & (both > 0), F.lit(0.05) * both / F.size(x["qt"]))
            .otherwise(F.lit(0.0))
        )

    return bound(own, boost)


def type_boost(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, boost in TYPE_BOOST.items():
        out = F.when(F.lower(kind) == name, boost).otherwise(out)
    return out


def boosted(results: DataFrame, query: Column) -> DataFrame:
    """``score * (1 + type + name boost) * weight``; needs ``object_type, name,
    qualified_name, score_weight``."""
    final = F.col("score") * (1 + type_boost(F.col("object_type")) + name_boost(query, F.col("name"), F.col("qualified_name"))) * F.coalesce("score_weight", F.lit(1.0))
    return results.withColumn("score", final)


def diverse(results: DataFrame, keep_first: int, per_code_file: int = 2, per_document: int = 1) -> DataFrame:
    """The first ``keep_first`` results of each query, then at most so many
    further ones of each file; the first ones do not count against a file.
    Needs ``query_id, id, score, result_type, file_path``."""
    ranked = results.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    later = F.col("position") > keep_first
    nth = F.sum(F.when(later, 1).otherwise(0)).over(Window.partitionBy("query_id", "result_type", "file_path").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    most = F.when(F.col("result_type") == "code", per_code_file).otherwise(per_document)
    return ranked.withColumn("nth", nth).where(~later | (F.col("nth") <= most)).drop("nth")
