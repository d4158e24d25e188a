"""Centroid clustering in integers, each round of which does what changed.

Every vector's cluster and distance are kept in a written table, and the
clusters' sums and counts on the driver.  After centroids have moved, a vector
whose own centroid stands where it stood is compared with the moved centroids
alone; one whose own centroid moved is compared with all.  Vectors that change
clusters take their components along: the sums are brought up to date by adding
up these signed transfers, not by summing all vectors again.

All arithmetic is on integers, so that results do not hang on the order of
addition.  The driver sees ``k`` sums and ``k`` centroids, never vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, only, written

#: Components have to be smaller, so that squared distances of 64 of them fit 64 bits.
COMPONENT_LIMIT = 1 << 27

STATE = "vec_id long, v array<int>, cluster int, distance long, was int"


def integer_vectors(embeddings: DataFrame, dimension: int = 64, scale: int = 1024) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of the components of those vectors that
    have ``dimension`` of them, none null, NaN or infinite."""
    rows = only(embeddings, vec_id="vec_id", embedding="embedding").withColumn("d", F.transform("embedding", lambda x: x.cast("double")))
    sound = (F.size("d") == dimension) & F.forall("d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    part = lambda x: F.when(F.abs(x * scale) >= COMPONENT_LIMIT, F.raise_error(F.lit("a component is too large for distances of 64 bits"))).otherwise(F.floor(x * scale)).cast("int")
    return rows.where(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform("d", part).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[np.ndarray]:
    """The ``k`` vectors of the least sha256 of ``seed:vec_id``, in this order;
    a null id counts as empty text, ties go by the components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [np.array(r.v, np.int64) for r in rows]


def _assigned(state: DataFrame, centroids: list[np.ndarray], moved: set[int]) -> DataFrame:
    """``state`` with every vector's nearest centroid (ties: the smaller
    number) and its distance; ``was`` is the cluster before."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.asarray(column(batch, "v").flatten()).reshape(batch.num_rows, -1).astype(np.int64)
            was = np.asarray(column(batch, "cluster"))
            stale = np.isin(was, [-1, *moved])
            distance = np.where(stale, np.iinfo(np.int64).max, np.asarray(column(batch, "distance")))
            cluster = np.where(stale, len(centroids), was)
            for j, c in enumerate(centroids):
                rows = np.arange(len(v)) if j in moved else np.flatnonzero(stale)
                d = ((v[rows] - c) ** 2).sum(axis=1)
                nearer = (d < distance[rows]) | ((d == distance[rows]) & (j < cluster[rows]))
                distance[rows[nearer]], cluster[rows[nearer]] = d[nearer], j
            out = [column(batch, "vec_id"), column(batch, "v"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(was.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "v", "cluster", "distance", "was"])

    return state.mapInArrow(run, STATE)


def _transfers(state: DataFrame, k: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """What each cluster gained and lost since the round before: components
    (as exact integers of any size) and vectors."""

    def run(batches):
        sums = np.zeros((k, dimension + 1), np.int64)
        for batch in batches:
            v = np.asarray(column(batch, "v").flatten()).reshape(batch.num_rows, -1).astype(np.int64)
            v = np.concatenate([v, np.ones((len(v), 1), np.int64)], axis=1)
            to, left = np.asarray(column(batch, "cluster")), np.asarray(column(batch, "was"))
            np.add.at(sums, to, v)
            np.subtract.at(sums, left[left >= 0], v[left >= 0])
        at = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(sums[at]), pa.list_(pa.int64()))], ["cluster", "gain"])

    gains = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "cluster int, gain array<long>")
    found = gains.select("cluster", F.posexplode("gain").alias("place", "x")).groupBy("cluster", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = np.zeros((k, dimension + 1), object)
    for r in found:
        out[r.cluster, r.place] = int(r.x)
    return out[:, :dimension], out[:, dimension]


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, dimension: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``
    of every kept vector, after ``rounds`` rounds and one more assignment.

    The rounds end early where no centroid moved, as nothing can change then.

    Defined cases: vectors that are null, of another length, or with a null,
    NaN or infinite component are left out; fewer than ``k`` vectors make as
    many centroids; repeated rows each count and get a row; equal vectors
    are equally near, so they go together; a centroid that lost all vectors
    stays; a null ``vec_id`` stays null; an empty table gives no rows; a
    component of 2**27 or more after scaling is an error, as distances would
    not fit a long; other columns are ignored.
    """
    vectors = integer_vectors(embeddings, dimension, scale)
    centroids = first_centroids(vectors, k, seed)
    k = len(centroids)
    state = vectors.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(-1).alias("was"))
    sums, counts = np.zeros((k, dimension), object), np.zeros(k, object)
    moved = set(range(k))
    for turn in range(rounds + 1):
        before, state = state, written(_assigned(state, centroids, moved))
        discard(before)
        if turn == rounds:
            break
        gained, more = _transfers(state, k, dimension)
        sums, counts = sums + gained, counts + more
        new = [(sums[j] // counts[j]).astype(np.int64) if counts[j] else c for j, c in enumerate(centroids)]
        moved = {j for j in range(k) if not np.array_equal(new[j], centroids[j])}
        centroids = new
        if not moved:
            break
    exact = {r.cluster: int(r.s) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = [(j, exact.get(j, 0), sum(exact.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    table = state.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, dimension: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The rounds, one after the other, as SQL."""
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {dimension}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS j, v FROM kept QUALIFY j < {k})"""]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT rid, min(d * {k} + j) % {k} AS j, min(d * {k} + j) // {k} AS d FROM
 (SELECT rid, j, list_sum(list_transform(list_zip(kept.v, c{t}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM kept, c{t}) GROUP BY 1)""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT c{t}.j AS j, coalesce(m.v, c{t}.v) AS v FROM c{t} LEFT JOIN
 (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY p)::BIGINT[] AS v FROM (SELECT j, p, sum(x)::HUGEINT AS s, count(*) AS n FROM
  (SELECT a{t}.j AS j, unnest(v) AS x, unnest(range({dimension})) AS p FROM kept JOIN a{t} USING (rid)) GROUP BY ALL) GROUP BY j) m ON m.j = c{t}.j)""")
    last = f"a{rounds}"
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, {last}.j::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY {last}.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM kept JOIN {last} USING (rid) JOIN c{rounds} ON c{rounds}.j = {last}.j"""
