"""The search plan: two branches, fusion, expansion, boosts, diversity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph, keyword, ranking


@dataclass(frozen=True)
class SearchOptions:
    """What a search asks for, apart from the queries themselves."""

    limit: int = 10
    fusion: str = "rrf"
    language: str | None = None
    file: str | None = None
    min_score: float = 0.0
    seeds: int = graph.SEEDS
    threshold: float = graph.THRESHOLD
    keep_first: int = 1

    def __post_init__(self):
        if self.limit <= 0:
            raise ValueError("limit must be positive")
        if not 0 <= self.min_score <= 1:
            raise ValueError("min_score must be from 0 to 1")
        if self.fusion not in ("rrf", "dbsf"):
            raise ValueError("fusion must be rrf or dbsf")

    @property
    def is_folder(self) -> bool:
        """A file filter whose last part has no full stop names a folder."""
        return bool(self.file) and (self.file.endswith("/") or "." not in self.file.rsplit("/", 1)[-1])


def search(rows: DataFrame, queries: DataFrame, fields: dict[str, float], options: SearchOptions, edges: DataFrame | None = None, posted: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """``query_id, id, score, position`` for every query.

    ``rows``: id, embedding, the text fields, name, qualified_name,
    object_type, result_type, file_path, language, score_weight.  ``queries``:
    query_id, text, embedding.  Postings may be given if they are stored.
    """
    keep = 3 * options.limit * (5 if options.is_folder else 1)
    dense_k, sparse_k = ranking.prefetch(keep)
    held = rows
    if options.language:
        held = held.where(F.col("language") == options.language)
    if options.file and not options.is_folder:
        held = held.where(F.col("file_path") == options.file)
    dense = ranking.nearest(held, "id", "embedding", queries, dense_k)
    if posted is None:
        posted = keyword.postings(held, "id", fields, wanted=keyword.wanted_tokens(queries, "text"))
    elif held is not rows:
        posted = posted.join(held.select("id"), "id", "left_semi")
    scored = keyword.keyword_scores(posted, keyword.query_terms(queries, "query_id", "text"), total if total is not None else held.count())
    sparse = ranking.top_k(scored, sparse_k, ["query_id"])
    fused = ranking.fuse_ranks([dense, sparse]) if options.fusion == "rrf" else ranking.fuse_distributions([dense, sparse])
    found = ranking.top_k(fused, keep, ["query_id"]).drop("rank")
    facts = rows.select("id", "name", "qualified_name", "object_type", "result_type", "file_path", "score_weight")
    if options.is_folder:
        folder = options.file.rstrip("/")
        inside = F.startswith("file_path", F.lit(folder + "/")) | (F.col("file_path") == folder)
        found = found.join(facts.where(inside).select("id"), "id", "left_semi")
    if edges is not None:
        found = found.unionByName(graph.expand(found, edges, options.seeds, options.threshold))
    ready = found.join(facts, "id").join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    final = ranking.boosted(ready, F.col("query_text"))
    if options.min_score:
        final = final.where(F.col("score") >= options.min_score)
    kept = ranking.diverse(final, options.keep_first)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return kept.withColumn("position", place).where(F.col("position") <= options.limit).select("query_id", "id", "score", "position", "name", "object_type", "file_path")


def as_json(results: DataFrame) -> DataFrame:
    """One JSON text per result; scores with two decimals."""
    item = F.struct("name", F.col("object_type").alias("type"), F.col("file_path").alias("file"), F.round("score", 2).alias("score"))
    return results.select("query_id", "position", F.to_json(item).alias("json"))
