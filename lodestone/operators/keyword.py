"""Keyword search: field-weighted postings, document frequencies, scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokenize import token_hash, tokens
from ..functions.vector import bound

# --- fixed values: saturation constants and field weights ---
K1, B, AVERAGE_LENGTH = 1.2, 0.75, 100.0
CODE_FIELDS = {"name": 15.0, "qualified_name": 12.0, "signature": 10.0, "docstring": 8.0, "content": 6.0, "filename": 4.0, "file_path": 2.0}
DOCUMENT_FIELDS = {"name": 5.0, "content": 5.0, "file_path": 2.0}
# --- end of fixed values ---

#: Up to so many tokens of queries, rows without stored postings are searched for these tokens alone.
FEW_TOKENS = 200


def postings(rows: DataFrame, key: str, fields: Mapping[str, float], k1: float = K1, b: float = B, average: float = AVERAGE_LENGTH, wanted: list[str] | None = None, capitals: bool = False) -> DataFrame:
    """``id, token_hash, weight`` of every row and token, or of those tokens
    that are ``wanted``: then only they are exploded, hashed and shuffled.

    Tokens are counted per field; each count is saturated against the length
    of the whole row, weighted, and summed.  One pass: a row's fields are
    exploded together.  Rows are dealt by their id before they are cut, so that
    texts are shuffled once and their tokens never; the rows of one id are
    counted in one task.  ``capitals`` is that of ``tokens``; queries need the
    same.
    """
    rows = rows.select(F.col(key).alias("id"), *[f for f in fields if f != "id"]).repartition("id")
    held = F.array(*[F.struct(F.lit(i).alias("field"), F.lit(w).alias("boost"), tokens(F.col(f), capitals).alias("tokens")) for i, (f, w) in enumerate(fields.items())])
    some = lambda t: t if wanted is None else F.filter(t, lambda x: x.isin(wanted)) if wanted else F.slice(t, 1, 0)

    def sized(fs):
        length = F.greatest(F.lit(1), F.aggregate(fs, F.lit(0), lambda s, f: s + F.size(f["tokens"])))
        return F.transform(fs, lambda f: F.struct(f["field"].alias("field"), f["boost"].alias("boost"), length.alias("length"), some(f["tokens"]).alias("tokens")))

    # the tokens are the argument of a function, so that they are made once
    each = rows.select("id", F.explode(bound(held, sized)).alias("f"))
    spread = each.select("id", "f.length", "f.field", "f.boost", F.explode("f.tokens").alias("token"))
    counted = spread.groupBy("id", "length", "field", "boost", "token").agg(F.count("*").alias("tf"))
    saturated = F.col("boost") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / average))
    return counted.groupBy("id", token_hash(F.col("token")).alias("token_hash")).agg(F.sum(saturated).alias("weight"))


def document_frequencies(posted: DataFrame, total: int | None = None) -> DataFrame:
    """``token_hash, df, idf`` with ``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``."""
    n = total if total is not None else posted.agg(F.count_distinct("id")).first()[0]
    # counting the weights keeps the column, so that a plan which also needs it makes the postings once
    df = posted.groupBy("token_hash").agg(F.count("weight").alias("df"))
    return df.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def query_terms(queries: DataFrame, key: str, text: str, capitals: bool = False) -> DataFrame:
    """``query_id, token_hash, qtf`` of every query."""
    spread = queries.select(F.col(key).alias("query_id"), F.explode(tokens(F.col(text), capitals)).alias("token"))
    return spread.groupBy("query_id", token_hash(F.col("token")).alias("token_hash")).agg(F.count("*").alias("qtf"))


def wanted_tokens(queries: DataFrame, text: str, capitals: bool = False) -> list[str] | None:
    """The queries' distinct tokens, if they are at most ``FEW_TOKENS``."""
    found = queries.select(F.explode(tokens(F.col(text), capitals)).alias("t")).distinct().limit(FEW_TOKENS + 1).collect()
    return sorted(r.t for r in found) if len(found) <= FEW_TOKENS else None


def keyword_scores(posted: DataFrame, terms: DataFrame, total: int) -> DataFrame:
    """``query_id, id, score``: the sum of qtf, weight and idf over shared tokens.

    ``terms`` joins both the frequencies and the postings, so that only the
    queries' tokens are counted and scored.  Catalyst broadcasts the terms
    where they are small and shuffles both sides where not.
    """
    wanted = posted.join(terms.select("token_hash").distinct(), "token_hash", "left_semi")
    frequent = document_frequencies(wanted, total)
    weighted = terms.join(frequent, "token_hash").select("query_id", "token_hash", (F.col("qtf") * F.col("idf")).alias("q"))
    return wanted.join(weighted, "token_hash").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
