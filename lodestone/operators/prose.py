"""The language of prose, by ranked profiles of character trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trigrams of a language's profile; the most frequent one weighs as much.
PROFILE = 400
DEFAULT = "en"


def trigrams(text: Column) -> Column:
    """All trigrams of the letters of a text in lower case, where everything
    between two words is one underscore.  Cut thrice, each time one place
    further on, so that no place is looked for from the start of a long text."""
    plain = F.concat(F.lit("_"), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", "_"), F.lit("_"))
    return F.concat(*[F.regexp_extract_all(F.substr(plain, F.lit(at)), F.lit("(...)")) for at in (1, 2, 3)])


def profiles(texts: DataFrame, text: str, lang: str, languages: tuple[str, ...], size: int = PROFILE) -> DataFrame:
    """``language, gram, weight``: for each of ``languages`` its ``size`` most
    frequent trigrams over all its texts, from weight ``size`` down to 1.

    At most ``size * len(languages)`` rows.  Equal counts are ranked by the
    trigram; null languages and those not asked for are left out.
    """
    grams = texts.where(F.col(lang).isin(*languages)).select(F.col(lang).alias("language"), F.explode(trigrams(F.col(text))).alias("gram"))
    best = Window.partitionBy("language").orderBy(F.desc("n"), "gram")
    ranked = grams.groupBy("language", "gram").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)
    return ranked.select("language", "gram", (F.lit(size + 1) - F.col("rank")).cast("long").alias("weight"))


def languages_of(texts: DataFrame, key: str, text: str, known: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """``key, language, score`` for every row of ``texts``: that of
    ``languages`` whose profile in ``known`` gives the largest sum of weights
    over all the text's trigrams.

    Equal sums go to the alphabetically first language.  Texts without a known
    trigram, null and empty ones among them, are ``DEFAULT`` with score 0.
    Rows that share a key, or have none, are told apart by their place.
    """
    rows = texts.select(F.monotonically_increasing_id().alias("row__"), F.col(key).alias("key__"), F.col(text).alias("text__"))
    grams = rows.select("row__", "key__", F.explode_outer(trigrams(F.col("text__"))).alias("gram"))
    # a row per trigram with a weight per language; profiles() bounds it to a few hundred a language
    weights = known.groupBy("gram").agg(*[F.coalesce(F.sum(F.when(F.col("language") == g, F.col("weight"))), F.lit(0)).alias(f"w{i}") for i, g in enumerate(languages)])
    sums = [F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"w{i}") for i in range(len(languages))]
    scored = grams.join(F.broadcast(weights), "gram", "left").groupBy("row__", "key__").agg(*sums)
    best = F.array_min(F.array(*[F.struct((-F.col(f"w{i}")).alias("below"), F.lit(g).alias("language")) for i, g in enumerate(languages)]))
    found = scored.select("key__", best.alias("b"))
    return found.select(F.col("key__").alias(key), F.when(F.col("b.below") < 0, F.col("b.language")).otherwise(DEFAULT).alias("language"), (-F.col("b.below")).alias("score"))
