"""Packing of lines by a budget, as a fold in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..functions.vector import bound

# --- fixed values: budgets ---
LINE_TOKENS, CONFIG_CHARS = 512, 1500
# --- end of fixed values ---


def packed_starts(costs: Column, budget: int, free: int = 0) -> Column:
    """Where runs of lines begin, from 0: a run takes lines while their costs,
    less ``free``, stay within ``budget``; its first line it takes in any case."""
    none = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("held"))

    def take(s: Column, c: Column) -> Column:
        new = (s["i"] == 0) | (s["held"] + c - free > budget)
        return F.struct(F.when(new, F.concat(s["starts"], F.array(s["i"]))).otherwise(s["starts"]).alias("starts"), (s["i"] + 1).alias("i"), F.when(new, c).otherwise(s["held"] + c).alias("held"))

    return F.aggregate(costs, none, take, lambda s: s["starts"])


def _runs(lines: Column, starts: Column) -> Column:
    """(first line, last line, content) of each run; lines count from 1."""

    def run(a: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(lines))
        return F.struct((a + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice(lines, a + 1, end - a), "\n").alias("content"))

    return F.transform(starts, run)


def line_chunks(texts: DataFrame, key: str, text: str, budget: int = LINE_TOKENS) -> DataFrame:
    """``key, chunk_index, start_line, end_line, token_count, name, content``:
    lines packed by their estimated tokens, where a file cannot be parsed.

    Every row is packed on its own, without a shuffle.  A line over the budget
    is a chunk by itself; null and empty texts are one empty line.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")

    def cut(ls: Column) -> Column:
        return bound(packed_starts(F.transform(ls, lambda x: token_estimate(x).cast("long")), budget), lambda starts: _runs(ls, starts))

    rows = texts.select(F.col(key), F.posexplode(bound(lines, cut)).alias("chunk_index", "c")).select(key, "chunk_index", "c.*")
    tokens = F.aggregate(F.split("content", "\n"), F.lit(0).cast("long"), lambda s, x: s + token_estimate(x))
    return rows.select(key, "chunk_index", "start_line", "end_line", tokens.alias("token_count"), F.format_string("Lines %d-%d", "start_line", "end_line").alias("name"), "content")


def config_chunks(texts: DataFrame, key: str, text: str, size: int = CONFIG_CHARS) -> DataFrame:
    """``key, chunk_index, start, end, content``: lines of a config file packed
    by characters; ``start`` and ``end`` are offsets, the end of a chunk being
    the start of the next.  A text within ``size`` is one chunk; null is empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(whole, "\n")

    def cut(ls: Column) -> Column:
        return bound(packed_starts(F.transform(ls, lambda x: F.length(x).cast("long") + 1), size, free=1), lambda starts: _runs(ls, starts))

    cuts = F.when(F.length(whole) > size, bound(lines, cut)).otherwise(F.array(F.struct(F.lit(1).alias("start_line"), F.size(lines).alias("end_line"), whole.alias("content"))))

    def place(s: Column, c: Column) -> Column:
        start = F.coalesce(F.get(s, F.size(s) - 1)["end"], F.lit(0))
        end = F.least(start + F.length(c["content"]) + 1, F.length(whole))
        return F.concat(s, F.array(F.struct(start.alias("start"), end.alias("end"), c["content"].alias("content"))))

    none = F.array().cast("array<struct<start: int, end: int, content: string>>")
    return texts.select(F.col(key), F.posexplode(F.aggregate(cuts, none, place)).alias("chunk_index", "c")).select(key, "chunk_index", "c.*")
