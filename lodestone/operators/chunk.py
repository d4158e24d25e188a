"""Chunking of Markdown, prose and config files."""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import by_bytes, small_batches

# --- fixed values: chunk sizes and separators ---
CHUNK_SIZE, CHUNK_OVERLAP = 512, 50
SEPARATORS = ("\n\n", "\n", " ", "")
SECTION_TOKENS, SECTION_DEPTH = 512, 4
LEAST_TOKENS, MOST_TOKENS, HEADING_CHUNK = 100, 1024, 1500
SECTION_HEADER = r"^(#{2,6})\s+(.+)$"
# --- end of fixed values ---


def section_array(text: Column, strip_headers: bool = False) -> Column:
    """The sections of one text as an array of (level, title, content)."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n(?= *#{1,3} +[^ \n])")

    def section(part: Column) -> Column:
        line = F.trim(F.element_at(F.split(part, "\n", 2), 1))
        level = F.length(F.regexp_extract(line, r"^(#{1,3}) ", 1))
        title = F.when(level > 0, F.trim(F.regexp_replace(line, r"^#{1,3} ", "")))
        shown = F.when(level > 0, F.regexp_replace(part, r"^[^\n]*\n?", "")).otherwise(part) if strip_headers else part
        return F.struct(level.alias("level"), title.alias("title"), shown.alias("content"))

    return F.filter(F.transform(parts, section), lambda x: F.rlike(x["content"], F.lit(r"\S")))


def markdown_sections(texts: DataFrame, key: str, text: str, strip_headers: bool = False) -> DataFrame:
    """``key, section, level, title, content``: the text cut at headers of
    level one to three; what stands before the first has level 0.  Sections of
    white space alone are dropped; ``####`` is no header.

    Each row is cut on its own, without a shuffle: the text is split at the
    line breaks before headers.  Hence rows that share a key, or have none, are
    numbered each from 0; null and empty texts have no sections.
    """
    kept = section_array(F.col(text), strip_headers)
    return texts.select(F.col(key), F.posexplode(kept).alias("section", "s")).select(key, "section", "s.level", "s.title", "s.content")


def chunk_spans(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """The chunks of a text, or of a part of it, as spans of offsets in order.

    The offsets of all pieces between the first separator are found first.  A
    chunk is then a run of pieces, and a binary search finds the last that it
    can take.  In a first chunk, the last piece counts with a separator, in
    later ones without.  These begin with those last pieces that fit into
    ``overlap``, each counted with a separator, even where that makes them
    longer than ``size``.  A piece that is too long by itself is cut at the next
    separator, or at every ``size - overlap`` characters where there is none,
    and shares nothing with its neighbours.
    """
    end = len(text) if end is None else end
    if end - begin <= size:
        if end > begin:
            yield begin, end
        return
    if not separators:
        yield from ((i, min(i + size, end)) for i in range(begin, end, max(1, size - overlap)))
        return
    sep, n = separators[0], len(separators[0])
    if n:
        at = [m.start() for m in re.compile(re.escape(sep)).finditer(text, begin, end)]
        starts, ends = [begin, *(x + n for x in at)], [*at, end]
        long = [k for k, (x, y) in enumerate(zip(starts, ends, strict=True)) if y - x + n > size]
    else:
        starts, ends, long = range(begin, end), range(begin + 1, end + 1), []
    new = 0  # the first piece that no chunk has had
    for stop in (*long, len(starts)):
        first, extra = new, n
        while new < stop:
            after = max(new + 1, bisect.bisect_right(ends, starts[first] + size - extra, new, stop))
            yield starts[first], ends[after - 1]
            new, extra = after, 0
            first = bisect.bisect_left(starts, ends[after - 1] + n - overlap, first, after) if overlap else after
        if stop < len(starts):
            yield from chunk_spans(text, size, overlap, separators[1:], starts[stop], ends[stop])
        new = stop + 1


def recursive_chunks(texts: DataFrame, key: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``key, chunk_index, total_chunks, content`` by ``chunk_spans``; chunks of
    white space alone are dropped.  Null and empty texts have none; rows that
    share a key are cut each on its own."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for batch in by_bytes(batches, text):
            found = [[t[a:b] for a, b in chunk_spans(t, size, overlap) if not t[a:b].isspace()] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], [key, "pieces"])

    split = small_batches(texts).select(key, text).mapInArrow(run, f"`{key}` {kind}, pieces array<string>")
    # counted before the rows are made, which would each carry the whole list otherwise
    return split.withColumn("total__", F.size("pieces")).select(key, F.col("total__").alias("total_chunks"), F.posexplode("pieces").alias("chunk_index", "content")).select(key, "chunk_index", "total_chunks", "content")


def hybrid_chunks(texts: DataFrame, key: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``key, section, level, title, part, content``: the sections of Markdown,
    those longer than ``size`` cut further by ``recursive_chunks``."""
    sections = markdown_sections(texts, key, text).select(F.struct(F.col(key), "section", "level", "title").alias("k"), "content")
    return recursive_chunks(sections, "k", "content", size, overlap).select("k.*", F.col("chunk_index").alias("part"), "content")


def header_sections(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, depth, title, start_line, end_line, content``: the text from each
    header of level two to six to the next; what stands before the first is
    left out.  Lines count from 1.

    Each row is cut on its own, without a shuffle, so that rows which share a
    key, or have none, do not mix; null and empty texts have no sections.  Only
    the sections' numbers of lines go to Python, to be added up.
    """

    @F.pandas_udf("array<int>")
    def added_up(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda x: np.cumsum(x).tolist())

    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"\n(?=#{2,6}[^\S\n]+[^\n])")
    cut = texts.select(F.col(key), parts.alias("p")).withColumn("upto", added_up(F.transform("p", lambda x: F.size(F.split(x, "\n")))))
    rows = cut.select(key, F.explode(F.arrays_zip("p", "upto")).alias("x")).select(key, F.col("x.p").alias("content"), F.col("x.upto").alias("end_line"))
    first = F.element_at(F.split("content", "\n", 2), 1)
    head = lambda k: F.regexp_extract(first, SECTION_HEADER, k)
    found = rows.where(F.rlike(first, F.lit(SECTION_HEADER)))
    return found.select(key, F.length(head(1)).alias("depth"), F.trim(head(2)).alias("title"), (F.col("end_line") - F.size(F.split("content", "\n")) + 1).alias("start_line"), "end_line", "content")


def groups_of_small(lengths: list[int], least: int = LEAST_TOKENS, most: int = MOST_TOKENS) -> list[int]:
    """A group number for each chunk of these lengths in characters: small
    ones gather until together they are no longer small, or until one that
    is large comes; small ones at the end join the group before, if the whole
    stays below ``most``."""
    groups, n, held = [], 0, 0  # held: tokens of the open group
    for length in lengths:
        size = length // 4
        if size >= least and groups and groups[-1] == n:
            n, held = n + 1, 0
        groups.append(n)
        held += size
        if held >= least or size >= least:
            n, held = n + 1, 0
    tail = [length for length, g in zip(lengths, groups, strict=True) if g == n]
    last = [length for length, g in zip(lengths, groups, strict=True) if g == n - 1]
    joined = (sum(last) + 2 * (len(last) - 1)) // 4
    if tail and last and joined + sum(length // 4 for length in tail) < most:
        groups = [min(g, n - 1) for g in groups]
    return groups


def merge_small(chunks: DataFrame, key: str, least: int = LEAST_TOKENS, most: int = MOST_TOKENS) -> DataFrame:
    """``key, chunk_index, path, keys, merged_count, content``: the chunks of a
    file (chunk_index, path, keys, content) with small neighbours merged.
    Python sees the lengths alone."""

    @F.pandas_udf("array<int>")
    def grouped(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda x: groups_of_small(list(x), least, most))

    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "path", "keys", "content")))
    files = chunks.groupBy(key).agg(ordered.alias("c")).withColumn("g", grouped(F.transform("c", lambda x: F.length(x["content"]))))
    rows = files.select(key, F.explode(F.arrays_zip("c", "g")).alias("x")).select(key, F.col("x.g").alias("g"), F.col("x.c").alias("c"))
    merged = rows.groupBy(key, "g").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return merged.select(key, F.col("g").alias("chunk_index"), F.array_join("c.path", " + ").alias("path"), F.array_sort(F.array_distinct(F.flatten("c.keys"))).alias("keys"), F.size("c").alias("merged_count"), F.array_join("c.content", "\n\n").alias("content"))


def cut_at_headings(text: str, size: int = HEADING_CHUNK) -> list[tuple[str, int, int]]:
    """(content, start, end) of pieces that begin at a heading, as soon as
    what came before is longer than ``size``."""
    cuts = [0]
    for m in re.finditer(r"^#+[^\S\n]+.+$", text, re.M):
        if m.start() - cuts[-1] - 1 > size:
            cuts.append(m.start())
    return [(text[a : b - 1], a, b) for a, b in zip(cuts, cuts[1:], strict=False)] + [(text[cuts[-1] :], cuts[-1], len(text))]


def heading_chunks(texts: DataFrame, key: str, text: str, size: int = HEADING_CHUNK) -> DataFrame:
    """``key, chunk_index, start, end, content`` by ``cut_at_headings``; null
    counts as empty, which is one empty chunk."""

    @F.pandas_udf("array<struct<content: string, start: long, end: long>>")
    def cut(values: pd.Series) -> pd.Series:
        return values.map(lambda t: [{"content": c, "start": a, "end": b} for c, a, b in cut_at_headings(t, size)])

    return texts.select(key, F.posexplode(cut(F.coalesce(F.col(text), F.lit("")))).alias("chunk_index", "c")).select(key, "chunk_index", "c.start", "c.end", "c.content")


def properties_sections(files: DataFrame, key: str, text: str) -> DataFrame:
    """The entries of .properties files grouped by their prefix before the
    first full stop: ``key, prefix, n_keys, keys, content``.  Rows that share a
    key, or have none, are grouped each on its own; null texts have no entry."""
    lines = files.select(key, F.monotonically_increasing_id().alias("row__"), F.col(text)).select(key, "row__", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    entries = lines.where(F.contains("line", F.lit("=")) & ~F.rlike("line", F.lit("^[#!]"))).withColumn("name", F.trim(F.split("line", "=", 2)[0]))
    prefix = F.split("name", r"\.", 2)[0]
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "name", "line")))
    grouped = entries.groupBy(key, "row__", prefix.alias("prefix")).agg(ordered.alias("e"))
    return grouped.select(key, "prefix", F.size("e").alias("n_keys"), F.col("e.name").alias("keys"), F.array_join(F.col("e.line"), "\n").alias("content"))


def _flat(data, path: str = "") -> list[str]:
    if isinstance(data, dict):
        named = [(f"{path}.{k}" if path else str(k), v) for k, v in data.items()]
        return [x for p, v in named for x in (p, *_flat(v, p))]
    if isinstance(data, list):
        return [x for i, v in enumerate(data) for x in _flat(v, f"{path}[{i}]")]
    return []


def _depth(data) -> int:
    if isinstance(data, dict):
        return 1 + max(map(_depth, data.values()), default=0)
    return max(map(_depth, data), default=0) if isinstance(data, list) else 0


def _sections(key: str, value, depth: int = 1) -> list[tuple[str, object, bool]]:
    """(path, value, oversized): a section that is too long is cut by its
    keys, down to a depth."""
    size = len(json.dumps(value, default=str)) // 4
    if size > SECTION_TOKENS and isinstance(value, dict) and depth < SECTION_DEPTH and len(value) > 1:
        return [x for k, v in value.items() for x in _sections(f"{key}.{k}", v, depth + 1)]
    return [(key, value, size > 2 * SECTION_TOKENS)]


def parse_config(text: str, kind: str) -> list[dict]:
    """Sections of one JSON or YAML text; none if it does not parse or is not
    a mapping.  Sections are numbered across all documents of a file."""
    try:
        if kind == "json":
            documents = [json.loads(text)]
        else:
            import yaml

            documents = list(yaml.safe_load_all(text))
    except Exception:
        return []
    out = []
    for data in documents:
        for key, value in data.items() if isinstance(data, dict) else ():
            for path, part, large in _sections(str(key), value):
                out.append({"path": path, "keys": _flat(part, path) or [path], "depth": _depth(part), "oversized": large, "content": json.dumps(part, ensure_ascii=False, indent=2, default=str)})
    return out


def config_sections(files: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """``key, chunk_index, path, keys, depth, oversized, content`` of JSON and
    YAML files; ``kind`` names the column with "json" or "yaml"."""
    name = files.schema[key].dataType.simpleString()
    item = pa.list_(pa.struct([("path", pa.string()), ("keys", pa.list_(pa.string())), ("depth", pa.int32()), ("oversized", pa.bool_()), ("content", pa.string())]))

    def run(batches):
        for batch in by_bytes(batches, text):
            keys, texts, kinds = (batch.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse_config(t or "", k) for t, k in zip(texts, kinds, strict=True)], item)], [key, "s"])

    schema = f"`{key}` {name}, s array<struct<path: string, keys: array<string>, depth: int, oversized: boolean, content: string>>"
    return files.select(key, text, kind).mapInArrow(run, schema).select(key, F.posexplode("s").alias("chunk_index", "s")).select(key, "chunk_index", "s.*")
