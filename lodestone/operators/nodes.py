"""Nodes of documents: from files to stored rows, and back to what a search
shows.  Code objects are stored and read back likewise."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import by_bytes
from .chunk import CHUNK_OVERLAP, CHUNK_SIZE, chunk_spans, groups_of_small, parse_config, section_array

CODE = "array<struct<name: string, type: string>>"
#: Characters of a document's text that stand in for a docstring.
SHOWN = 200
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

_ITEM = {"content": ("string", pa.string()), "title": ("string", pa.string()), "start_line": ("int", pa.int32()), "end_line": ("int", pa.int32()), "keys": ("array<string>", pa.list_(pa.string())), "depth": ("int", pa.int32())}
_ITEMS = f"array<struct<{', '.join(f'{name}: {kind}' for name, (kind, _) in _ITEM.items())}>>"
_ARROW_ITEMS = pa.list_(pa.struct([(name, kind) for name, (_, kind) in _ITEM.items()]))


def places(text: str, chunks: Iterable[str]) -> Iterator[tuple[int, int]]:
    """First and last line, from 1, of the first place of each chunk in the
    text; (1, 1) if it is not there."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    for chunk in chunks:
        at = text.find(chunk) if chunk else -1
        first = bisect.bisect_left(breaks, at) + 1 if at >= 0 else 1
        yield first, first + (chunk.count("\n") if at >= 0 else 0)


def _placed(text: str, chunks: list[tuple]) -> list[dict]:
    """Items of chunks (content, title, keys, depth)."""
    lines = places(text, [c[0] for c in chunks])
    return [{"content": c, "title": title, "start_line": a, "end_line": b, "keys": keys, "depth": depth} for (c, title, keys, depth), (a, b) in zip(chunks, lines, strict=True)]


def markdown_items(text: str, sections: list[dict], size: int, overlap: int) -> list[dict]:
    """The chunks of a text's sections; only those of level one and two have
    the section's title."""
    chunks = []
    for s in sections:
        pieces = (s["content"][a:b] for a, b in chunk_spans(s["content"], size, overlap))
        chunks += [(p, s["title"] if s["level"] in (1, 2) else None, None, None) for p in pieces if not p.isspace()]
    return _placed(text, chunks)


def config_items(text: str, kind: str) -> list[dict]:
    """The sections of a config file, small neighbours merged: paths are joined
    by " + ", keys are the sorted union, the depth is that of the first."""
    found = parse_config(text, kind)
    groups: dict[int, list[dict]] = {}
    for g, s in zip(groups_of_small([len(s["content"]) for s in found]), found, strict=True):
        groups.setdefault(g, []).append(s)
    chunks = []
    for some in groups.values():
        keys = sorted({k for s in some for k in s["keys"]}) if len(some) > 1 else some[0]["keys"]
        chunks.append(("\n\n".join(s["content"] for s in some), " + ".join(s["path"] for s in some), keys, some[0]["depth"]))
    return _placed(text, chunks)


def _nodes(items: DataFrame, kind: str, at: Column, **own: Column) -> DataFrame:
    # counted before the rows are made, which would each carry the whole list otherwise
    rows = items.withColumn("total_chunks", F.size("items")).select("file_path", "relative_path", "extra__", "total_chunks", F.posexplode("items").alias("chunk_index", "i"))
    fields = {
        "file_path": F.col("file_path"), "relative_path": F.col("relative_path"), "node_type": F.lit(kind), "content": F.col("i.content"), "checksum": T.checksum(F.col("i.content")),
        "deterministic_id": node_id(F.col("relative_path"), F.lit(kind), F.col("chunk_index")), "chunk_index": F.col("chunk_index"), "total_chunks": F.col("total_chunks"), "parent_doc_id": F.col("file_path"),
        "title": F.coalesce("i.title", "extra__") if kind == "markdown" else F.col("i.title"), "start_line": F.col("i.start_line"), "end_line": F.col("i.end_line"), "language": F.lit(None).cast("string"),
        "related_code": F.lit(None).cast(CODE), "config_keys": F.col("i.keys"), "config_format": F.lit(None).cast("string"), "env_references": F.lit(None).cast("array<string>"), "section_depth": F.col("i.depth"),
        "metadata": F.lit(None).cast("map<string, string>"), "created_at": at, "updated_at": at,
    }
    return rows.select(*[(own.get(name, c)).alias(name) for name, c in fields.items()])


def node_id(relative_path: Column, node_type: Column, chunk_index: Column) -> Column:
    return T.object_id(relative_path, node_type, chunk_index)


def _in_batches(files: DataFrame, make, *more: Column) -> DataFrame:
    """``file_path, relative_path, extra__, items``: ``make`` of each text and
    the second of ``more``, whose first is passed on."""

    def run(batches):
        for batch in by_bytes(batches, "content"):
            path, relative, extra = (batch.column(i) for i in range(3))
            items = [make(t or "", x) for t, x in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([path, relative, extra, pa.array(items, _ARROW_ITEMS)], ["file_path", "relative_path", "extra__", "items"])

    extra, given = more
    rows = files.select("file_path", "relative_path", extra.alias("extra__"), F.col("content"), given.alias("given__"))
    return rows.mapInArrow(run, f"file_path string, relative_path string, extra__ string, items {_ITEMS}")


def markdown_nodes(files: DataFrame, at: Column | None = None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """The nodes of Markdown files (``file_path, relative_path, content``): a
    row per chunk, with the title of its section, or the file's below level
    two, its lines and the code it names.

    Defined cases: null, empty and blank texts have no nodes; files that share
    a path are cut each on its own, though their nodes share ids; null paths
    stay null; other columns are ignored."""
    items = _in_batches(files, lambda t, s: markdown_items(t, s or [], size, overlap), T.file_title(F.col("content")), section_array(F.col("content")))
    code = T.code_references(F.col("i.content"))
    return _nodes(items, "markdown", F.current_timestamp() if at is None else at, related_code=F.when(F.size(code) > 0, code))


def config_nodes(files: DataFrame, at: Column | None = None) -> DataFrame:
    """The nodes of JSON and YAML files (also with ``config_format``): a row per
    chunk with its keys, depth and environment names.  Files that do not parse
    have none; else as for ``markdown_nodes``."""
    items = _in_batches(files, lambda t, kind: config_items(t, kind or "yaml"), F.col("config_format"), F.col("config_format"))
    return _nodes(items, "config", F.current_timestamp() if at is None else at, config_format=F.col("extra__"), env_references=T.env_references(F.col("i.content")))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _json(name: str, empty: str) -> Column:
    return F.when(F.size(name) > 0, F.to_json(name)).otherwise(empty)


def document_payload(nodes: DataFrame) -> DataFrame:
    """Nodes as the 27 columns of a stored row: lists as JSON, times as ISO
    8601, what is absent as an empty text or 0."""
    name = F.nullif("title", F.lit(""))
    fields = {
        "type": F.lit("document"), "node_type": F.col("node_type"), "object_type": F.lit("document"), "name": F.coalesce(name, T.basename(F.col("file_path"))),
        "qualified_name": F.concat(F.col("relative_path"), F.coalesce(F.concat(F.lit("#"), name), F.lit(""))), "title": _text("title"), "signature": F.lit(""), "docstring": F.left(_text("content"), F.lit(SHOWN)),
        **{c: F.col(c) for c in ("content", "file_path", "relative_path")}, **{c: F.coalesce(F.col(c), F.lit(0)) for c in ("start_line", "end_line")}, "checksum": F.col("checksum"), "language": _text("language"),
        **{c: F.col(c) for c in ("chunk_index", "total_chunks")}, "parent_doc_id": _text("parent_doc_id"), "deterministic_id": F.col("deterministic_id"), "related_code": _json("related_code", "[]"),
        "config_keys": _json("config_keys", "[]"), "config_format": _text("config_format"), "env_references": _json("env_references", "[]"), "section_depth": F.coalesce(F.col("section_depth").cast("string"), F.lit("0")),
        "custom_metadata": _json("metadata", "{}"), **{c: F.date_format(c, ISO) for c in ("created_at", "updated_at")},
    }
    return nodes.select(*[c.alias(name) for name, c in fields.items()])


def document_nodes(payloads: DataFrame) -> DataFrame:
    """The nodes of stored rows.  Empty texts and zeros become null, absent
    lists empty ones; the stored id is kept, not made anew."""
    null = lambda c, empty: F.nullif(F.col(c), F.lit(empty))
    read = lambda c, kind, empty: F.from_json(F.coalesce(null(c, ""), F.lit(empty)), kind)
    fields = {
        "file_path": F.col("file_path"), "relative_path": F.coalesce("relative_path", "file_path"), **{c: F.col(c) for c in ("node_type", "content", "checksum", "deterministic_id", "chunk_index", "total_chunks")},
        "parent_doc_id": _text("parent_doc_id"), "title": null("title", ""), "start_line": null("start_line", 0), "end_line": null("end_line", 0), "language": null("language", ""), "related_code": read("related_code", CODE, "[]"),
        "config_keys": read("config_keys", "array<string>", "[]"), "config_format": null("config_format", ""), "env_references": read("env_references", "array<string>", "[]"), "section_depth": null("section_depth", "0").cast("int"),
        "metadata": read("custom_metadata", "map<string, string>", "{}"), **{c: F.to_timestamp(c, ISO) for c in ("created_at", "updated_at")},
    }
    return payloads.select(*[c.alias(name) for name, c in fields.items()])


def object_payload(objects: DataFrame) -> DataFrame:
    """Code objects as the 22 columns of a stored row; ``ast_metadata`` is
    JSON text already."""
    same = ("object_type", "name", "content", "file_path", "relative_path", "start_line", "end_line", "checksum", "language", "token_count", "unique_token_count", "score_weight", "deterministic_id", "embedding_model_version")
    fields = {"type": F.lit("code"), **{c: F.col(c) for c in same}, **{c: _text(c) for c in ("qualified_name", "signature", "docstring", "parent_id", "ast_metadata")}, **{c: F.date_format(c, ISO) for c in ("created_at", "updated_at")}}
    return objects.select(*[c.alias(name) for name, c in fields.items()])


def code_objects(payloads: DataFrame) -> DataFrame:
    """The code objects of stored rows: empty parents and syntax become null,
    a missing language YAML, missing lines 0; the stored id is kept."""
    made = {"language": F.coalesce(F.nullif("language", F.lit("")), F.lit("yaml")), **{c: F.coalesce(F.col(c), F.lit(0)) for c in ("start_line", "end_line")}, **{c: F.nullif(c, F.lit("")) for c in ("parent_id", "ast_metadata")}, **{c: F.to_timestamp(c, ISO) for c in ("created_at", "updated_at")}}
    return payloads.drop("type").withColumns(made)


def shown_documents(payloads: DataFrame, *keep: str) -> DataFrame:
    """What a search shows of stored documents: title, file name or
    "Untitled"; the code that Markdown names; keys, environment, depth and
    format of config files.  Lists that do not parse are empty."""
    kind = F.coalesce("node_type", F.lit("markdown"))
    parsed = lambda c, t: F.coalesce(F.from_json(F.col(c), t), F.array().cast(t))
    config = F.col("node_type") == "config"
    fields = {
        "name": T.display_name(F.col("title"), T.basename(F.col("file_path")), default="Untitled"), "title": F.col("title"), "node_type": kind, "chunk_index": F.coalesce("chunk_index", F.lit(0)), "total_chunks": F.coalesce("total_chunks", F.lit(1)),
        **{c: F.coalesce(F.col(c), F.lit(0)) for c in ("start_line", "end_line")}, "relative_path": T.normal_path(F.coalesce("relative_path", "file_path", F.lit(""))),
        "related_code": F.when(F.col("node_type") == "markdown", parsed("related_code", CODE)), **{c: F.when(config, parsed(c, "array<string>")) for c in ("config_keys", "env_references")},
        "section_depth": F.when(config, F.coalesce("section_depth", F.lit("1"))), "config_format": F.when(config, _text("config_format")),
    }
    return payloads.select(*keep, *[c.alias(name) for name, c in fields.items()])
