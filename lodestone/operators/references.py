"""Code references of Markdown, with what stands around them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import by_bytes

# --- fixed values: patterns, and how much of a text is kept ---
INLINE = r"`([^`]+)`"
FENCED = r"```(\w+)?\n(.*?)\n```"
LINK = r"\[([^\]]+)\]\(([^\)]+\.(?:py|js|ts|java|kt|go|rs|cpp|c|h))\)"
AROUND, BLOCK_CHARS = 50, 200
# --- end of fixed values ---

_ITEM = pa.struct([("type", pa.string()), ("name", pa.string()), ("text", pa.string()), ("start", pa.int32())])


def references_of(text: str) -> list[dict]:
    """``type, name, text, start`` of all references of a text, by kind and
    place: inline code with up to fifty characters on either side, fenced
    blocks with their language and first characters, links to code files."""
    out = [{"type": "inline_code", "name": m[1], "text": text[max(0, m.start() - AROUND) : m.end() + AROUND], "start": m.start()} for m in re.finditer(INLINE, text)]
    # a fence that is never closed would make the lazy pattern read to the end from each opening
    last, at = text.rfind("\n```"), 0
    fence = re.compile(FENCED, re.DOTALL)
    while at <= last and (m := fence.search(text, at)):
        out.append({"type": "code_block", "name": m[1] or "unknown", "text": m[2][:BLOCK_CHARS], "start": m.start()})
        at = m.end()
    return out + [{"type": "file_reference", "name": m[2], "text": m[1], "start": m.start()} for m in re.finditer(LINK, text)]


def markdown_references(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n, type, name, text, start`` of every reference; ``n`` counts a
    row's references from 0.  Null and empty texts have none; rows that share a
    key are read each on its own."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for batch in by_bytes(batches, text):
            found = [references_of(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_ITEM))], [key, "r"])

    rows = texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, r array<struct<type: string, name: string, text: string, start: int>>")
    return rows.select(key, F.posexplode("r").alias("n", "r")).select(key, "n", "r.*")
