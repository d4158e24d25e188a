"""How much of a source file can be read, and the gate that rests on it.

A scanner goes on after an error, and counts what it could read and what not.
Of Python, nodes are those of its own parser; a part that does not parse is
taken to pieces by indentation, and each line at which that ends is an error.
Of the languages with braces, nodes are tokens, comments and strings, a pair of
brackets being one; brackets without a partner and strings and comments that are
not closed are errors.
"""

from __future__ import annotations

import ast
import re
import textwrap
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import by_bytes

#: Fixed value: files with errors and a smaller part of valid nodes are rejected.
LEAST_VALID = 0.5
#: Indentation beyond which lines are errors, one by one; Python has the same limit.
DEEPEST = 100
BRACED = ("java", "kotlin", "javascript", "typescript")
_PAIRS = {")": "(", "]": "[", "}": "{"}
_LONG_STRING = re.compile(r'"""(?:\\.|[^\\])*?"""|\'\'\'(?:\\.|[^\\])*?\'\'\'', re.S)
#: Comments and strings, closed (1) or open to the end of the line or text (2), and other tokens (3).
_TOKEN = re.compile(
    r'''(//[^\n]*|/\*.*?\*/|""".*?"""|"(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+'|`(?:\\.|[^`\\])*+`)'''
    r'''|(/\*.*|""".*|"(?:\\.|[^"\\\n])*+|'(?:\\.|[^'\\\n])*+|`.*)|(\w+|[^\s\w])''',
    re.S,
)
_BRANCH = re.compile(r"(?:try|else|elif|except|finally)\b")
_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b|[)\]}]")


def _nodes(text: str) -> int | None:
    """The nodes of a text's syntax tree, without the tree's root."""
    try:
        return sum(1 for _ in ast.walk(ast.parse(text))) - 1
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _groups(block: str) -> list[list[str]]:
    """The statements of a dedented block: each begins at a line without
    indentation that goes on with nothing before it."""
    inside, at, no = set(), 0, 0
    for m in _LONG_STRING.finditer(block):
        no += block.count("\n", at, m.start())
        inside.update(range(no + 1, no + m[0].count("\n") + 1))
        at = m.start()
    groups: list[list[str]] = []
    decorated = False
    for no, line in enumerate(block.split("\n")):
        begins = line[:1].strip() and no not in inside and not _GOES_ON.match(line)
        if not groups or begins and not decorated:
            groups.append([])
        groups[-1].append(line)
        decorated = bool(begins) and line.startswith("@")
    return groups


def python_nodes(text: str) -> tuple[int, int]:
    """Error nodes and all nodes of a Python text."""
    errors = valid = 0
    todo = [(text, 0)]
    while todo:
        block, depth = todo.pop()
        if (n := _nodes(block)) is not None:
            valid += n
            continue
        block = textwrap.dedent(block)
        if depth == DEEPEST:
            errors += sum(1 for line in block.split("\n") if line.strip())
            continue
        groups = _groups(block)
        for group in groups:
            # a single group is the block, which did not parse
            if len(groups) > 1 and (n := _nodes("\n".join(group))) is not None:
                valid += n
                continue
            body: list[str] = []
            for line in group:
                if not line[:1].strip():
                    body.append(line)
                    continue
                if any(x.strip() for x in body):
                    todo.append(("\n".join(body), depth + 1))
                body = []
                head = line.rstrip().endswith(":")
                n = _nodes(line.rstrip() + " pass") if head else _nodes(line.removeprefix("@"))
                if n is not None:
                    valid += n - head  # without the added statement
                elif head and _BRANCH.match(line):
                    valid += 1
                else:
                    errors += 1
            if any(x.strip() for x in body):
                todo.append(("\n".join(body), depth + 1))
    return errors, errors + valid


def braced_nodes(text: str) -> tuple[int, int]:
    """Error nodes and all nodes of a text of a language with braces.  A bracket
    that closes one further out makes errors of those that stand open within."""
    errors = valid = 0
    open_, held = [], Counter()
    for m in _TOKEN.finditer(text):
        token = m[0]
        if m.lastindex < 3:
            errors += m.lastindex == 2
            valid += m.lastindex == 1
        elif token in "([{":
            open_.append(token)
            held[token] += 1
        elif token in _PAIRS:
            if not held[_PAIRS[token]]:
                errors += 1
                continue
            while (last := open_.pop()) != _PAIRS[token]:
                held[last] -= 1
                errors += 1
            held[last] -= 1
            valid += 1
        else:
            valid += 1
    return errors + len(open_), errors + len(open_) + valid


def parse_metrics(files: DataFrame) -> DataFrame:
    """``files`` (with ``language`` and ``content``) and ``error_nodes``,
    ``total_nodes``, ``has_errors`` and ``valid_ratio``.

    Null and empty contents have no nodes and a ratio of 1.  In a language that
    is not read here all four are null.  Columns of these names are replaced.
    """
    own = [c for c in files.columns if c.lower() not in ("error_nodes", "total_nodes", "has_errors", "valid_ratio")]
    whole = files.select(*[f"`{c}`" for c in own])
    at = {c: i for i, c in enumerate(own)}

    def run(batches):
        for batch in by_bytes(batches, "content"):
            counts = []
            for language, text in zip(batch.column(at["language"]).to_pylist(), batch.column(at["content"]).to_pylist(), strict=True):
                reader = python_nodes if language == "python" else braced_nodes if language in BRACED else None
                counts.append(reader(text or "") if reader else (None, None))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*own, "error_nodes", "total_nodes"])

    schema = whole.withColumns({"error_nodes": F.lit(0).cast("long"), "total_nodes": F.lit(0).cast("long")}).schema
    for field in schema:
        field.nullable = True
    counted = whole.mapInArrow(run, schema)
    ratio = F.when(F.col("total_nodes") == 0, 1.0).otherwise(1 - F.col("error_nodes") / F.col("total_nodes"))
    return counted.withColumns({"has_errors": F.col("error_nodes") > 0, "valid_ratio": F.when(F.col("error_nodes").isNotNull(), ratio)})


def readable(measured: DataFrame, least: float = LEAST_VALID) -> DataFrame:
    """The rows of ``parse_metrics`` without those that have errors and less
    than ``least`` of valid nodes.  Rows of other languages stay."""
    return measured.where(~F.coalesce(F.col("has_errors") & (F.col("valid_ratio") < least), F.lit(False)))
