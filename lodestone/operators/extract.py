"""Code objects, calls and imports of source files.

Python is read by its own parser; the languages with braces by a small scanner
over declarations.  Each file is read on its own, in Arrow batches; all that
relates files is left to joins (see ``graph``).
"""

from __future__ import annotations

import ast
import bisect
import io
import keyword
import re
import tokenize
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import by_bytes
from ..functions.text import object_id
from ..functions.vector import bound
from ..sources.tables import spread

_DECISIONS = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.BoolOp, ast.IfExp, ast.comprehension, ast.match_case)
_NESTING = (ast.If, ast.For, ast.While, ast.Try, ast.With)
_CLASS = re.compile(r"\b(enum\s+class|class|interface|enum)\s+(\w+)")
_FUNCTION = re.compile(r"\b(?:fun|function)\s*\*?\s*(?:<[^>]*>\s*)?(\w+)\s*\(|\bconst\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>")
_METHOD = re.compile(r"^\s*(?:@\w+\s+)*(?:(?:public|private|protected|static|final|async|override|abstract|suspend)\s+)*(?:[\w<>\[\],.?]+\s+)?(\w+)\s*\([^;]*\)\s*(?::\s*[\w<>\[\]., ]+)?(?:throws\s+[\w., ]+)?\s*$")
_IMPORT = re.compile(r"^\s*import\s+(?:static\s+)?(?:[^'\";]*?from\s+)?['\"]?([\w./@\-*]+)['\"]?", re.M)
_CALL = re.compile(r"\b(\w+)\s*\(")
# --- fixed values: words that look like calls or methods ---
NOT_CALLS = frozenset("if for while switch catch return new function fun super when do else try".split())
SCRIPT_WORDS = frozenset(
    """abstract as async await break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if
    implements import in instanceof interface let new null of private protected public readonly return set static super switch this throw true try type typeof undefined
    var void while with yield any boolean never number object string symbol unknown constructor""".split()
)
CLASS_CHARS, CLASS_METHODS = 2000, 20
# --- end of fixed values ---


def _row(kind, name, qualified, parent, start, end, doc, signature, content, calls, complexity, depth):
    return {"object_type": kind, "name": name, "qualified_name": qualified, "parent_name": parent, "start_line": start, "end_line": end, "docstring": doc, "signature": signature, "content": content, "calls": calls, "cyclomatic": complexity, "nesting": depth}


def _nesting(node: ast.AST) -> int:
    return max((_nesting(c) + isinstance(c, _NESTING) for c in ast.iter_child_nodes(node)), default=0)


def python_objects(text: str) -> tuple[list[dict], list[str]]:
    """Objects and imported names of a Python file; none if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    lines, found, imports = text.split("\n"), [], []

    def visit(node: ast.AST, owner: str | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Import):
                imports.extend(a.name for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.extend(f"{child.module}.{a.name}" if child.module else a.name for a in child.names if a.name != "*")
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                is_class = isinstance(child, ast.ClassDef)
                if is_class:
                    bases = " ".join(ast.unparse(b) for b in child.bases)
                    kinds, signature = ["class", "enum"] if "Enum" in bases else ["class"], lines[child.lineno - 1].strip()
                else:
                    kinds, signature = ["method" if in_class else "function"], f"def {child.name}({ast.unparse(child.args)})"
                calls = sorted({n.func.id if isinstance(n.func, ast.Name) else n.func.attr for n in ast.walk(child) if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))})
                name = f"{owner}.{child.name}" if owner else child.name
                content = "\n".join(lines[child.lineno - 1 : child.end_lineno])
                complexity = 1 + sum(isinstance(n, _DECISIONS) for n in ast.walk(child))
                for kind in kinds:
                    found.append(_row(kind, child.name, name, owner, child.lineno, child.end_lineno, ast.get_docstring(child), signature, content, calls, complexity, _nesting(child)))
                visit(child, name, is_class)
            else:
                visit(child, owner, in_class)

    visit(tree, None, False)
    return found, list(dict.fromkeys(imports))


def _blank(text: str) -> str:
    """The text with comments and strings blanked, lines and places kept."""
    pattern = r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def brace_objects(text: str, language: str) -> tuple[list[dict], list[str]]:
    """Objects and imported names of a file of a language with braces."""
    plain = _blank(text)
    lines, source = plain.split("\n"), text.split("\n")
    found: list[dict] = []
    stack: list[tuple[str | None, str | None, int]] = []  # (kind, qualified name, index in found) of open braces
    pending: tuple[str, str] | None = None
    package = re.search(r"^\s*package\s+([\w.]+)", plain, re.M)
    for no, line in enumerate(lines, 1):
        for part in re.findall(r"[{}]|[^{}]+", line):
            if part == "{":
                if pending:
                    kind, name = pending
                    owner = next((q for _, q, _ in reversed(stack) if q), None)
                    top = package[1] if package and not owner and language in ("java", "kotlin") else owner
                    qualified = f"{top}.{name}" if top else name
                    found.append(_row(kind, name, qualified, owner, no, no, None, source[no - 1].strip().rstrip("{").strip(), "", [], 1, 0))
                    stack.append((kind, qualified, len(found) - 1))
                    pending = None
                else:
                    stack.append((None, None, -1))
            elif part == "}":
                pending = None
                if stack and (at := stack.pop()[2]) >= 0:
                    _close(found[at], no, lines, source)
            else:
                in_class = bool(stack) and stack[-1][0] in ("class", "interface", "enum")
                if m := _CLASS.search(part):
                    pending = ("enum" if m[1].startswith("enum") else m[1], m[2])
                elif m := _FUNCTION.search(part):
                    pending = ("method" if in_class else "function", m[1] or m[2])
                elif in_class and (m := _METHOD.match(part)) and m[1] not in NOT_CALLS and m[1] != "constructor":
                    pending = ("method", m[1])
    for _, _, at in stack:
        if at >= 0:
            _close(found[at], len(lines), lines, source)
    imports = [x.replace("/", ".").strip(".") for x in _IMPORT.findall(text)]
    return found, list(dict.fromkeys(x for x in imports if x))


def _close(row: dict, end: int, lines: list[str], source: list[str]) -> None:
    body = "\n".join(lines[row["start_line"] - 1 : end])
    row["end_line"] = end
    row["content"] = "\n".join(source[row["start_line"] - 1 : end])
    row["calls"] = sorted(set(_CALL.findall(body)) - NOT_CALLS - {row["name"]})
    row["cyclomatic"] = 1 + len(re.findall(r"\b(?:if|for|while|case|catch|when)\b|&&|\|\||\?[^.:?]", body))
    depth = most = 0
    for c in body:
        depth += (c == "{") - (c == "}")
        most = max(most, depth)
    row["nesting"] = max(0, most - 1)


def _capture(kind, name, line, scope):
    return {"kind": kind, "name": name, "line": line, "scope_name": scope[0], "scope_line": scope[1]}


def python_captures(text: str) -> list[dict]:
    """Names that a Python file uses, each with the definition around it.

    A name before a parenthesis is called, unless it follows a full stop; every
    other name is a reference; the bases of a class are extended.  What no
    function or class encloses is left out, as it has no source.
    """
    try:
        tree = ast.parse(text)
        tokens = [t for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type in (tokenize.NAME, tokenize.OP)]
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError):
        return []
    lines = text.split("\n")
    place = lambda line, column: (line, len(lines[line - 1].encode()[:column].decode("utf-8", "ignore")))
    nodes = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    scopes = sorted((place(n.lineno, n.col_offset), place(n.end_lineno, n.end_col_offset), n.name) for n in nodes)
    out = [_capture("EXTENDS", ast.unparse(b), b.lineno, (n.name, n.lineno)) for n in nodes if isinstance(n, ast.ClassDef) for b in n.bases if isinstance(b, (ast.Name, ast.Attribute))]
    open_, k = [], 0
    for i, t in enumerate(tokens):
        while k < len(scopes) and scopes[k][0] <= t.start:
            open_.append(scopes[k])
            k += 1
        while open_ and open_[-1][1] <= t.start:
            open_.pop()
        if t.type != tokenize.NAME or keyword.iskeyword(t.string) or not open_:
            continue
        before, after = tokens[i - 1].string if i else "", tokens[i + 1].string if i + 1 < len(tokens) else ""
        called = after == "(" and before not in (".", "def", "class")
        out.append(_capture("CALLS" if called else "REFERENCES", t.string, t.start[0], (open_[-1][2], open_[-1][0][0])))
    return out


def script_captures(text: str) -> list[dict]:
    """The same for JavaScript and TypeScript.  Property names, keys of objects
    and implemented types are no references; a called member is none either."""
    plain = _blank(text)
    ends = [m.start() for m in re.finditer("\n", plain)]
    tokens = [(m[0], m.start()) for m in re.finditer(r"[A-Za-z_$][\w$]*|=>|[^\s\w]", plain)]
    out: list[dict] = []
    stack: list[tuple[str, int, bool] | None] = []  # (name, line, whether a class) of open braces
    pending: tuple[str, int, bool] | None = None
    parens = outer = angles = 0
    listed = ""
    for i, (t, at) in enumerate(tokens):
        before, after = tokens[i - 1][0] if i else "", tokens[i + 1][0] if i + 1 < len(tokens) else ""
        line = bisect.bisect_left(ends, at) + 1
        scope = pending or next((s for s in reversed(stack) if s), None)
        if t == "{":
            stack.append(pending if parens == outer else None)
            pending, listed = (None, "") if parens == outer else (pending, listed)
        elif t == "}":
            if stack:
                stack.pop()
        elif t in "()":
            parens += 1 if t == "(" else -1
        elif t == ";" and parens == outer:
            pending, listed = None, ""
        elif listed and t in "<>":
            angles += 1 if t == "<" else -1
        elif not re.match(r"[A-Za-z_$]", t):
            continue
        elif t in ("class", "function") and re.match(r"[A-Za-z_$*]", after) and before != ".":
            name = tokens[i + 2][0] if after == "*" and i + 2 < len(tokens) else after
            pending, outer, listed, angles = (name, line, t == "class"), parens, "", 0
        elif pending and pending[2] and t in ("extends", "implements"):
            listed, angles = t.upper(), 0
        elif listed == "IMPLEMENTS":
            if not angles and before != ".":
                out.append(_capture(listed, t, line, pending))
        elif stack and stack[-1] and stack[-1][2] and not pending and after == "(" and before != "." and t not in ("if", "for", "while", "switch", "catch", "return", "new"):
            pending, outer = (t, line, False), parens
        elif t in SCRIPT_WORDS or before == "." or not scope or before in "{," and after == ":":
            continue
        else:
            if listed == "EXTENDS" and not angles:
                out.append(_capture(listed, t, line, pending))
                if after != ".":
                    listed = ""
            named = before in ("new", "function") or before == "*" and i > 1 and tokens[i - 2][0] == "function"
            out.append(_capture("CALLS" if after == "(" and not named else "REFERENCES", t, line, scope[:2]))
    return out


def heritage_captures(text: str, language: str) -> list[dict]:
    """Of Java and Kotlin, the types that classes implement; Kotlin's super
    type with a call of its constructor is extended, as is Java's."""
    plain, out = _blank(text), []
    for m in re.finditer(r"\b(?:class|interface)\s+(\w+)", plain):
        rest, scope = plain[m.end() :].split("{", 1)[0], (m[1], plain.count("\n", 0, m.start()) + 1)
        line = lambda at, m=m: plain.count("\n", 0, m.end() + at) + 1
        if language == "kotlin":
            depth, start, rest = 0, None, rest.replace("->", "  ")
            for at, c in enumerate(rest):
                if c in "(<)>":
                    depth += 1 if c in "(<" else -1
                elif c == ":" and not depth and start is None:
                    start = at + 1
                elif c == "\n" and not depth and not re.search(r"[,:(]\s*$", rest[:at]) and not re.match(r"\s*[,:]", rest[at:]):
                    rest = rest[:at]
                    break
            for x in re.finditer(r"([\w.]+)\s*(<[^()]*?>)?\s*(\()?[^,]*(?:,|$)", rest[start:]) if start else ():
                out.append(_capture("EXTENDS" if x[3] else "IMPLEMENTS", x[1], line(start + x.start(1)), scope))
        else:
            while (flat := re.sub(r"<[^<>]*>", lambda x: re.sub(r"[^\n]", " ", x[0]), rest)) != rest:
                rest = flat
            for x in re.finditer(r"\b(extends|implements)\s+((?:[\w.]+\s*,\s*)*[\w.]+)", rest):
                out += [_capture(x[1].upper(), n[0], line(x.start(2) + n.start()), scope) for n in re.finditer(r"[\w.]+", x[2])]
    return out


def captures_of(text: str, language: str) -> list[dict]:
    if language == "python":
        return python_captures(text)
    return script_captures(text) if language in ("javascript", "typescript") else heritage_captures(text, language)


CAPTURE = pa.struct([("kind", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("scope_name", pa.string()), ("scope_line", pa.int32())])


ITEM = pa.struct([("object_type", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("parent_name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("docstring", pa.string()), ("signature", pa.string()), ("content", pa.string()), ("calls", pa.list_(pa.string())), ("cyclomatic", pa.int32()), ("nesting", pa.int32())])
FIELDS = [f.name for f in ITEM]
_TYPES = {"start_line": "int", "end_line": "int", "cyclomatic": "int", "nesting": "int", "calls": "array<string>"}

#: Bytes of text that are read at a time: what is found in it is many times larger.
READ_BYTES = 1 << 19


def extract(files: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """``file_path, language, objects, imports, captures`` of code files
    (``file_path, language, content``); null content counts as empty.  Objects
    have the given fields."""
    item = pa.struct([f for f in ITEM if f.name in fields])
    inner = ", ".join(f"{f.name}: {_TYPES.get(f.name, 'string')}" for f in item)

    def run(batches):
        for batch in by_bytes(batches, "content", READ_BYTES):
            _, languages, texts = (c.to_pylist() for c in batch.columns)
            found = [(python_objects(t or "") if g == "python" else brace_objects(t or "", g)) for g, t in zip(languages, texts, strict=True)]
            used = [captures_of(t or "", g) for g, t in zip(languages, texts, strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.list_(item)), pa.array([x for _, x in found], pa.list_(pa.string())), pa.array(used, pa.list_(CAPTURE))]
            yield pa.RecordBatch.from_arrays(columns, ["file_path", "language", "objects", "imports", "captures"])

    schema = f"file_path string, language string, objects array<struct<{inner}>>, imports array<string>, captures array<struct<kind: string, name: string, line: int, scope_name: string, scope_line: int>>"
    return files.select("file_path", "language", "content").mapInArrow(run, schema)


def split_classes(extracted: DataFrame, most_chars: int = CLASS_CHARS, most_methods: int = CLASS_METHODS) -> DataFrame:
    """``extracted`` with ``is_summary`` for every object: a class of more
    characters or methods than given keeps, as its content, its declaration,
    docstring, fields and the signatures of its methods.  The methods are
    objects of their own either way.

    Works within each file's nested objects, without a shuffle.  Fields are
    lines of the class outside its inner objects that assign or end with a
    semicolon.
    """
    inner = lambda o: F.filter("objects", lambda m: (m["parent_name"] == o["qualified_name"]) & (m["start_line"] >= o["start_line"]) & (m["end_line"] <= o["end_line"]) & ~((m["start_line"] == o["start_line"]) & (m["end_line"] == o["end_line"]) & (m["name"] == o["name"])))

    def split(o: Column) -> Column:
        def summary(children: Column) -> Column:
            methods = F.filter(children, lambda m: m["object_type"] == "method")
            line_no = lambda i: o["start_line"] + i
            own = F.filter(F.split(o["content"], "\n"), lambda _, i: (i > 0) & ~F.exists(children, lambda m: line_no(i).between(m["start_line"], m["end_line"])))
            fields = F.filter(F.transform(own, lambda x: F.trim(x)), lambda x: F.rlike(x, F.lit(r"^[\w\[\]<>,.?@: \t]+=(?!=)|^[\w\[\]<>,.? \t]+;$")))
            parts = F.concat(F.array(o["signature"]), F.array(o["docstring"]), fields, F.transform(methods, lambda m: m["signature"]))
            large = (o["object_type"] == "class") & ((F.length(o["content"]) > most_chars) | (F.size(methods) > most_methods))
            return F.struct(
                *[o[f].alias(f) if f != "content" else F.when(large, F.array_join(F.array_compact(parts), "\n\n")).otherwise(o["content"]).alias(f) for f in FIELDS],
                F.coalesce(large, F.lit(False)).alias("is_summary"),
            )

        return bound(inner(o), summary)

    return extracted.withColumn("objects", F.transform("objects", split))


def captures(extracted: DataFrame) -> DataFrame:
    """A row per capture, for ``graph.capture_edges``."""
    return extracted.select("file_path", F.explode("captures").alias("c")).select("file_path", "c.*")


#: Bytes of text whose objects and captures one task relates.
FILE_BYTES = 1 << 20

#: What is needed of an object to relate it to captures.
END = ("object_type", "name", "start_line", "end_line")


def captures_and_objects(files: DataFrame) -> DataFrame:
    """``file_path`` with either an object ``o`` (ordinal in the file, id, name,
    start_line) or a capture ``c``, for ``graph.edges_of_files``: files are
    read once and dealt, a row each, to partitions that grow with the text in
    number and not in size."""
    spark = files.sparkSession
    size = files.agg(F.coalesce(F.sum(F.octet_length("content").cast("long")), F.lit(0))).first()[0]
    found = extract(spread(files), END).select("file_path", "objects", "captures").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES)), "file_path")
    ident = lambda o: object_id(F.col("file_path"), *[o[f] for f in ("name", "object_type", "start_line", "end_line")])
    own = F.transform("objects", lambda o, n: F.struct(F.struct(n.alias("ordinal"), ident(o).alias("id"), o["name"].alias("name"), o["start_line"].alias("start_line")).alias("o"), F.lit(None).alias("c")))
    used = F.transform("captures", lambda c: F.struct(F.lit(None).alias("o"), c.alias("c")))
    return found.select("file_path", F.inline(F.concat(own, used)))


def objects(extracted: DataFrame) -> DataFrame:
    """A row per object with its id, order in the project and parent's id."""
    rows = extracted.select("file_path", "language", F.posexplode("objects").alias("n", "o")).select("file_path", "language", "n", "o.*")
    key = lambda prefix="": object_id(*[F.col(prefix + c) for c in ("file_path", "name", "object_type", "start_line", "end_line")])
    rows = rows.withColumn("id", key()).withColumn("ordinal", F.struct("file_path", "n"))
    parents = rows.where(F.col("object_type").isin("class", "interface", "enum", "function", "method")).select("file_path", F.col("qualified_name").alias("parent_name"), F.col("id").alias("parent_id"), "n")
    first = parents.groupBy("file_path", "parent_name").agg(F.min_by("parent_id", "n").alias("parent_id"))
    # as large as the rows in the end, whatever Spark takes the texts' size to be
    return rows.join(first.hint("merge"), ["file_path", "parent_name"], "left").drop("n")
