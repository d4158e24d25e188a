"""Scalar functions over names, paths and texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: lookup tables and patterns ---
LANGUAGE_OF_EXTENSION = {
    ".py": "python", ".pyw": "python", ".kt": "kotlin", ".kts": "kotlin", ".java": "java",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".md": "markdown", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".properties": "properties",
}
REVERSE_RELATION = {
    "CALLS": "CALLED_BY", "REFERENCES": "REFERENCED_BY", "EXTENDS": "EXTENDED_BY",
    "IMPLEMENTS": "IMPLEMENTED_BY", "IMPORTS": "IMPORTED_BY", "CONTAINS": "CONTAINED_BY",
}
TRANSLATION_CODE = {
    "ko": "kor_Hang", "en": "eng_Latn", "ja": "jpn_Jpan", "zh": "zho_Hans", "es": "spa_Latn", "fr": "fra_Latn",
    "de": "deu_Latn", "it": "ita_Latn", "pt": "por_Latn", "ru": "rus_Cyrl", "ar": "arb_Arab", "hi": "hin_Deva",
}
ENV_PATTERNS = (r"\$\{([A-Z_][A-Z0-9_]*)\}", r"\$([A-Z_][A-Z0-9_]*)", r"%([A-Z_][A-Z0-9_]*)%")
CODE_PATH_PATTERN = r"([\w/.\-]+\.(?:py|kt|java|ts|js|tsx|jsx))\b"
CONFIG_CLASS = r"([a-z][a-z0-9_]*\.)+[A-Z][a-zA-Z0-9_]*"
CONFIG_FILE = r"['\"]([^'\"]*\.(?:py|js|ts|java|kt|go|rs|cpp|c|h|sh))['\"]"
CONFIG_URL = r"https?://[^\s\"']+(?:\.git|/blob/|/tree/)"
# --- end of fixed values ---


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def object_id(*parts: Column) -> Column:
    """The deterministic id of a row: 32 hex digits of the joined parts."""
    return F.left(F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(32))


def short_id(*parts: Column) -> Column:
    """16 hex digits of the joined parts, as for chunks and projects."""
    return F.left(object_id(*parts), F.lit(16))


def checksum(text: Column) -> Column:
    """A content checksum of 16 hex digits; only its equality means anything.
    Built-in, so it is XXH64 of the text with the engine's own seed, 42."""
    return F.lpad(F.lower(F.hex(F.xxhash64(F.coalesce(text, F.lit(""))))), 16, "0")


def normal_path(path: Column) -> Column:
    """The path without one leading ``../``."""
    return F.regexp_replace(path, r"^\.\./", "")


def normal_id(text: Column) -> Column:
    return F.replace(text, F.lit("-"), F.lit(""))


def normal_project_id(text: Column) -> Column:
    """Lower case, other characters as hyphens, none at the ends; a name over
    63 characters keeps 50 and gets 10 digits of its hash."""
    clean = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9-]", "-"), F.lit("-"))
    long = F.concat(F.left(clean, F.lit(50)), F.lit("-"), F.left(F.sha1(clean), F.lit(10)))
    return F.when(clean == "", F.lit("default-project")).when(F.length(clean) > 63, long).otherwise(clean)


def language_of(path: Column) -> Column:
    """The language of a file by its extension; null if there is none."""
    return lookup(LANGUAGE_OF_EXTENSION, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def module_path(path: Column) -> Column:
    """A Python file's dotted module name, from ``src`` on if there is one."""
    return F.replace(F.regexp_replace(F.element_at(F.split(path, "/src/"), -1), r"\.py$", ""), F.lit("/"), F.lit("."))


def display_name(*names: Column, default: str = "Anonymous") -> Column:
    """The first name that is neither null nor empty."""
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names], F.lit(default))


def reverse_relation(kind: Column) -> Column:
    """The opposite of a forward relation type; null for a reverse one."""
    return lookup(REVERSE_RELATION, F.upper(kind))


def translation_code(language: Column) -> Column:
    return F.coalesce(lookup(TRANSLATION_CODE, F.lower(language)), F.lit("eng_Latn"))


def score_weight(n_tokens: Column, has_docstring: Column, is_qualified: Column) -> Column:
    """How much an object's text is worth, from 0.1 to 1.2: full from 20 tokens
    on, half to full from 10 on, in proportion below; a docstring adds 15 per
    cent and a qualified name 10."""
    base = F.when(n_tokens >= 20, 1.0).when(n_tokens >= 10, 0.5 + (n_tokens - 10) / 20).otherwise(F.greatest(F.lit(0.1), n_tokens / 10))
    bonus = 1.0 + F.when(has_docstring, 0.15).otherwise(0.0) + F.when(is_qualified, 0.10).otherwise(0.0)
    return F.least(F.greatest(base * bonus, F.lit(0.1)), F.lit(1.2))


def essential_lines(content: Column) -> Column:
    """The first line, and the first two later ones that return, assign,
    await, raise or yield."""
    lines = F.split(F.coalesce(content, F.lit("")), "\n")
    later = F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: F.rlike(x, F.lit("return|=|await|raise|yield")))
    return F.concat(F.slice(lines, 1, 1), F.slice(later, 1, 2))


def env_references(text: Column, percent: bool = True) -> Column:
    """Names of environment variables, sorted, each once."""
    some = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in ENV_PATTERNS[: 3 if percent else 2]]
    return F.array_sort(F.array_distinct(F.concat(*some)))


def code_references(text: Column) -> Column:
    """Names in back-ticks that begin with a capital, and paths of code files:
    an array of (name, type)."""
    names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("`([A-Z][A-Za-z0-9_]*)`"), F.lit(1))
    paths = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CODE_PATH_PATTERN), F.lit(1))
    mark = lambda kind: lambda x: F.struct(x.alias("name"), F.lit(kind).alias("type"))
    return F.concat(F.transform(names, mark("class")), F.transform(paths, mark("file")))


def config_format(content: Column) -> Column:
    """json if it parses as such, else properties by an "=", else yaml by a
    ":" in the first ten lines; null otherwise."""
    lines = F.array_join(F.slice(F.split(content, "\n"), 1, 10), "\n")
    json = F.trim(content).rlike(r"^[\{\[]") & F.try_parse_json(content).isNotNull()
    return F.when(json, "json").when(F.contains(content, F.lit("=")), "properties").when(F.contains(lines, F.lit(":")), "yaml")


def chunk_lines(full: Column, chunk: Column) -> Column:
    """First and last line of the chunk's first place in the text; (1, 1) if
    it is not there."""
    at = F.instr(full, chunk)
    breaks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    first = breaks(F.left(full, at - 1)) + 1
    there = (at > 0) & (F.length(chunk) > 0)
    return F.struct(F.when(there, first).otherwise(1).alias("start_line"), F.when(there, first + breaks(chunk)).otherwise(1).alias("end_line"))


def file_title(content: Column) -> Column:
    """The first level-one header among the first eleven lines."""
    heads = F.filter(F.slice(F.split(content, "\n"), 1, 11), lambda x: F.startswith(x, F.lit("# ")))
    return F.when(F.size(heads) > 0, F.trim(F.substr(heads[0], F.lit(3))))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")


def word_count(text: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def billed_tokens(text: Column) -> Column:
    """1.3 tokens a word, rounded down, for cost estimates and rate limits."""
    return F.floor(word_count(text) * 1.3).cast("int")


def batch_size(length: Column, base: Column) -> Column:
    """The batch for texts of up to ``length`` characters."""
    n = F.floor(length / 4)
    return F.when(n > 16384, 1).when(n > 8192, 2).when(n > 4096, 4).when(n > 2048, 8).when(n > 1024, 16).otherwise(base)


def with_instruction(kind: Column, text: Column, instructions: dict[str, str]) -> Column:
    """The text after the instruction of its kind; kinds without one have none."""
    return F.concat(F.coalesce(lookup(instructions, kind), F.lit("")), text)


def describe(kind: Column, name: Column, language: Column) -> Column:
    """One sentence on a code object."""
    return F.concat_ws(" ", F.initcap(kind), name, F.lit("in"), F.initcap(language))


def line_of_offset(content: Column, offset: Column) -> Column:
    """The line, from 1, of a byte offset into the text's UTF-8."""
    before = F.decode(F.substring(F.encode(F.coalesce(content, F.lit("")), "UTF-8"), F.lit(1), offset.cast("int")), "ISO-8859-1")
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def config_references(text: Column) -> Column:
    """What a config file names: qualified classes, quoted paths of code files
    and addresses in code repositories, an array of (name, type)."""
    kinds = {"class_reference": (CONFIG_CLASS, 0), "file_reference": (CONFIG_FILE, 1), "repository_url": (CONFIG_URL, 0)}
    mark = lambda kind: lambda x: F.struct(x.alias("name"), F.lit(kind).alias("type"))
    found = [F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(group)), mark(kind)) for kind, (p, group) in kinds.items()]
    return F.concat(*found)
