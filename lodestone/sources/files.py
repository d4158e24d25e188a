"""Scanning source trees: files, ignore rules, statistics, project layout."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, language_of

# --- fixed values: kinds of files, default ignore patterns, build files ---
CODE_LANGUAGES = ("kotlin", "java", "python", "javascript", "typescript")
MARKDOWN_EXTENSIONS = ("md", "markdown")
CONFIG_EXTENSIONS = ("properties", "json", "yaml", "yml")
DEFAULT_IGNORES = (
    ".git/", ".svn/", ".hg/",
    "build/", "dist/", "target/", "*.class", "*.pyc", "__pycache__/",
    "node_modules/", "vendor/", "venv/", ".venv/",
    ".idea/", ".vscode/", "*.swp", "*.swo",
    ".coverage", "htmlcov/", "coverage/",
    "*.mp4", "*.mov", "*.avi", "*.mkv",
    "*.exe", "*.dll", "*.so", "*.dylib",
)
BUILD_FILES = ("build.gradle", "build.gradle.kts", "pom.xml", "package.json", "pyproject.toml", "setup.py")
# --- end of fixed values ---


def ignore_lines(text: str) -> list[str]:
    """The patterns of an ignore file, without blank lines and comments."""
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]


def pattern_regex(pattern: str) -> str:
    """A regular expression for one ignore pattern over a relative path.

    A pattern with a slash before its end is anchored at the root; one that
    ends with a slash matches folders, hence only what lies in them."""
    folder, body = pattern.endswith("/"), pattern.strip("/")
    anchored = "/" in pattern.rstrip("/")
    out = ""
    for part in re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]*\]|[^*?\[]+|\[", body):
        known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]", "[": r"\["}
        if part in known:
            out += known[part]
        elif part[0] == "[":
            out += "[" + ("^" + part[2:-1] if part[1] == "!" else part[1:-1]) + "]"
        else:
            out += re.sub(r"([\\.^$+(){}|\]])", r"\\\1", part)
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$"


def ignored(path: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Whether the last pattern that matches the relative path excludes it; a
    pattern after ``!`` includes again."""
    out = F.lit(False)
    for p in patterns:
        keep = p.startswith("!")
        out = F.when(F.rlike(path, F.lit(pattern_regex(p.removeprefix("!")))), not keep).otherwise(out)
    return out


def included(path: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Whether one of the patterns, read like those of an ignore file, matches."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(path, F.lit(pattern_regex(p)))
    return out


def file_kind(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return (
        F.when(extension.isin(*MARKDOWN_EXTENSIONS), "markdown")
        .when(extension.isin(*CONFIG_EXTENSIONS), "config")
        .when(language_of(path).isin(*CODE_LANGUAGES), "code")
    )


def scan(spark: SparkSession, root: str, ignores: list[str] | tuple[str, ...] = (), max_mb: float = 10.0, languages: tuple[str, ...] | None = None, includes: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``file_path`` (relative), ``kind``, ``language``, ``size``, ``content``
    of all files that are supported, not ignored and not too large.

    Paths and sizes are listed and filtered first, without content; tasks then
    open the files that are left below the root's own store, so that a name may
    hold any character.  A file that is not UTF-8 has a replacement character
    for each byte that is not.  A file is handed on by itself, which bounds what
    a task holds to one file of ``max_mb``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = base.getFileSystem(spark._jsc.hadoopConfiguration())
    top = store.makeQualified(base).toString().rstrip("/") + "/"
    # Spark's path is the qualified one, as an unencoded text
    relative = F.when(F.startswith("path", F.lit(top)), F.substr("path", F.lit(len(top) + 1))).otherwise(F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", ""), "^" + re.escape(re.sub(r"^\w+:/*", "", top)), ""))
    rows = files.select(relative.alias("file_path"), F.col("length").alias("size"))
    rows = rows.where(F.col("size") <= int(max_mb * (1 << 20))).where(~ignored(F.col("file_path"), [*DEFAULT_IGNORES, *ignores]))
    if includes:
        rows = rows.where(included(F.col("file_path"), includes))
    rows = rows.withColumn("kind", file_kind(F.col("file_path"))).where("kind is not null").withColumn("language", language_of(F.col("file_path")))
    if languages:
        rows = rows.where((F.col("kind") != "code") | F.col("language").isin(*languages))
    # the reader has no filter on paths, so that tasks read the files left by the store's own interface
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    uri = store.getUri().toString()
    place = base.toUri().getPath().rstrip("/")

    def read(batches):
        opened = pafs.LocalFileSystem() if uri.startswith("file:") else pafs.FileSystem.from_uri(uri + "/")[0]
        for batch in batches:
            paths = batch.column(batch.schema.get_field_index("file_path")).to_pylist()
            for i, path in enumerate(paths):
                with opened.open_input_stream(f"{place}/{path}") as data:
                    text = data.read().decode("utf-8", "replace")
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*[one.column(one.schema.get_field_index(c)) for c in ("file_path", "kind", "language", "size")], pa.array([text])], ["file_path", "kind", "language", "size", "content"])

    return rows.repartition(n, "file_path").mapInArrow(read, "file_path string, kind string, language string, size long, content string")


def statistics(files: DataFrame) -> DataFrame:
    """Number of files by kind, and their total."""
    return files.rollup("kind").count().select(F.coalesce("kind", F.lit("total")).alias("kind"), F.col("count").alias("n_files"))


def modules(files: DataFrame, depth: int = 3) -> DataFrame:
    """Folders with a build file, down to ``depth``: ``module, build_files``."""
    folder = F.regexp_replace(F.col("file_path"), "/?[^/]*$", "")
    found = files.where(basename(F.col("file_path")).isin(*BUILD_FILES)).withColumn("module", F.when(folder == "", ".").otherwise(folder))
    return found.where(F.size(F.split("module", "/")) <= depth).groupBy("module").agg(F.array_sort(F.collect_set(basename(F.col("file_path")))).alias("build_files"))
