"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step inside a task handles at a time.
STEP_BYTES = 2 << 20

#: Bytes, at most, of the rows that the JVM hands to Python workers at a time,
#: or one row; Spark's own bound is 64 MB, which both sides hold several times.
BATCH_BYTES = 2 << 20

#: The six ASCII white-space characters between words.
WORD_SPACE = " \t\n\x0b\x0c\r"

LOWER_ASCII = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


#: Keys of more than one row in so many are joined by a broadcast of their own.
HOT = 1000

#: What a worker keeps, and the stage that last asked for it.
_KEPT: dict[tuple, tuple[int | None, object]] = {}

_LOCAL: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}
#: The folder of each table that ``written`` has returned.
_TABLES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Where that setting is absent, a local session uses a folder of its machine
    and any other is an error.  ``clear_scratch`` deletes the folders.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(context.applicationId)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
    path = f"{root.rstrip('/')}/lodestone-{uuid.uuid4().hex}"
    _MADE.setdefault(context.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Deletes the tables and files that this session has put into the shared
    folder, and returns their number.  DataFrames made before then no longer
    work, so their results have to be stored first."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        store, place = pafs.FileSystem.from_uri(path)
        if store.get_file_info(place).type != pafs.FileType.NotFound:
            store.delete_dir(place)
    return len(made)


def written(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: it survives lost executors and
    later steps do not compute it again.

    Rows of megabytes need ``group_bytes``: Parquet looks at the size of what
    it holds after 100 rows only, and a row group is read in one piece.  With
    it, both are cut at so many bytes, or one row."""
    path = scratch_dir(df.sparkSession)
    rows = df.write
    if group_bytes:
        rows = rows.options(**{"parquet.block.size": group_bytes, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1})
    rows.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _TABLES[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` returned and that no DataFrame still to
    be computed reads; of others it takes no notice.  Spark's own interface to
    the store deletes them, so any store that Spark can write to will do."""
    for table in tables:
        if path := _TABLES.pop(table, None):
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def reading(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, the only reader of ``table`` from now on: discarding the one
    deletes the other."""
    if table in _TABLES:
        _TABLES[df] = _TABLES[table]
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as keep it apart from the columns."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on exchanges at most ``BATCH_BYTES`` (or
    less, where it is set so) with Python at a time."""
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    held = spark.conf.get(name)
    bound = re.fullmatch(r"(\d+)b?", held)
    if not bound or not 0 < int(bound[1]) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df


def join_unique(rows: DataFrame, unique: DataFrame, keys: list[str], counts: DataFrame, n: str, total: int) -> DataFrame:
    """``rows`` joined to ``unique``, which has one row per key, neither with
    null keys.  ``counts`` has the number ``n`` of each key's rows.

    A key of more than one row in ``HOT`` would make one task large.  Of such
    keys there are fewer than ``HOT``, whatever the input, so they are joined by
    a broadcast and never shuffled by the key.
    """
    held = counts.where(F.col(n) * HOT > total).select(*keys)
    found = held.collect()
    if not found:
        return rows.join(unique, keys)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, held.schema))
    return rows.join(F.broadcast(unique.join(hot, keys, "left_semi")), keys).unionByName(rows.join(hot, keys, "left_anti").join(unique, keys))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, under the names the operator uses, whatever
    else ``df`` holds."""
    return small_batches(df).select(*[df[old].alias(new) for new, old in columns.items()])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(array: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [x or "" for x in array.to_pylist()]


def steps(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about ``limit`` bytes of ``name``
    (a single longer text makes a step of its own)."""
    forget()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(column(batch, name)), 0), dtype=np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
    release()


def kept(key: tuple, make: Callable[[], object]):
    """What a worker keeps from task to task of a stage, made where it is not
    there; tasks of another stage drop it (see ``forget``)."""
    stage = _stage()
    found = _KEPT[key][1] if key in _KEPT else make()
    _KEPT[key] = (stage, found)
    return found


def forget() -> None:
    """Drops what this worker kept for tasks of other stages."""
    gone = [key for key, (stage, _) in _KEPT.items() if stage != _stage()]
    for key in gone:
        del _KEPT[key]
    if gone:
        release()


def _stage() -> int | None:
    context = TaskContext.get()
    return context.stageId() if context else None


def release() -> None:
    """Gives memory that a worker no longer uses back to the system, as workers
    live on for the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def cut_at_spaces(text: str) -> str | list[str]:
    """The text's parts, cut at each space that follows a character other than
    white space; or the text itself, where that means each of its spaces.

    No pretokeniser used here puts such a space into one token with what stands
    before it.  Hence the tokens of the first part, and of a space and each
    other part, are the tokens of the text.
    """
    if text[:1] == " " or _SPACE_AFTER_SPACE.search(text):
        return _CUT.split(text)
    return text


_SPACE_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")


def crc_of_id(name: str):
    """crc32 of the id's decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))
