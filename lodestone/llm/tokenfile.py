"""Token-id files with Elias-Fano coded document boundaries.

A file holds the concatenated ids of its documents in ascending order of
``doc_id``.  The boundaries, and the document ids themselves, are ascending
numbers; each list is split into low bits, stored as they are, and high bits
in unary.  Every ``SAMPLE``-th one bit's place is kept, so that ``select``
starts near its goal: about ``2 + log2(universe / n)`` bits a number, without a
table of 64-bit offsets.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, only, scratch_dir, steps, texts, written
from .encoders import word_encoder

MAGIC = b"LSEF1\0\0\0"
SAMPLE = 256
#: A file is closed once it has this many ids.
FILE_TOKENS = 4 << 20


class EliasFano:
    """An ascending list of non-negative integers, repeats allowed."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        low = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBII", self.n, self.low_bits, len(self.low), len(self.high)) + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The list, and where it ends in ``data``."""
        n, bits, low, high = struct.unpack_from("<QBII", data, at)
        at += struct.calcsize("<QBII")
        k = -(-n // SAMPLE)
        samples = np.frombuffer(data, "<u4", k, at)
        at += 4 * k
        found = cls(n, bits, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low), samples)
        return found, at + low + high

    def select(self, i: int) -> int:
        """The ``i``-th number, from 0, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE  # one bits still to pass after the sampled one
        byte, skip = place // 8, place % 8 + 1
        if left:
            window = int(self.high[byte]) >> skip << skip
            while (ones := window.bit_count()) < left:
                left -= ones
                byte += 1
                window = int(self.high[byte])
            for _ in range(left - 1):
                window &= window - 1
            place = byte * 8 + (window & -window).bit_length() - 1
        first = i * self.low_bits
        some = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (place - i) << self.low_bits | some >> first % 8 & (1 << self.low_bits) - 1

    def all(self) -> np.ndarray:
        """All numbers, as unsigned 64-bit integers."""
        if not self.n:
            return np.zeros(0, np.uint64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        values = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            low = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            values += low.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return values


def pack_file(doc_ids: list[int | None], documents: list[bytes], width: int) -> bytes:
    """A file of these documents' ids; null ``doc_ids`` come first."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(d) // width for d in documents])
    data = b"".join(documents)
    parts = [EliasFano.of(known.view(np.uint64) - np.uint64(base % (1 << 64))).to_bytes(), EliasFano.of(ends).to_bytes()]
    return b"".join([MAGIC, struct.pack("<BQqQ", width, nulls, base, len(data)), *parts, data])


class TokenFile:
    """A file read back: ``ends.select(i)`` is where document ``i`` ends."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-id file")
        self.width, self.nulls, self.base, size = struct.unpack_from("<BQqQ", data, 8)
        at = 8 + struct.calcsize("<BQqQ")
        self.ids, at = EliasFano.from_bytes(data, at)
        self.ends, at = EliasFano.from_bytes(data, at)
        if at + size != len(data):
            raise ValueError("a token-id file of the wrong length")
        self.tokens = np.frombuffer(data, f"<u{self.width}", offset=at)

    def __len__(self) -> int:
        return self.ends.n

    def doc_ids(self) -> list[int | None]:
        known = (self.ids.all() + np.uint64(self.base % (1 << 64))).view(np.int64)
        return [None] * self.nulls + known.tolist()

    def span(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        start, end = self.span(i)
        return self.tokens[start:end]


def write(documents: DataFrame, vocabulary: str, folder: str, end_id: int = 1, file_tokens: int = FILE_TOKENS, partitions: int | None = None, special: bool = False) -> DataFrame:
    """Encode all documents and write them to ``folder`` in ascending order of
    ``doc_id``; a row per file: ``file``, ``part``, ``piece``, ``n_docs``,
    ``n_tokens``.

    The rows are ranged by ``doc_id``, rows of one id by a hash of the text and
    of their place, so that neither a common id nor a repeated row makes a
    large range.  Each task writes its range as files of about ``file_tokens``
    ids.  A file is written under a name of its own and then moved, and a task
    that runs again writes the same files.
    """
    spark = documents.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = only(documents, doc_id="doc_id", text="text").withColumn("hash", F.xxhash64("text")).withColumn("place", F.xxhash64(F.monotonically_increasing_id()))
    ranged = keyed.repartitionByRange(n, "doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")

    def run(batches):
        encoder = word_encoder(vocabulary, True, special)
        width = encoder.dtype.itemsize
        end = np.array([end_id], encoder.dtype).tobytes()
        store, root = pafs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        ids: list[int | None] = []
        held: list[bytes] = []
        total, piece = 0, 0

        def close():
            name = f"part-{part:08d}-{piece:06d}.ids"
            store.create_dir(root, recursive=True)
            own = f"{root}/_{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(pack_file(ids, held, width))
            store.move(own, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), pa.array([piece], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64())], ["file", "part", "piece", "n_docs", "n_tokens"])

        for batch in steps(batches):
            for doc_id, data in zip(column(batch, "doc_id").to_pylist(), encoder.encode(texts(column(batch, "text"))), strict=True):
                ids.append(doc_id)
                held.append(data + end)
                total += len(held[-1]) // width
                if total >= file_tokens:
                    yield close()
                    ids.clear()
                    held.clear()
                    total, piece = 0, piece + 1
        if ids:
            yield close()

    return ranged.mapInArrow(run, "file string, part long, piece long, n_docs long, n_tokens long")


def first_ids(files: DataFrame) -> DataFrame:
    """``file`` and ``first`` (ids in all files before) of what ``write``
    lists.  Only the parts' sums, a row per range, are added up in one task."""
    sums = files.groupBy(F.col("part").alias("p__")).agg(F.sum("n_tokens").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select("p__", F.coalesce(F.sum("n").over(before(Window.orderBy("p__"))), F.lit(0)).alias("earlier"))
    within = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("piece"))), F.lit(0))
    placed = files.withColumn("within", within).join(earlier, F.col("part") == F.col("p__"))
    return placed.select("file", (F.col("earlier") + F.col("within")).alias("first"))


def read(folder: str, files: DataFrame) -> DataFrame:
    """A row per document from the files listed in ``files`` (``file``,
    ``first``: ids in all files before): ``doc_id``, ``start``, ``n_tokens``,
    ``ids_crc32``.  Boundaries are taken by ``select``.  A file is read whole,
    by one task; its size is bounded."""

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(column(batch, "file").to_pylist(), column(batch, "first").to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}") as data:
                    f = TokenFile(data.read())
                ends = np.fromiter(map(f.ends.select, range(len(f))), np.int64, len(f))
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(f.tokens[a:b].astype("<u4")) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids(), pa.int64()), pa.array(starts + first), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "first").repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(documents: DataFrame, vocabulary: str, end_id: int = 1, file_tokens: int = FILE_TOKENS, special: bool = False) -> DataFrame:
    """Writes all documents to the shared folder and reads them back.

    Defined cases: null and empty texts are the end id alone; null ids come
    first; rows of one id follow each other by a hash of their text; repeated
    rows are written one by one; an empty table gives no rows; columns other
    than ``doc_id`` and ``text`` are ignored; strings of special tokens are
    ordinary text unless ``special`` is set; a text of any length is one
    document of one file.
    """
    folder = scratch_dir(documents.sparkSession)
    return read(folder, first_ids(written(write(documents, vocabulary, folder, end_id, file_tokens, special=special))))
