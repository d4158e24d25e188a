"""Cost-balanced packing of token sequences.

A piece of ``n`` tokens costs ``linear * n + quadratic * n ** 2``, as attention
does.  Pieces go, in descending order, to the sequence of the lowest cost that
has room.  Pieces are packed within buckets; a bucket is a hash of the piece,
of the task and of how often the task had the same piece before, so that no id,
no text and no repeated row, however common, makes one large.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, forget, only, release, steps, texts
from .encoders import word_encoder

#: Sequence numbers within a bucket use this many bits.
LOCAL_BITS = 24

#: Text bytes that a step encodes: what its words need besides is many times that.
STEP_BYTES = 1 << 19

PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary, bucket long"
PACKED_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_lengths(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int, int]]:
    """Place pieces, given in descending order, into ``ceil(total / capacity)``
    sequences: tuples (piece, start in the piece, length, sequence, offset).

    Each goes whole to the lowest-cost sequence that can hold it (ties: the
    first).  Where none can, it is cut: the lowest-cost sequence with any room
    takes what fits, and the rest goes on in the same way.
    """
    total = int(lengths.sum())
    n = -(-total // capacity)
    room = np.full(n, capacity, dtype=np.int64)
    cost = np.zeros(n)
    placed = []
    for piece, left in enumerate(lengths.tolist()):
        start = 0
        while left:
            able = np.where(room >= left, cost, np.inf)
            at = int(able.argmin())
            take = left
            if able[at] == np.inf:
                at = int(np.where(room > 0, cost, np.inf).argmin())
                take = int(room[at])
            placed.append((piece, start, take, at, capacity - int(room[at])))
            room[at] -= take
            cost[at] += linear * take + quadratic * take * take
            start += take
            left -= take
    return placed


def token_pieces(documents: DataFrame, vocabulary: str, end_id: int, capacity: int, n_buckets: int, special: bool = False) -> DataFrame:
    """Each document's ids and ``end_id``, cut at multiples of ``capacity``."""

    def run(batches):
        encoder = word_encoder(vocabulary, special=special)
        task, had = TaskContext.get().partitionId(), Counter()
        dtype, width = encoder.dtype, encoder.dtype.itemsize
        end = np.array([end_id], dtype=dtype).tobytes()
        for batch in steps(batches, limit=STEP_BYTES):
            rows = []
            for doc_id, ids in zip(column(batch, "doc_id").to_pylist(), encoder.encode(texts(column(batch, "text"))), strict=True):
                ids += end
                n = len(ids) // width
                for start in range(0, n, capacity):
                    part = ids[start * width : (start + capacity) * width]
                    piece = zlib.crc32(part, zlib.crc32(f"{doc_id}:{start}".encode()))
                    bucket = zlib.crc32(struct.pack("<QQQ", piece, task, had[piece])) % n_buckets
                    had[piece] += 1
                    rows.append((doc_id, start, len(part) // width, n, part, bucket))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["doc_id", "start", "length", "doc_tokens", "ids", "bucket"])

    return only(documents, doc_id="doc_id", text="text").mapInArrow(run, PIECE_SCHEMA)


def pack(
    documents: DataFrame,
    vocabulary: str,
    end_id: int = 1,
    capacity: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    docs_per_bucket: int = 4096,
    bytes_per_bucket: int = 32 << 20,
    special: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns a row per piece with its ids (little-endian, two bytes each where
    the vocabulary allows).  At most one sequence's worth of padding arises per
    bucket of about ``docs_per_bucket`` documents or ``bytes_per_bucket`` of
    text, whichever is less; no bucket holds the ids of much more text, as each
    piece is dealt on its own.

    Defined cases: a null or empty text is a document of the end id alone;
    repeated rows are packed one by one; an empty table gives no rows; a null
    ``doc_id`` stays null; columns other than ``doc_id`` and ``text`` are
    ignored; a text longer than a sequence fills whole sequences first; pieces
    of one length go by id (nulls last), start and content; strings of special
    tokens are ordinary text unless ``special`` is set.
    """
    found = only(documents, text="text").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    n_buckets = max(1, math.ceil(found.n / docs_per_bucket), math.ceil(found.size / bytes_per_bucket))

    def run(table: pa.Table) -> pa.Table:
        forget()
        table = table.combine_chunks()
        lengths = np.asarray(table["length"], dtype=np.int64)
        ids, starts, data = (table[c].to_pylist() for c in ("doc_id", "start", "ids"))
        order = sorted(range(table.num_rows), key=lambda i: (-lengths[i], ids[i] is None, ids[i] or 0, starts[i], data[i]))
        whole = [i for i in order if lengths[i] == capacity]
        rest = [i for i in order if lengths[i] < capacity]
        placed = [(rest[p], s, n, at, offset) for p, s, n, at, offset in pack_lengths(lengths[rest], capacity, linear, quadratic)]
        first = -(-int(lengths[rest].sum()) // capacity)
        placed += [(i, 0, capacity, first + k, 0) for k, i in enumerate(whole)]
        doc_tokens, bucket = table["doc_tokens"].to_pylist(), table["bucket"][0].as_py()
        out = []
        for i, start, n, at, offset in placed:
            width = len(data[i]) // int(lengths[i])
            part = data[i][start * width : (start + n) * width]
            crc = zlib.crc32(np.frombuffer(part, f"<u{width}").astype("<u4").tobytes())
            out.append((ids[i], starts[i] + start, n, crc, doc_tokens[i], (bucket << LOCAL_BITS) | at, offset, part))
        del table, data
        kinds = [pa.int64()] * 7 + [pa.binary()]
        packed = pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        del out
        release()
        return packed

    return token_pieces(documents, vocabulary, end_id, capacity, n_buckets, special).groupBy("bucket").applyInArrow(run, PACKED_SCHEMA)


def padding(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Sequences, tokens and padding of a packed table.  A sequence is padded
    to ``capacity`` unless its length is a power of two."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    power = F.bit_count("used") == 1
    return used.agg(
        F.count("*").alias("sequences"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(power, 0).otherwise(capacity - F.col("used"))), F.lit(0)).alias("padding"),
    )
