"""Byte-level BPE in numpy: distinct pretokens in padded matrices.

Rows of about equal length form a matrix of token ids.  In each round every row
merges its leftmost pair of minimum rank, pairs are looked up in a hash table,
and the matrix is compacted.  A very long row is a matrix of its own.  Ids equal
ranks, as in files of that format.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import column, cut_at_spaces, only, steps, texts
from .wordcache import WordCache

#: Longer pretokens (in bytes) get a matrix of one row each, whose rounds merge
#: all pairs of the minimum rank at once.
LONG_PRETOKEN = 256
#: Entries of one matrix.
MATRIX_CELLS = 1 << 18
_NONE = np.int64(1) << 40
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> merged id, in an open-addressing hash table."""

    def __init__(self, tokens: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in tokens.items():
            for cut in range(1, len(token)):
                a, b = tokens.get(token[:cut]), tokens.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        values = np.array(merged, np.int64)
        self.shift = np.uint64(64 - max(4, int(2 * max(1, len(keys)) - 1).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.keys = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(size, _NONE)
        at, todo, self.probes = self._home(keys), np.arange(len(keys)), 0
        while len(todo):  # all keys that want a slot try at once; the first in a free slot stays
            self.probes += 1
            slots = at[todo]
            free = self.keys[slots] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, first = np.unique(slots[free], return_index=True)
            winners = todo[free][first]
            self.keys[at[winners]] = keys[winners]
            self.values[at[winners]] = values[winners]
            todo = np.setdiff1d(todo, winners, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, ``_NONE`` where a pair does not merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._home(keys)
        found = np.where(self.keys[at] == keys, self.values[at], _NONE)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != np.uint64(0xFFFFFFFFFFFFFFFF)))
        at = at[open_]
        for _ in range(self.probes):
            if not len(open_):
                break
            at = (at + 1) & self.mask
            hit = self.keys[at] == keys[open_]
            found[open_[hit]] = self.values[at[hit]]
            go = ~hit & (self.keys[at] != np.uint64(0xFFFFFFFFFFFFFFFF))
            open_, at = open_[go], at[go]
        return found


class ByteBPE:
    """Encoder and decoder for one ranks file and one pretoken pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.tokens = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = {i: t for t, i in self.tokens.items()}
        self.first = np.array([self.tokens[bytes([b])] for b in range(256)], np.int64)
        self.pattern = regex.compile(pattern)
        self.cache = WordCache(np.dtype("<u4"), lambda words: self._learn([f" {w}" for w in words]), self._learn)

    @functools.cached_property
    def pairs(self) -> PairTable:
        """Made on first use: decoders have none."""
        return PairTable(self.tokens)

    def encode_pretokens(self, pretokens: list[bytes]) -> list[np.ndarray]:
        """Ids of each pretoken."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pretokens)
        lengths = np.array([len(p) for p in pretokens], np.int64)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            n = int(lengths[order[at]])
            if n > LONG_PRETOKEN:
                out[order[at]] = self._by_rounds(pretokens[order[at]])
                at += 1
                continue
            width = max(4, 1 << max(0, n - 1).bit_length())  # lengths up to the next power of two share a matrix
            end = min(int(np.searchsorted(lengths[order], width, side="right")), at + max(1, MATRIX_CELLS // width))
            rows = order[at:end]
            for row, ids in zip(rows.tolist(), self._by_matrix([pretokens[i] for i in rows.tolist()], lengths[rows], width), strict=True):
                out[row] = ids
            at = end
        return out

    def _by_matrix(self, rows: list[bytes], lengths: np.ndarray, width: int) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        ids = self.first[raw]
        columns = np.arange(width)
        ids[columns >= lengths[:, None]] = -1
        done: list[np.ndarray | None] = [None] * len(rows)
        which, n = np.arange(len(rows)), lengths.copy()
        ranks = np.full((len(rows), width), _NONE)
        valid = columns[1:] < n[:, None]
        ranks[:, :-1][valid] = self.pairs(ids[:, :-1][valid], ids[:, 1:][valid])
        while len(which):
            best = ranks.argmin(axis=1)  # the leftmost minimum
            line = np.arange(len(which))
            go = ranks[line, best] < _NONE
            if not go.all():
                for i in np.flatnonzero(~go).tolist():
                    done[which[i]] = ids[i, : n[i]].copy()
                which, n, ids, ranks, best = which[go], n[go], ids[go], ranks[go], best[go]
                line = np.arange(len(which))
                if not len(which):
                    break
            ids[line, best] = ranks[line, best]
            # compaction: what stands right of the pair moves left by one
            source = columns[None, :-1] + (columns[None, :-1] > best[:, None])
            ids[:, :-1] = np.take_along_axis(ids, source, axis=1)
            ids[:, -1] = -1
            source = columns[None, :-1] + (columns[None, :-1] >= best[:, None] + 1)
            ranks[:, :-1] = np.take_along_axis(ranks, source, axis=1)
            ranks[:, -1] = _NONE
            n -= 1
            right = best + 1 < n
            ranks[line, best] = _NONE
            if right.any():
                ranks[line[right], best[right]] = self.pairs(ids[line[right], best[right]], ids[line[right], best[right] + 1])
            left = best > 0
            if left.any():
                ranks[line[left], best[left] - 1] = self.pairs(ids[line[left], best[left] - 1], ids[line[left], best[left]])
            if (most := int(n.max())) <= width // 2 and width > 4:
                width = max(4, most)
                ids, ranks, columns = ids[:, :width].copy(), ranks[:, :width].copy(), columns[:width]
        return done

    def _by_rounds(self, token: bytes) -> np.ndarray:
        """The same merges for one long pretoken, a matrix of one row: a round
        merges all pairs of the minimum rank from the left, unless merging one
        makes a pair of a lower rank, which would come first; then the leftmost
        alone is merged."""
        ids = self.first[np.frombuffer(token, np.uint8)]
        ranks = self.pairs(ids[:-1], ids[1:])
        while len(ranks) and (rank := ranks.min()) < _NONE:
            at = np.flatnonzero(ranks == rank)
            # of a run of overlapping pairs every other one, from the first
            opens = np.concatenate(([True], np.diff(at) > 1))
            run = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            new = np.full(len(at), rank)
            right = at + 2 < len(ids)
            if (self.pairs(new[right], ids[at[right] + 2]) < rank).any() or self._lower_left(ids, at, rank):
                at = at[:1]
            merged = ids.copy()
            merged[at] = rank
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = merged[keep]
            ranks = np.append(ranks, _NONE)[keep]
            now = np.flatnonzero(keep[: len(merged)])
            now = np.searchsorted(now, at)  # where the merged ones stand now
            for some in (now, now - 1):
                some = some[(some >= 0) & (some + 1 < len(ids))]
                ranks[some] = self.pairs(ids[some], ids[some + 1])
            ranks = ranks[: len(ids) - 1]
        return ids

    def _lower_left(self, ids: np.ndarray, at: np.ndarray, rank: int) -> bool:
        """Whether a merged pair and what stands before it, merged or not, make
        a pair of a lower rank."""
        at = at[at > 0]
        before = ids[at - 1]
        joined = np.isin(at - 2, at)
        new = np.full(len(at), rank)
        return bool((self.pairs(np.where(joined, rank, before), new) < rank).any() or (self.pairs(before, new) < rank).any())

    def _learn(self, pieces: list[str]) -> list[bytes]:
        parts = [self.pattern.findall(p) for p in pieces]
        pretokens = list(set().union(*parts))
        ids = {p: i.astype("<u4").tobytes() for p, i in zip(pretokens, self.encode_pretokens([p.encode("utf-8", "surrogatepass") for p in pretokens]), strict=True)}
        return [b"".join([ids[p] for p in part]) for part in parts]

    def encode(self, texts_: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.cache.encode(list(map(cut_at_spaces, texts_)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids in the form that ``encode`` returns."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    """One encoder per worker process."""
    return ByteBPE(path, pattern)


def encode(documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit) of every text.

    Defined cases: null and empty texts have no ids; rows are independent, so
    repeated rows give repeated results and an empty table none; a null
    ``doc_id`` stays null; other columns are ignored.
    """

    def run(batches):
        coder = byte_bpe(vocabulary, pattern)
        for batch in steps(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(coder.encode(texts(column(batch, "text"))), pa.binary())], ["doc_id", "ids"])

    return only(documents, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and the ``decoded`` bytes.

    Defined cases: null ids give null, empty ones empty bytes; repeated rows
    give repeated results; an empty table gives no rows; other columns are
    ignored; an id that the vocabulary lacks is an error.
    """

    def run(batches):
        coder = byte_bpe(vocabulary, pattern)
        for batch in steps(batches, "ids", 1 << 20):
            ids = column(batch, "ids")
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), ids, pa.array([None if x is None else coder.decode(x) for x in ids.to_pylist()], pa.binary())], ["doc_id", "ids", "decoded"])

    return only(encoded, doc_id="doc_id", ids="ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
