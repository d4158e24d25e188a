"""Token ids of texts, put together from those of their words.

A step's words are told apart by Arrow; only words not seen before go to the
encoder.  What is remembered of a word is a 128-bit hash and its ids, in flat
arrays of bounded size, not Python objects.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of hashes and ids that a worker remembers; beyond that it starts anew.
CACHE_BYTES = 64 << 20

_KEY = np.dtype([("high", ">u8"), ("low", ">u8")])


def _raw(words: pa.Array) -> list[bytes]:
    """The strings of an array as bytes, cut from its buffer."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else [0]
    data = words.buffers()[2].to_pybytes() if len(words) and words.buffers()[2] else b""
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class WordCache:
    """``learn`` gives the ids of words as bytes of ``dtype``; ``first`` those
    of words at the start of a text, where these differ."""

    def __init__(self, dtype: np.dtype, learn: Callable[[list[str]], list[bytes]], first: Callable[[list[str]], list[bytes]] | None = None, limit: int = CACHE_BYTES):
        self.dtype, self.learn, self.first, self.limit = dtype, learn, first, limit
        self._clear()

    def _clear(self) -> None:
        self.high, self.low = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.ids = np.zeros(0, self.dtype)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.high, self.low, self.start, self.size, self.ids))

    def _places(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Where each word stands among those remembered; -1: nowhere."""
        if not len(self.high):
            return np.full(len(high), -1)
        at = np.minimum(np.searchsorted(self.high, high), len(self.high) - 1)
        return np.where((self.high[at] == high) & (self.low[at] == low), at, -1)

    def _remember(self, high: np.ndarray, low: np.ndarray, ids: list[bytes]) -> None:
        size = np.array([len(x) // self.dtype.itemsize for x in ids], np.uint32)
        start = (len(self.ids) + np.cumsum(size) - size).astype(np.uint32)
        order = np.argsort(high)
        at = np.searchsorted(self.high, high[order], "right")
        for name, new in (("high", high), ("low", low), ("start", start), ("size", size)):  # one at a time, as each is copied
            setattr(self, name, np.insert(getattr(self, name), at, new[order]))
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), self.dtype)])

    def _spans(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of each word's ids in ``self.ids``."""
        if self.nbytes() > self.limit:
            self._clear()
        raw = _raw(words)
        keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw)), _KEY)
        high, low = keys["high"].astype(np.uint64), keys["low"].astype(np.uint64)
        at = self._places(high, low)
        new = np.flatnonzero(at < 0)
        if len(new):
            self._remember(high[new], low[new], self.learn([raw[i].decode() for i in new.tolist()]))
            at = self._places(high, low)
        return self.start[at].astype(np.int64), self.size[at].astype(np.int64)

    def encode(self, texts: list[str | list[str]]) -> list[bytes]:
        """The ids of every text, given as the text, to be cut at each space,
        or as the list of its words (one at least)."""
        if not texts:
            return []
        whole = [i for i, t in enumerate(texts) if isinstance(t, str)]
        listed = [i for i, t in enumerate(texts) if not isinstance(t, str)]
        split = [pc.split_pattern(pa.array([texts[i] for i in whole], pa.string()), " ")] if whole else []
        if listed:
            split.append(pa.array([texts[i] for i in listed], pa.list_(pa.string())))
        lists = pa.concat_arrays(split)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        start, size = self._spans(words)
        ids = self.ids
        if self.first:
            at = np.concatenate(([0], ends[:-1]))
            some, which = np.unique(codes[at], return_inverse=True)
            own = self.first(words.take(pa.array(some)).to_pylist())
            own_size = np.array([len(x) // self.dtype.itemsize for x in own], np.int64)
            codes[at] = len(words) + which
            start = np.concatenate([start, len(ids) + np.cumsum(own_size) - own_size])
            size = np.concatenate([size, own_size])
            ids = np.concatenate([ids, np.frombuffer(b"".join(own), self.dtype)])
        n = size[codes]
        upto = np.cumsum(n)
        out = ids[np.repeat(start[codes] - (upto - n), n) + np.arange(upto[-1])].tobytes()
        cuts = [0, *(upto[ends - 1] * self.dtype.itemsize).tolist()]
        found = dict(zip([*whole, *listed], zip(cuts, cuts[1:], strict=False), strict=True))
        return [out[a:b] for a, b in map(found.__getitem__, range(len(texts)))]
