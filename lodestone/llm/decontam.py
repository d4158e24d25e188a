"""Benchmark decontamination by a broadcast hash set of windows of words.

A benchmark item gives every window of ten of its consecutive words, or all of
its words where it has fewer.  The windows' hashes are broadcast; tasks slide
over the words of the training texts, look each window up, and verify every hit
by comparing the words themselves.  What was hit can be cut out, or the whole
document left out.

A word of a text that no item has gets number 0, and windows with such a word
are passed over.  As numbers stand for words one to one, comparing numbers
compares words.

The set is made of shares of bounded size.  One share, which is the usual case,
takes one pass over the texts; more shares take one pass each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, discard, only, small_batches, steps, texts, written

WINDOW = 10
#: What a share may cost: a byte for each byte of its words, and more for each word.
SHARE_BYTES, WORD_BYTES = 64 << 20, 80
#: Words of an item that are kept in one piece; longer items go in pieces that overlap.
PIECE_WORDS = 1 << 15

_LETTERS = bytes(c for c in range(256) if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122)
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c in _LETTERS else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The normalised words: A-Z in lower case; letters, digits and all beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def _hashed(numbers: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window of ``length`` numbers from the places ``at`` on."""
    spread = numbers.astype(np.uint64) * _STEP
    spread ^= spread >> np.uint64(29)
    h = np.full(len(at), length, np.uint64)
    for k in range(length):
        h = (h + spread[at + k]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


@dataclass
class Windows:
    """The distinct windows of one length, by ascending hash, and their items."""

    length: int
    hashes: np.ndarray
    numbers: np.ndarray  # a row of word numbers for each
    first: np.ndarray  # where its items begin in ``items``
    items: np.ndarray

    @classmethod
    def of(cls, length: int, rows: np.ndarray, owners: np.ndarray) -> Windows:
        distinct, back = np.unique(rows, axis=0, return_inverse=True)
        hashes = _hashed(distinct.ravel(), np.arange(len(distinct)) * length, length)
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs = np.unique(np.stack([place[back.ravel()], owners]), axis=1)
        return cls(length, hashes[order], distinct[order], np.searchsorted(pairs[0], np.arange(len(order) + 1)), pairs[1].astype(np.int32))

    def hits(self, numbers: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where one of the windows stands, and its number.  ``left``:
        how many words the text has from each place on."""
        if len(numbers) < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        unknown = np.concatenate(([0], np.cumsum(numbers == 0)))
        at = np.flatnonzero((unknown[self.length :] == unknown[: -self.length]) & (left[: len(numbers) - self.length + 1] >= self.length))
        h = _hashed(numbers, at, self.length)
        k = np.searchsorted(self.hashes, h)
        places, found = [], []
        while len(at):  # windows of one hash stand one after the other
            k_ = np.minimum(k, len(self.hashes) - 1)
            same = (k < len(self.hashes)) & (self.hashes[k_] == h)
            at, h, k = at[same], h[same], k[same]
            if not len(at):
                break
            equal = (numbers[at[:, None] + np.arange(self.length)] == self.numbers[k]).all(axis=1)
            places.append(at[equal])
            found.append(k[equal])
            at, h, k = at[~equal], h[~equal], k[~equal] + 1
        return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Share:
    """What one pass broadcasts."""

    words: bytes  # the vocabulary, joined by spaces; numbers count from 1
    item_ids: list[str]
    windows: list[Windows]

    @classmethod
    def of(cls, pieces: list[tuple[str, bytes]]) -> Share:
        """``pieces``: (item id, normalised words)."""
        numbers: dict[bytes, int] = {}
        ids = {item: i for i, item in enumerate(sorted({item for item, _ in pieces}))}
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for item, text in pieces:
            own = np.array([numbers.setdefault(w, len(numbers) + 1) for w in text.split()], np.int32)
            length = min(WINDOW, len(own))
            some = np.lib.stride_tricks.sliding_window_view(own, length)
            rows.setdefault(length, []).append(some)
            owners.setdefault(length, []).append(np.full(len(some), ids[item], np.int64))
        return cls(b" ".join(numbers), list(ids), [Windows.of(n, np.concatenate(rows[n]), np.concatenate(owners[n])) for n in sorted(rows)])

    @cached_property
    def numbers(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words.split(), 1)}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "numbers"}


def _pieces(benchmark: DataFrame) -> DataFrame:
    """``item_id`` (as text) and ``words`` of all items that have words."""

    def run(batches):
        for batch in steps(batches):
            ids, kept = [], []
            for item, text in zip(column(batch, "item_id").to_pylist(), texts(column(batch, "text")), strict=True):
                words = words_of(text)
                for a in range(0, max(1, len(words) - WINDOW + 1) if words else 0, PIECE_WORDS):
                    ids.append(item or "")
                    kept.append(b" ".join(words[a : a + PIECE_WORDS + WINDOW - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kept, pa.binary())], ["item_id", "words"])

    named = only(benchmark, item_id="item_id", text="text").withColumn("item_id", F.col("item_id").cast("string"))
    return named.mapInArrow(run, "item_id string, words binary")


def shares(benchmark: DataFrame, share_bytes: int = SHARE_BYTES) -> Iterator[Share]:
    """The hash set in shares of at most ``share_bytes`` (or of one piece of an
    item), made one after the other; always one at least."""
    cost = F.octet_length("words") + WORD_BYTES * (F.length(F.regexp_replace(F.col("words").cast("string"), "[^ ]", "")) + 1)
    pieces = written(_pieces(benchmark).withColumn("cost", cost))
    total = pieces.agg(F.sum("cost")).first()[0] or 0
    held, size, some = [], 0, False
    for r in pieces.collect() if total <= share_bytes else pieces.toLocalIterator():
        if held and size + r.cost > share_bytes:
            yield Share.of(held)
            held, size, some = [], 0, True
        held.append((r.item_id, bytes(r.words)))
        size += r.cost
    discard(pieces)
    if held or not some:
        yield Share.of(held)


STATE = "items array<string>, spans array<struct<first: long, last: long>>, n_words long, n_hit long"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _pass(rows: DataFrame, share: Share, schema: str):
    """``rows`` (row, text, and the state so far) after one share's pass, and
    the broadcast."""
    held = rows.sparkSession.sparkContext.broadcast(share)

    def run(batches):
        s = held.value
        for batch in steps(batches):
            flat: list[bytes] = []
            sizes = []
            for t in texts(column(batch, "text")):
                words = words_of(t)
                flat += words
                sizes.append(len(words))
            numbers = np.fromiter(map(s.numbers.get, flat, repeat(0)), np.int32, len(flat))
            sizes = np.array(sizes, np.int64)
            ends = np.cumsum(sizes)
            left = np.repeat(ends, sizes) - np.arange(len(flat))
            edge = np.zeros(len(flat) + 1, np.int64)
            found = []
            for w in s.windows:
                at, which = w.hits(numbers, left)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + w.length, -1)
                doc = np.searchsorted(ends, at, side="right")
                pairs = np.unique(doc * len(w.hashes) + which)
                doc, which = np.divmod(pairs, max(1, len(w.hashes)))
                n = w.first[which + 1] - w.first[which]
                offsets = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append(np.unique(np.repeat(doc, n) * len(s.item_ids) + w.items[np.repeat(w.first[which], n) + offsets]))
            items = column(batch, "items").to_pylist()
            items = [set(x) for x in items]
            for pair in np.unique(np.concatenate(found)).tolist() if found else ():
                items[pair // len(s.item_ids)].add(s.item_ids[pair % len(s.item_ids)])
            starts = ends - sizes
            for i, spans in enumerate(column(batch, "spans").to_pylist()):
                for x in spans:
                    edge[starts[i] + x["first"]] += 1
                    edge[starts[i] + x["last"] + 1] -= 1
            hit = np.cumsum(edge)[:-1] > 0
            number = np.concatenate(([0], np.cumsum(hit)))
            # runs of hit words, none across texts
            new = hit.copy()
            new[1:] &= ~hit[:-1]
            new[starts[sizes > 0]] = hit[starts[sizes > 0]]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(flat)) if len(first) else first
            last = first + number[last] - number[first] - 1
            owner = np.searchsorted(ends, first, side="right")
            spans = [[] for _ in sizes]
            for i, a, b in zip(owner.tolist(), (first - starts[owner]).tolist(), (last - starts[owner]).tolist(), strict=True):
                spans[i].append({"first": a, "last": b})
            state = {"items": pa.array([sorted(x) for x in items], pa.list_(pa.string())), "spans": pa.array(spans, _SPANS), "n_words": pa.array(sizes), "n_hit": pa.array(number[ends] - number[starts])}
            yield pa.RecordBatch.from_arrays([column(batch, "row"), column(batch, "text"), *state.values()], ["row", "text", *state])

    return rows.mapInArrow(run, schema), held


def scan(rows: DataFrame, benchmark: DataFrame, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """``row, text, items, spans, n_words, n_hit`` for ``rows`` (row, text):
    the ids of the items with a window in the text, sorted as strings, and the
    runs of hit words, by their numbers from 0.

    Where there are several shares, what each pass found is carried along in a
    written table, which goes when the next one stands.
    """
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, {STATE}"
    kinds = dict(x.split(" ", 1) for x in ("items array<string>", "spans array<struct<first: long, last: long>>"))
    state = rows.select("row", "text", *[F.array().cast(kind).alias(name) for name, kind in kinds.items()], *[F.lit(0).cast("long").alias(n) for n in ("n_words", "n_hit")])
    made = shares(benchmark, share_bytes)
    share, earlier = next(made), None
    while share is not None:
        later = next(made, None)
        state, held = _pass(state, share, schema)
        if later is not None:
            state = written(state)
            held.destroy()
            if earlier is not None:
                discard(earlier)
            earlier = state
        share = later
    return state


def contamination(documents: DataFrame, benchmark: DataFrame, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans`` of every document.

    Defined cases: null and empty texts have no words; an item without words
    has no window; an item of fewer than ten words is one window; items with
    equal ids count as one, one without an id as the empty text; repeated rows
    each get a row; a null ``doc_id`` stays null; without items nothing is hit;
    an empty table gives no rows; texts of any length are scanned whole; other
    columns are ignored.
    """
    rows = only(documents, doc_id="doc_id", text="text").select(F.struct("doc_id").alias("row"), "text")
    return scan(rows, benchmark, share_bytes).select("row.doc_id", "n_words", "n_hit", "items", "spans")


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def cut_spans(text: str, spans: list[dict]) -> str:
    """The text without the runs of words ``spans``; what stood between the
    words of a run goes too."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(data)]
    out, done = [], 0
    for x in spans:
        out.append(data[done : places[x["first"]][0]])
        done = places[x["last"]][1]
    return b"".join([*out, data[done:]]).decode("utf-8", "surrogatepass")


def decontaminated(documents: DataFrame, benchmark: DataFrame, remove: str = "spans", share_bytes: int = SHARE_BYTES) -> DataFrame:
    """``documents`` without what the benchmark has: ``remove="spans"`` cuts
    the hit words out of the texts, ``remove="documents"`` leaves out every
    document with a hit.  All columns stay.

    Defined cases: as for ``contamination``; a null text stays null; a text of
    hit words alone keeps what stands around them.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove must be spans or documents")
    found = scan(small_batches(documents).select(F.struct("*").alias("row"), F.col("text")), benchmark, share_bytes)
    if remove == "documents":
        return found.where("n_hit = 0").select("row.*")

    def run(batches):
        for batch in steps(batches):
            cut = [cut_spans(t, s) if s else t for t, s in zip(column(batch, "text").to_pylist(), column(batch, "spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(cut, pa.string())], ["row", "text"])

    cut = found.select("row", "text", "spans").mapInArrow(run, f"row {found.schema['row'].dataType.simpleString()}, text string")
    return cut.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in documents.columns])


ORACLE = r"""WITH lowered AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + 9], ' '))) AS s FROM item WHERE len(w) > 0),
place AS (SELECT rid, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM lowered, (SELECT DISTINCT k FROM win)),
hit AS (SELECT rid, i, p.k AS k, item_id FROM (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM place) p JOIN win ON win.k = p.k AND win.s = p.s),
word AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, i, k FROM hit)) GROUP BY 1),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN word USING (rid) LEFT JOIN items USING (rid)"""
