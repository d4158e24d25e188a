"""Language-model scores from a log-frequency Bloom filter.

An n-gram of count ``c`` is entered with each of the numbers 1 to
``1 + floor(log_base(c))``; asking for 1, 2, ... until a miss gives its
quantised count, never too low.  The filter is made of segments, each holding
the n-grams of one range of hashes; a task builds a segment, and workers get
them by broadcast, as many at a time as a bound in bytes allows.

The model mixes a word pair's share with the smoothed share of the word:
``p(w | u) = (1 - g) c(u, w) / c(u) + g p(w)``, ``p(w) = (c(w) + 0.5) /
(N + 0.5 (V + 1))``, with the filter's counts; after an unknown word it is
``p(w)``.  ``g`` is the share of pairs seen once among all pairs in training,
which estimates how often a pair is new.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, column, crc_of_id, discard, only, steps, texts, written

#: Counts are quantised to powers of this.
BASE = 1.5
LEVELS = 1 + math.floor(math.log(2**48) / math.log(BASE))
HASHES = 3
#: Bits for each entered number; with three hashes about 1 false hit in 30.
BITS_PER_ENTRY = 8
#: Bytes of filter and counts that one pass over the documents broadcasts.
BROADCAST_BYTES = 256 << 20
#: N-grams that should be in a segment.
SEGMENT_NGRAMS = 200_000
#: N-grams of either kind that a task holds before it adds them up and sends them on.
TASK_NGRAMS = 1 << 21

END, START = xxhash.xxh64_intdigest(b"\x00end"), xxhash.xxh64_intdigest(b"\x00start")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mixed(u * _A + w)


def word_key(w: np.ndarray) -> np.ndarray:
    """The filter's key of a single word."""
    return _mixed(w ^ _A)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_base(count)) of positive counts."""
    return np.searchsorted(_POWERS, counts, side="right")


_POWERS = np.ceil(BASE ** np.arange(LEVELS)).astype(np.int64)
#: The count that stands for each level: the middle of those quantised to it.
_MIDDLE = np.array([0.0, *[(a + max(a, b - 1)) / 2 for a, b in zip(_POWERS.tolist(), [*_POWERS[1:].tolist(), int(_POWERS[-1] * BASE)], strict=True)]])


def _bits(keys: np.ndarray, level: np.ndarray | int, sizes: np.ndarray | int):
    """The places of (key, level) in a segment of ``sizes`` bits."""
    h = _mixed(keys + np.asarray(level, np.uint64) * _A)
    step = (h >> np.uint64(32)) | np.uint64(1)
    low = h & np.uint64(0xFFFFFFFF)
    for k in range(HASHES):
        yield ((low + np.uint64(k) * step) % np.asarray(sizes, np.uint64)).astype(np.int64)


def build_segment(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The segment's bits, packed; at least 64."""
    levels = levels_of(counts)
    bits = np.zeros(max(64, -(-int(levels.sum()) * BITS_PER_ENTRY // 64) * 64), np.uint8)
    for level in range(1, int(levels.max()) + 1 if len(levels) else 1):
        some = keys[levels >= level]
        for at in _bits(some, level, len(bits)):
            bits[at] = 1
    return np.packbits(bits, bitorder="little")


@dataclass
class Filter:
    """Joined segments from ``lo`` on; a key's top bits name its segment."""

    bits: np.ndarray
    first: np.ndarray  # each segment's first bit
    size: np.ndarray  # and number of bits; 0: no keys
    shift: int
    lo: int = 0

    @classmethod
    def of(cls, parts: dict[int, bytes], shift: int, lo: int, hi: int) -> Filter:
        """``parts``: the bytes of those segments from ``lo`` to ``hi`` that
        have keys."""
        size = np.array([8 * len(parts.get(s, b"")) for s in range(lo, hi)], np.int64)
        bits = np.frombuffer(b"".join(parts[s] for s in sorted(parts)), np.uint8)
        return cls(bits, np.cumsum(size) - size, size, shift, lo)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which keys are of these segments."""
        segment = segment_of(keys, self.shift)
        return (segment >= self.lo) & (segment < self.lo + len(self.size))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts, as levels, of keys of these segments, by repeated
        probes; 0 where level 1 misses."""
        segment = segment_of(keys, self.shift) - self.lo
        first, size = self.first[segment], self.size[segment]
        level = np.zeros(len(keys), np.uint8)
        left = np.flatnonzero(size)
        for k in range(1, LEVELS + 1):
            hit = np.ones(len(left), bool)
            for at in _bits(keys[left], k, size[left]):
                at = at + first[left]
                hit &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            left = left[hit]
            if not len(left):
                break
            level[left] = k
        return level


def segment_of(keys: np.ndarray, shift: int) -> np.ndarray:
    return (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)


@dataclass
class Words:
    """A share of the words: exact counts by key, ascending, and the filter."""

    keys: np.ndarray
    counts: np.ndarray
    single: Filter


@dataclass
class Model:
    """What one pass broadcasts: a share of the words, of the pairs, or both."""

    words: Words | None
    pairs: Filter | None
    n: int
    v: int
    new_pairs: float


def tokenise(texts_: list[str], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, one after the other, each with its end
    token; and the number of tokens of each."""
    digest, get = xxhash.xxh64_intdigest, known.get
    flat: list[int] = []
    sizes = []
    for t in texts_:
        words = t.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()
        for w in words:
            h = get(w)
            if h is None:
                if len(known) > 300_000:
                    known.clear()
                h = known[w] = digest(w)
            flat.append(h)
        flat.append(END)
        sizes.append(len(words) + 1)
    return np.array(flat, np.uint64), np.array(sizes, np.int64)


def contexts(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each one; the start mark at the start of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = START
    return before


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, with the sum of its counts."""
    h, n = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.add.reduceat(n, first)


def count_ngrams(training: DataFrame, segments: int) -> DataFrame:
    """Rows (segment, kind, hash, n): kind 1 for words' keys, 2 for pairs.
    Tasks add up what they hold, about ``TASK_NGRAMS``, before the shuffle."""
    shift = 64 - (segments.bit_length() - 1)

    def rows(kind, h, n):
        return pa.RecordBatch.from_arrays([pa.array(segment_of(h, shift).astype(np.int32)), pa.array(np.full(len(h), kind, np.int8)), pa.array(h.view(np.int64)), pa.array(n)], ["segment", "kind", "hash", "n"])

    def run(batches):
        known: dict[bytes, int] = {}
        words: tuple[list, list] = ([], [])
        pairs: list[np.ndarray] = []
        for batch in steps(batches, limit=4 << 20):
            tokens, sizes = tokenise(texts(column(batch, "text")), known)
            h, n = np.unique(word_key(tokens), return_counts=True)
            words[0].append(h)
            words[1].append(n.astype(np.int64))
            if sum(map(len, words[0])) > TASK_NGRAMS:
                yield rows(1, *_summed(*words))
                words = ([], [])
            pairs.append(pair_hash(contexts(tokens, sizes), tokens))
            if sum(map(len, pairs)) > TASK_NGRAMS:
                yield rows(2, *np.unique(np.concatenate(pairs), return_counts=True))
                pairs = []
        if words[0]:
            yield rows(1, *_summed(*words))
        if pairs:
            yield rows(2, *np.unique(np.concatenate(pairs), return_counts=True))

    return training.select("text").mapInArrow(run, "segment int, kind byte, hash long, n long")


def _segments(training: DataFrame, segments: int) -> DataFrame:
    """A row per segment: its filters, and its words with their counts."""
    counted = count_ngrams(training, segments)
    parts = int(training.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = counted.repartition(min(segments, parts), "segment").groupBy("segment", "kind", "hash").agg(F.sum("n").alias("n"))

    def build(table: pa.Table) -> pa.Table:
        kind, hashes, n = (np.asarray(table[c]) for c in ("kind", "hash", "n"))
        hashes = hashes.astype(np.int64).view(np.uint64)
        word = kind == 1
        order = np.argsort(hashes[word])
        words, counts = hashes[word][order], n[word][order].astype(np.int64)
        columns = {
            "segment": pa.array([table["segment"][0].as_py()], pa.int32()),
            "single": [build_segment(words, counts).tobytes()],
            "pairs": [build_segment(hashes[~word], n[~word]).tobytes()],
            "words": [words.tobytes()],
            "counts": [counts.tobytes()],
            "once": [int((n[~word] == 1).sum())],
            "total": [int(counts.sum())],
            "v": [len(words)],
        }
        return pa.table(columns)

    return summed.groupBy("segment").applyInArrow(build, "segment int, single binary, pairs binary, words binary, counts binary, once long, total long, v long")


@dataclass
class Plan:
    """Counts of the corpus, and how its segments are dealt to passes: first
    ``word_shares``, then ``pair_shares``; one of each make one pass."""

    built: DataFrame
    segments: int
    word_shares: int
    pair_shares: int
    n: int
    v: int
    new_pairs: float

    def passes(self) -> list[tuple[tuple[int, int] | None, tuple[int, int] | None]]:
        """The ranges of segments of words and of pairs of each pass."""
        ranges = lambda n: [(k * self.segments // n, (k + 1) * self.segments // n) for k in range(n)]
        words, pairs = ranges(self.word_shares), ranges(self.pair_shares)
        if len(words) == len(pairs) == 1:
            return [(words[0], pairs[0])]
        return [*[(x, None) for x in words], *[(None, x) for x in pairs]]

    def model(self, words: tuple[int, int] | None, pairs: tuple[int, int] | None) -> Model:
        """One pass's share, fetched a few segments at a time."""
        shift = 64 - (self.segments.bit_length() - 1)

        def fetch(lo, hi, *names):
            found = {n: {} for n in names}
            for r in self.built.where(F.col("segment").between(lo, hi - 1)).select("segment", *names).toLocalIterator():
                for n in names:
                    found[n][r.segment] = bytes(r[n])
            return [found[n] for n in names]

        own = None
        if words:
            single, keys, counts = fetch(*words, "single", "words", "counts")
            joined = lambda x, kind: np.frombuffer(b"".join(x[s] for s in sorted(x)), kind)
            number = joined(counts, np.int64)
            own = Words(joined(keys, np.uint64), number.astype(np.min_scalar_type(int(number.max()) if len(number) else 0)), Filter.of(single, shift, *words))
        shared = Filter.of(*fetch(*pairs, "pairs"), shift, *pairs) if pairs else None
        return Model(own, shared, self.n, self.v, self.new_pairs)


def learn(training: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> Plan:
    """Counts all n-grams of ``training`` into segments, in the shared folder.

    The driver sees their sums alone.  Where words and pairs together pass
    ``broadcast_bytes``, both are dealt to as many passes as that bound asks."""
    rough = training.agg(F.sum(F.length("text"))).first()[0] or 0  # the n-grams are about a quarter of it
    segments = 1 << max(0, math.ceil(math.log2(max(1, rough / 4 / SEGMENT_NGRAMS))))
    built = written(_segments(training, segments))
    size = lambda *names: F.coalesce(F.sum(sum(F.octet_length(n) for n in names)), F.lit(0))
    count = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    r = built.agg(size("single", "words", "counts").alias("w"), size("pairs").alias("p"), count("once"), count("total"), count("v")).first()
    shares = (1, 1) if r.w + r.p <= broadcast_bytes else tuple(min(segments, -(-2 * x // broadcast_bytes)) for x in (r.w, r.p))
    return Plan(built, segments, *(max(1, x) for x in shares), r.total, r.v, (r.once + 0.5) / (r.total + 1))


STATE = "doc_id long, text string, held_out boolean, levels binary, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_with(docs: DataFrame, model: Model, last: bool):
    """One pass over rows of ``STATE``, and its broadcast.  ``levels`` has the
    quantised count of every token whose word has had its pass; the last pass
    leaves it and the text out."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        known: dict[bytes, int] = {}
        smooth = m.n + 0.5 * (m.v + 1)
        for batch in steps(batches, limit=2 << 20):
            tokens, sizes = tokenise(texts(column(batch, "text")), known)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            carried = column(batch, "levels").to_pylist()
            levels = np.concatenate([np.zeros(n, np.uint8) if x is None else np.frombuffer(x, np.uint8) for x, n in zip(carried, sizes.tolist(), strict=True)])
            sums = {c: np.asarray(column(batch, c)) for c in ("n_known", "base_score", "score")}
            if m.words:
                distinct, back = np.unique(tokens, return_inverse=True)
                keys = word_key(distinct)
                mine = m.words.single.holds(keys)
                exact = np.zeros(len(keys), np.int64)
                if len(m.words.keys):
                    at = np.minimum(np.searchsorted(m.words.keys, keys), len(m.words.keys) - 1)
                    exact = np.where(m.words.keys[at] == keys, m.words.counts[at], 0).astype(np.int64)
                found = np.zeros(len(keys), np.uint8)
                found[mine] = m.words.single.levels(keys[mine])
                levels = np.where(mine[back], found[back], levels)
                sums["n_known"] = sums["n_known"] + np.add.reduceat((exact > 0).astype(np.int64)[back], starts)
                sums["base_score"] = sums["base_score"] + np.add.reduceat(np.where(mine, np.log10((exact + 0.5) / smooth), 0.0)[back], starts)
            if m.pairs:
                count = np.minimum(_MIDDLE, m.n)[levels]
                in_context = np.empty(len(tokens))
                in_context[1:] = count[:-1]
                in_context[starts] = count[ends - 1]  # as many starts as ends
                keys, back = np.unique(pair_hash(contexts(tokens, sizes), tokens), return_inverse=True)
                mine = m.pairs.holds(keys)
                found = np.zeros(len(keys), np.uint8)
                found[mine] = m.pairs.levels(keys[mine])
                seen = np.minimum(_MIDDLE[found[back]], in_context)
                p = (count + 0.5) / smooth
                known_context = in_context > 0
                p[known_context] = (1 - m.new_pairs) * seen[known_context] / in_context[known_context] + m.new_pairs * p[known_context]
                sums["score"] = sums["score"] + np.add.reduceat(np.where(mine[back], np.log10(p), 0.0), starts)
            out = {"doc_id": column(batch, "doc_id"), "held_out": column(batch, "held_out"), "n_tokens": sizes, "train_tokens": np.full(len(sizes), m.n), **sums}
            if not last:
                out |= {"text": column(batch, "text"), "levels": pa.array([levels[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())}
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[c] for c in names)], names)

    fields = [x for x in STATE.split(", ") if not last or x.split(" ")[0] not in ("text", "levels")]
    names = [x.split(" ")[0] for x in fields]
    return docs.mapInArrow(run, ", ".join(fields)), held


def score(documents: DataFrame, folds: int = 5, held_fold: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out fold.

    Words are counted by their 64-bit hash.  Where filter and counts are larger
    than a broadcast may be, passes over the documents each add what their
    share of the words, then of the pairs, says; the sums so far and a byte per
    token are carried along with the texts in written tables, each of which
    goes when the next one stands, and no process holds more than one share.

    Defined cases: null and empty texts are the end token alone; a null id
    counts as the empty text in the fold; repeated rows count and are scored
    each; an empty table gives no rows; without training rows every count is
    0; a text of any length is scored whole; columns other than ``doc_id`` and
    ``text`` are ignored.
    """
    docs = only(documents, doc_id="doc_id", text="text").withColumn("held_out", crc_of_id("doc_id") % folds == held_fold)
    plan = learn(docs.where("not held_out"), broadcast_bytes)
    zero = lambda kind: F.lit(0).cast(kind)
    state = docs.select("doc_id", "text", "held_out", F.lit(None).cast("binary").alias("levels"), zero("long").alias("n_tokens"), zero("long").alias("n_known"), zero("long").alias("train_tokens"), zero("double").alias("base_score"), zero("double").alias("score"))
    passes = plan.passes()
    for k, share in enumerate(passes, 1):
        before, (state, held) = state, _score_with(state, plan.model(*share), k == len(passes))
        if k < len(passes):
            state = written(state)
            held.destroy()
            discard(before)
    discard(plan.built)
    return state
