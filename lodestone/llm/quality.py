"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target
and the raw corpus, beside base rules on words and repetition.

Words and word pairs are hashed to buckets; the trusted documents and the whole
corpus each give a multinomial over the buckets.  A document's score is the sum
of log(p_target / p_raw) over its n-grams, divided by their number.  It passes
if the score is no less than the trusted documents' mean less some standard
deviations, both taken over all trusted documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches, steps, texts

#: Words whose hashes a task remembers at a time.
KNOWN_WORDS = 1 << 17
BUCKETS = 1 << 16
#: Standard deviations below the trusted mean at which a document fails.
DEVIATIONS = 4.0
#: Added to the count of every bucket.
PRIOR = 1.0
#: Trusted ids that are broadcast at most (16 MB).
BROADCAST_IDS = 1_000_000

_SYMBOL = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Base:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def _word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def base_counts(text: str, words: list[bytes]) -> Base:
    """Counts for the base rules; ``words`` are those of ``text``."""
    n = len(words)
    space = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in lines
            lines.add(line)
    repeat = 0
    if n > 3:
        ids = _word_ids(words)
        several = int(ids.max()) + 1
        if several < 2_000_000:
            keys = (ids[:-2] * several + ids[1:-1]) * several + ids[2:]
            _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
        else:
            _, back, counts = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True, return_counts=True)
        again = counts[back] > 1
        if again.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= again
            repeat = int(covered.sum())
    return Base(n, len(text) - space, len(_SYMBOL.findall(text)), dup, repeat)


def ngram_buckets(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbouring words."""
    hashes = []
    for w in words:
        h = known.get(w)
        if h is None:
            if len(known) > KNOWN_WORDS:
                known.clear()
            h = known[w] = xxhash.xxh64_intdigest(w) >> 1
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    pairs ^= pairs >> np.uint64(29)
    return np.concatenate([h, pairs]).view(np.int64) & (BUCKETS - 1)


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def trusted_mark(documents: DataFrame, trusted: DataFrame) -> DataFrame:
    """``documents`` with ``trusted__``: whether the id is among ``trusted``.

    Up to ``BROADCAST_IDS`` ids, which are counted first, are broadcast; more
    are joined by a shuffle, with the same result."""
    ids = trusted.select(F.col("doc_id").alias("trusted_id__")).where("trusted_id__ is not null").distinct()
    few = ids.count() <= BROADCAST_IDS
    return documents.join(F.broadcast(ids) if few else ids, documents["doc_id"] == ids["trusted_id__"], "left").withColumn("trusted__", F.col("trusted_id__").isNotNull()).drop("trusted_id__")


@dataclass
class Ratio:
    """The fitted rule: a log ratio per bucket, and the least score that passes."""

    log_ratio: np.ndarray
    threshold: float

    def score(self, buckets: np.ndarray) -> float:
        """0 for a document without words."""
        return float(self.log_ratio[buckets].sum() / len(buckets)) if len(buckets) else 0.0

    def passes(self, score: float) -> bool:
        return score >= self.threshold


def fit(documents: DataFrame, trusted: DataFrame, deviations: float = DEVIATIONS) -> Ratio:
    """Counts over all documents and over all trusted ones, in two passes.

    Each task adds up a vector per multinomial; only bucket sums are shuffled,
    and ``BUCKETS`` rows reach the driver, whatever the input.  Without trusted
    documents every ratio is 0 and every document passes.
    """
    marked = trusted_mark(documents.select("doc_id", "text"), trusted)

    def count(batches):
        raw, target, known = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), {}
        for batch in steps(batches):
            found = [ngram_buckets(_words(t), known) for t in texts(column(batch, "text"))]
            good = [x for x, g in zip(found, column(batch, "trusted__").to_pylist(), strict=True) if g]
            raw += np.bincount(np.concatenate(found), minlength=BUCKETS)
            if good:
                target += np.bincount(np.concatenate(good), minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    sums = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return Ratio(np.zeros(BUCKETS), -np.inf)
    share = lambda x: (x + PRIOR) / (x.sum() + PRIOR * BUCKETS)
    rule = Ratio(np.log(share(target)) - np.log(share(raw)), -np.inf)

    def moments(batches):
        n, s, s2, known = 0, 0.0, 0.0, {}
        for batch in steps(batches):
            for text in texts(column(batch, "text")):
                if words := _words(text):
                    x = rule.score(ngram_buckets(words, known))
                    n, s, s2 = n + 1, s + x, s2 + x * x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s]), pa.array([s2])], ["n", "s", "s2"])

    m = marked.where("trusted__").mapInArrow(moments, "n long, s double, s2 double").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2")).first()
    if not m.n:
        return rule
    mean = m.s / m.n
    # rounded, as the order of the sums is not fixed
    rule.threshold = round(mean - deviations * max(0.0, m.s2 / m.n - mean * mean) ** 0.5, 6)
    return rule


def judge(documents: DataFrame, rule: Ratio) -> DataFrame:
    """Base counts, ``score`` and verdicts of every document.

    Defined cases: null and empty texts have no words and fail; repeated rows
    give repeated results; an empty table gives no rows; a null ``doc_id``
    stays null; columns other than ``doc_id`` and ``text`` are ignored.
    """

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in steps(batches):
            rows = []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), texts(column(batch, "text")), strict=True):
                words = _words(text)
                b = base_counts(text, words)
                score = rule.score(ngram_buckets(words, known)) if words else 0.0
                rows.append((doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.failed, not b.failed and rule.passes(score), score))
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()]
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return small_batches(documents).select("doc_id", "text").mapInArrow(run, schema)


def kept(documents: DataFrame, rule: Ratio) -> DataFrame:
    """The rows that the base rules and the ratio keep, all columns unchanged."""

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in steps(batches):
            mask = []
            for text in texts(column(batch, "text")):
                words = _words(text)
                mask.append(len(words) >= 50 and not base_counts(text, words).failed and rule.passes(rule.score(ngram_buckets(words, known))))
            yield batch.filter(pa.array(mask, pa.bool_()))

    return small_batches(documents).mapInArrow(run, documents.schema)
