"""Toxicity: a linear classifier over character n-grams whose features are
scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram.  Its scale is the log of the
ratio between its share among toxic and among other labelled documents; a
logistic regression is fitted over the scaled features.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, crc_of_id, discard, small_batches, steps, texts, written

SIZES = (4, 5, 6)
FEATURE_BITS = 20
FEATURES = 1 << FEATURE_BITS
#: Labelled rows, at most, on which the weights are fitted: those of the least
#: hash of the id, a row per id, as far as their features are not more than
#: FIT_FEATURES together.  The ratios are of all labelled rows.
FIT_ROWS, FIT_FEATURES = 4_000, 1 << 23
SMOOTH = 1.0
PASSES = 6
#: Characters whose features are taken at a time.
CHUNK = 1 << 20
#: Labelled ids that are broadcast at most.
BROADCAST_IDS = 1_000_000


def _hashed(c: np.ndarray) -> np.ndarray:
    """The features of code points, with repeats."""
    found = []
    for n in SIZES:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint32)
        for k in range(n):
            h ^= c[k : len(c) - n + 1 + k]
            h *= np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x9E3779B1)
        found.append(h >> np.uint32(32 - FEATURE_BITS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def present(text: str) -> np.ndarray:
    """The features of a text, each once: n-grams of its lower-cased
    characters, with one space for each run of white space and at both ends."""
    c = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) > CHUNK:
        seen = np.zeros(FEATURES, bool)
        for i in range(0, len(c), CHUNK):
            seen[_hashed(c[i : i + CHUNK + max(SIZES) - 1])] = True
        return np.flatnonzero(seen).astype(np.int32)
    found = _hashed(c)
    order = np.arange(len(found), dtype=np.int32)
    last = _scratch()
    last[found] = order  # of equal features one stays
    return found[last[found] == order].astype(np.int32)


@functools.cache
def _scratch() -> np.ndarray:
    return np.zeros(FEATURES, np.int32)


@dataclass
class Classifier:
    weights: np.ndarray  # with the ratios multiplied in
    bias: float

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[present(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def _labelled(documents: DataFrame, labels: DataFrame, held: tuple[int, int]) -> DataFrame:
    """``doc_id``, ``text`` and ``toxic`` of the labelled rows outside the
    held-out fold.  Rows of an id with both labels count as toxic."""
    own = labels.where("doc_id is not null and toxic is not null").where(crc_of_id("doc_id") % held[0] != held[1]).groupBy(F.col("doc_id").alias("label_id__")).agg(F.max("toxic").cast("int").alias("toxic"))
    few = own.count() <= BROADCAST_IDS
    docs = small_batches(documents).select("doc_id", "text")
    return docs.join(F.broadcast(own) if few else own, docs["doc_id"] == own["label_id__"]).drop("label_id__")


def fit(documents: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, rows: int = FIT_ROWS, most_features: int = FIT_FEATURES) -> Classifier:
    """Learns from the labelled documents whose crc32(id) mod ``folds`` is not
    ``held_fold``.  The ratios count all of them, in vectors of fixed size per
    task; the weights are fitted on at most ``rows`` of them and
    ``most_features`` features, in order of their ids' hash.

    Defined cases: labels without id or verdict are left out; an id with both
    labels is toxic; null texts are empty; repeated rows count each in the
    ratios and once in the fit; with labels of one kind, or none, or with empty
    tables, the score is the smoothed base rate; other columns are ignored."""
    known = _labelled(documents, labels, (folds, held_fold))

    def count(batches):
        sums, total = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
        for batch in steps(batches):
            for text, toxic in zip(texts(column(batch, "text")), column(batch, "toxic").to_pylist(), strict=True):
                sums[int(toxic > 0), present(text)] += 1
                total[int(toxic > 0)] += 1
        some = np.flatnonzero(sums.any(axis=0))
        feature = np.concatenate([some, [-1]])
        yield pa.RecordBatch.from_arrays([pa.array(feature), *[pa.array(np.concatenate([sums[k, some], total[k : k + 1]])) for k in (0, 1)]], ["feature", "clean", "toxic"])

    sums = written(known.mapInArrow(count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    total = sums.where("feature = -1").first()
    clean, toxic = (total.clean, total.toxic) if total else (0, 0)
    rate = (toxic + 1) / (clean + toxic + 2)
    if not clean or not toxic:
        return Classifier(np.zeros(FEATURES), float(np.log(rate / (1 - rate))))
    ratio = F.log((F.col("toxic") + SMOOTH) / (toxic + 2 * SMOOTH)) - F.log((F.col("clean") + SMOOTH) / (clean + 2 * SMOOTH))
    chosen = sums.where("feature >= 0").select("feature", ratio.alias("ratio")).toArrow()
    ratios = np.zeros(FEATURES)
    ratios[np.asarray(chosen["feature"])] = np.asarray(chosen["ratio"])
    discard(sums)

    def features(batches):
        for batch in steps(batches):
            found = [present(t).tobytes() for t in texts(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "features"])

    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = known.select("doc_id").distinct().orderBy(*order).limit(rows)
    one = known.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    picked = written(one.mapInArrow(features, "doc_id long, toxic int, features binary"))
    sizes = picked.select("doc_id", (F.octet_length("features") / 4).cast("long").alias("n")).orderBy(*order).collect()
    upto = np.searchsorted(np.cumsum([r.n for r in sizes]), most_features, side="right")
    if not upto:
        return Classifier(np.zeros(FEATURES), float(np.log(rate / (1 - rate))))
    last = picked.where(F.col("doc_id") == sizes[upto - 1].doc_id).select(*[x.alias(n) for x, n in zip(order, ("hash", "id"), strict=True)]).first()
    taken = picked.where(F.struct(*order) <= F.struct(F.lit(last.hash).cast("long"), F.lit(last.id).cast("long")))

    def train(batches):
        held = list(batches)
        found = [np.frombuffer(x.as_buffer(), np.int32) for b in held for x in column(b, "features")]
        c = _logistic(found, np.array([t for b in held for t in column(b, "toxic").to_pylist()]) > 0, ratios)
        used = np.flatnonzero(c.weights)
        yield pa.RecordBatch.from_arrays([pa.array([used.astype(np.int32).tobytes()]), pa.array([c.weights[used].tobytes()]), pa.array([c.bias])], ["used", "weights", "bias"])

    # the bounded sample is fitted in a task, so that the driver gets the weights alone
    fitted = taken.coalesce(1).sortWithinPartitions(*order).select("toxic", "features").mapInArrow(train, "used binary, weights binary, bias double").first()
    discard(picked)
    weights = np.zeros(FEATURES)
    weights[np.frombuffer(fitted.used, np.int32)] = np.frombuffer(fitted.weights)
    return Classifier(weights, fitted.bias)


def _logistic(rows: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray) -> Classifier:
    """Logistic regression by gradient steps over the rows, in order, each by
    the row's own length; the mean of the weights after each pass but the
    first, which damps the last rows' pull."""
    rate = (toxic.sum() + 1) / (len(rows) + 2)
    w, bias = np.zeros(FEATURES), float(np.log(rate / (1 - rate)))
    mean, mean_bias = np.zeros(FEATURES), 0.0
    for p in range(PASSES):
        for row, y in zip(rows, toxic.tolist(), strict=True):
            x = ratio[row]
            z = float(w[row] @ x) + bias
            step = 2.0 / (1 + p) * (y - 1 / (1 + np.exp(-np.clip(z, -35, 35)))) / (1 + float(x @ x))
            w[row] += step * x
            bias += step
        if p:
            mean, mean_bias = mean + w, mean_bias + bias
    return Classifier(mean / (PASSES - 1) * ratio, mean_bias / (PASSES - 1))


def score(documents: DataFrame, classifier: Classifier, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every document.

    Defined cases: null and empty texts have the features of a lone space;
    repeated rows give repeated results; an empty table gives no rows; a null
    ``doc_id`` stays null; only ``text`` bears on the score.
    """

    def run(batches):
        for batch in steps(batches):
            s = np.array([classifier.score(t) for t in texts(column(batch, "text"))])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return small_batches(documents).select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def clean(documents: DataFrame, classifier: Classifier, threshold: float = 0.3) -> DataFrame:
    """The rows that score below ``threshold``, all columns unchanged.

    Defined cases: as for ``score``; repeated rows stay or go together.
    """

    def run(batches):
        for batch in steps(batches):
            yield batch.filter(pa.array([classifier.score(t) < threshold for t in texts(column(batch, "text"))], pa.bool_()))

    return small_batches(documents).mapInArrow(run, documents.schema)
