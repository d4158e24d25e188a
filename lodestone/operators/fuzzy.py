"""Names that resemble each other: queries against names on a grid of cells.

The ratio of two names is twice the number of matched characters over the sum
of their lengths, where matches are the longest common blocks, left and right
of each taken in the same way.  Matched characters are common to both names, so
a ratio of ``t`` needs ``t / 2`` of both lengths in common characters, and in a
common subsequence: names with less are never compared.

The pairs of a cell are compared together: first the longest block of each
pair, then that of every rest beside a block, and so on while anything is left
that can reach the threshold.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: thresholds ---
THRESHOLD, SUBSTRING = 0.6, 0.8
# --- end of fixed values ---

#: Names and queries, about, that one cell of the grid compares, and partitions that cells are dealt to at most.
SIDE, MOST_PARTITIONS = 512, 4096

#: Characters from which on a name has its frequent ones ignored (as ``difflib`` does), and bytes of a table of runs.
LONG, STEP_BYTES = 200, 2 << 20


def _coded(texts: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of character numbers, from 1 on, for each text and an empty one at the end; and lengths."""
    lengths = np.array([len(t) for t in texts], np.int32)
    width = max(1, int(lengths.max(initial=0)))
    points = np.array([*texts, ""], dtype=f"U{width}").view(np.uint32).reshape(-1, width)
    codes = (np.searchsorted(alphabet, points) + 1).astype(np.min_scalar_type(len(alphabet) + 1))
    codes[np.arange(width) >= np.append(lengths, 0)[:, None]] = 0
    return codes, lengths


def _subsequence(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Characters of the longest common subsequence with each name of at most
    64; ``places`` has a bit for each place of a character in a name."""
    apart = np.full(places.shape[1], ~np.uint64(0))
    for own in places[text.astype(np.int64) - 1]:
        met = apart & own
        apart = (apart + met) | (apart - met)
    return np.bitwise_count(~apart).astype(np.int64)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of the longest block of each pair of columns, and its ends in both:
    the first in ``a``, then the first in ``b``.  ``a`` may have one column."""
    (m, width), every = (len(a), len(b)), np.arange(b.shape[1])
    runs = np.zeros((m, width + 1, len(every)), np.uint8)  # of equal characters that end at a place of a and one of b
    same = np.empty(b.shape, np.bool_)
    for i in range(m):
        np.equal(b, a[i], out=same)
        np.add(runs[i - 1, :-1], 1, out=runs[i, 1:]) if i else runs[0, 1:].fill(1)
        np.multiply(runs[i, 1:], same.view(np.uint8), out=runs[i, 1:])
    best = runs.max(axis=1)
    end = best.argmax(axis=0)
    size = best[end, every]
    return size.astype(np.int32), end.astype(np.int32) + 1, (runs[end, :, every] == size[:, None]).argmax(axis=1).astype(np.int32)


def _part(codes: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, beyond: int) -> np.ndarray:
    """Columns of the characters from ``start`` on, ``beyond`` after ``size``."""
    windows = np.lib.stride_tricks.sliding_window_view(codes.reshape(-1), width)
    out = np.ascontiguousarray(windows[row.astype(np.int64) * codes.shape[1] + start].T)
    out[np.arange(width)[:, None] >= size] = beyond
    return out


def _longest_within(asked, named, q, s, lo, hi, first, last, beyond: int) -> np.ndarray:
    """The same for parts of the texts, those of about one size together."""
    out = np.zeros((3, len(q)), np.int32)
    here, there = hi - lo, last - first
    kind = (np.minimum((here + 3) // 4, 1023) * 64 + (there + 3) // 4).astype(np.uint16)
    order = np.argsort(kind, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
        m, width = int(here[at].max()), int(there[at].max())
        step = max(1, STEP_BYTES // (m * (width + 1)))
        for x in (at[c : c + step] for c in range(0, len(at), step)):
            out[:, x] = _longest(_part(asked, q[x], lo[x], here[x], m, beyond), _part(named, s[x], first[x], there[x], width, 0))
    return out


def _matched_pairs(queries: list[str], names: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``rated_pairs`` of names shorter than ``LONG``, in the order of their lengths."""
    alphabet = np.array(sorted({ord(c) for t in (*queries, *names) for c in t}), np.uint32)
    (asked, long), (named, wide), beyond = _coded(queries, alphabet), _coded(names, alphabet), len(alphabet) + 1
    turned = np.ascontiguousarray(named[:-1].T)
    over = np.flatnonzero(wide > 64)
    held = np.stack([(turned[:, over] == c).sum(axis=0) for c in range(1, beyond)])
    bits = np.uint64(1) << np.arange(min(64, len(turned)), dtype=np.uint64)[:, None]
    places = np.stack([np.where(turned[:64] == c, bits, np.uint64(0)).sum(axis=0, dtype=np.uint64) for c in range(1, beyond)])
    least = min(threshold, 1) / (2 - min(threshold, 1))  # of a query's length, for a name that reaches the threshold or holds it
    found = []
    for i, text in enumerate(asked[:-1]):
        text = text[: long[i]]
        short = int(np.searchsorted(wide, long[i] * least - 1e-6))
        common = np.append(np.zeros(short, np.int64), _subsequence(text, places[:, short:]))  # names too short to reach it come first
        if len(over):
            chars, n = np.unique(text, return_counts=True)
            common[over] = np.minimum(held[chars.astype(np.int64) - 1], n[:, None]).sum(axis=0)
        able = np.flatnonzero((2 * common + 1e-9 >= threshold * (long[i] + wide)) | (common == long[i]))
        step = max(1, STEP_BYTES // (len(text) * (len(turned) + 1)))
        for at in (able[c : c + step] for c in range(0, len(able), step)):
            found.append((np.full(len(at), i, np.int32), at.astype(np.int32), *_longest(text[:, None], turned[:, at])))
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0)
    q, s, size, end, stop = (np.concatenate(x) for x in zip(*found, strict=True))
    total, lengths, part = size.astype(np.int64), long[q] + wide[s], size == long[q]
    pair, lo, hi, first, last = np.arange(len(q), dtype=np.int32), np.zeros_like(q), long[q], np.zeros_like(q), wide[s]
    while len(pair):
        end, stop = lo + end, first + stop
        rests = (pair, pair), (lo, end), (end - size, hi), (first, stop), (stop - size, last), (size, size)
        pair, lo, hi, first, last, beside = (np.concatenate(x) for x in rests)
        left = (beside > 0) & (lo < hi) & (first < last)
        most = total + np.bincount(pair[left], np.minimum(hi - lo, last - first)[left], len(total))
        left &= (2 * most + 1e-9 >= threshold * lengths)[pair]
        pair, lo, hi, first, last = (x[left] for x in (pair, lo, hi, first, last))
        if len(pair):
            size, end, stop = _longest_within(asked, named, q[pair], s[pair], lo, hi, first, last, beyond)
            total += np.bincount(pair, size, len(total)).astype(np.int64)
    ratio = 2.0 * total / lengths
    ratio = np.where(part, np.maximum(ratio, SUBSTRING), ratio)
    kept = ratio >= threshold
    return q[kept], s[kept], ratio[kept]


def rated_pairs(queries: list[str], names: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the queries and names whose ratio, 0.8 at least for a part, is
    ``threshold`` or more, and the ratios.  No text is empty."""
    places = np.array(sorted((j for j, name in enumerate(names) if len(name) < LONG), key=lambda j: len(names[j])), np.int64)
    i, j, ratio = _matched_pairs(queries, [names[x] for x in places], threshold) if len(places) else (np.empty(0, np.int64),) * 3
    out = [(i, places[j.astype(np.int64)], ratio)]
    for place, name in enumerate(names):
        if len(name) >= LONG:  # looked into once
            matcher = SequenceMatcher(None, "", name)
            for x, text in enumerate(queries):
                matcher.set_seq1(text)
                part = text in name
                if part or matcher.real_quick_ratio() >= threshold and matcher.quick_ratio() >= threshold:
                    value = max(matcher.ratio(), SUBSTRING * part)
                    if value >= threshold:
                        out.append((np.array([x]), np.array([place]), np.array([value])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _rated(queries: DataFrame, names: DataFrame, threshold: float, give: tuple[str, str] = ("q", "s")) -> DataFrame:
    """``ratio`` of the texts ``q`` and ``s``, or of ``q`` and ``t`` where names
    have a second text and it is larger, with a column of either side.  Both
    sides are dealt to a grid by hash, so that a cell has a bounded number of
    pairs and no text that many names have in common makes a task large; what
    comes out of a cell needs no further join."""
    parts, slices = (-(-df.count() // SIDE) or 1 for df in (names, queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    homes = names.select("*", own(names, parts).alias("part"), every(slices).alias("slice")).withColumn("asks", F.lit(False))
    asking = queries.select("*", own(queries, slices).alias("slice"), every(parts).alias("part")).withColumn("asks", F.lit(True))
    cells = homes.unionByName(asking, allowMissingColumns=True).withColumn("cell", F.col("part").cast("long") * slices + F.col("slice")).drop("part", "slice")
    texts = [c for c in ("s", "t") if c in names.columns]

    def rate(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks, home = table.filter(table["asks"]), table.filter(pc.invert(table["asks"]))
        asked, named = ({x: i for i, x in enumerate(dict.fromkeys(x for c in columns for x in side[c].to_pylist() if x))} for side, columns in ((asks, ["q"]), (home, texts)))
        best = np.full((len(asked), len(named) + 1), -1.0)  # the last for no text
        if asked and named:
            i, j, ratio = rated_pairs(list(asked), list(named), threshold)
            best[i, j] = ratio
        best = np.maximum.reduce([best[:, [named.get(x, -1) for x in home[c].to_pylist()]] for c in texts])
        best = best[[asked[x] for x in asks["q"].to_pylist()]]
        i, j = np.nonzero(best >= 0)
        return pa.table({give[0]: asks[give[0]].take(pa.array(i)), give[1]: home[give[1]].take(pa.array(j)), "ratio": best[i, j]})

    # a stated number of partitions, as few bytes make much work here
    dealt = cells.repartition(min(parts * slices, MOST_PARTITIONS), "cell")
    return dealt.groupBy("cell").applyInArrow(rate, f"{give[0]} string, {give[1]} string, ratio double")


def similar(queries: DataFrame, projects: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``query, project_id, ratio`` of all projects whose name or id resembles
    a query, whatever the case: the larger ratio of both, 0.8 at least where
    the query is part of one of them.

    ``queries``: query; ``projects``: project_id, name (both text).  Each query
    and project once; nulls match nothing; an empty query is part of every
    name, so it is left out.  Only projects of several names have their results
    put together by a shuffle.
    """
    asked = queries.select("query", F.lower("query").alias("q")).where("q <> ''").distinct()
    keyed = projects.select("project_id", F.lower("name").alias("s")).distinct()
    known = keyed.groupBy("project_id").agg(F.min("s").alias("s"), F.count_distinct("s").alias("n"))
    again = known.where("n > 1").select(F.col("project_id").alias("p"))
    several = keyed.join(again, F.col("project_id").eqNullSafe(F.col("p")), "left_semi")

    rated = lambda names: _rated(asked, names.select("project_id", "s", F.lower("project_id").alias("t")), threshold, ("query", "project_id"))
    return rated(known.where("n <= 1")).unionByName(rated(several).groupBy("query", "project_id").agg(F.max("ratio").alias("ratio")))
