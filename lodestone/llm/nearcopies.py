"""Near copies by the Jaccard similarity of five-word shingles.

Candidates come from SimHash fingerprints through vantage-point trees, and
every candidate is compared exactly.  Sets of similarity ``s`` and of sizes
that differ or not are vectors of cosine ``2 s / (1 + s)`` or more, so that two
bits of their fingerprints differ with probability 0.1515 at most at 0.8.
Over one word of 64 bits the radius that this asks for prunes next to nothing.
So a fingerprint has many words and each word two trees, over ``bits`` bits of
either half, whose radius is 1: a near pair meets in one tree with probability
0.16 (0.05 with 30 bits), other pairs hardly ever, and there are as many trees
as leave a pair at 0.8 apart in all with a computed probability of 0.0005.

Texts of equal shingles are one node before any comparison.  A tree groups the
nodes that its links lead to.  Most of these are chains of chance links, and a
group of near copies comes back from every tree.  So whole fingerprints are
compared first: pairs that differ in more bits than any pair at 0.8 (see
``most_apart``) are left out, and what the others lead to, in all trees, is one
family.  Only members of families are compared exactly, once: all with a few
leaders, then what is still apart with the rest of its family, in cells of
bounded size.
"""

from __future__ import annotations

from functools import partial
from math import acos, comb, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .bloom import bloom_filter, may_hold
from .common import LOWER_ASCII, column, discard, forget, join_unique, only, reading, release, steps, texts, written
from .components import connected_components
from .simhash import least_of_each, row_key

WIDTH = 5
#: Pairs are near copies from 4 / 5 on.
SHARE = (4, 5)
#: Nodes of one side of a cell, and bytes of their hashes.
CELL, CELL_BYTES = 512, 4 << 20
#: Nodes whose fingerprints one task compares; below so many of a bucket, all pairs at once.
ALIKE, FEW = 4096, 9
#: Nodes of a family that all others are compared with first.
LEADERS = 8

#: Up to so many documents, a tree is over so many bits, and so many words make a fingerprint (see ``missed``).
TREES = ((1 << 18, 22, 28), (1 << 21, 26, 48), (1 << 63, 30, 82))
#: Bits of a word that may differ in all, and in a tree.
RADIUS, TREE_RADIUS = 11, 1
#: Fingerprints of one task, and how many of a word the tree tops are grown on, at most.
SHARD, SAMPLE = 1 << 18, 1 << 13
#: Places that the shingles of a text are summed into before they are projected.
PLACES = 1024
#: Texts that are projected together.
ROWS = 256


def missed(bits: int, words: int, differ: float = acos(8 / 9) / pi, radius: int = RADIUS) -> float:
    """The probability that a pair whose bits differ with probability
    ``differ`` meets in no tree."""
    upto = lambda n, k: sum(comb(n, i) * differ**i * (1 - differ) ** (n - i) for i in range(k + 1))
    met = sum(comb(bits, i) * differ**i * (1 - differ) ** (bits - i) * upto(64 - bits, radius - i) for i in range(TREE_RADIUS + 1))
    return (1 - met) ** (2 * words)


def most_apart(words: int, differ: float = acos(8 / 9) / pi) -> int:
    """Bits of a whole fingerprint that a pair at 0.8 differs in, at most:
    eight standard deviations above the mean."""
    return int(64 * words * differ + 8 * sqrt(64 * words * differ * (1 - differ)))


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of the shingles, ascending; a text of fewer than
    five words is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(WIDTH, len(words))
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(line[a:b]) for a, b in spans], np.uint64))


class Projection:
    """SimHash of a set of hashes in ``words`` words: the signs of its
    projections on random directions.  The hashes are first summed, with signs,
    into ``PLACES`` places, which keeps distances and makes the rest a product
    of matrices of small whole numbers, exact in any order."""

    def __init__(self, words: int):
        self.directions = (2 * np.random.default_rng(42).integers(-64, 64, (PLACES, 64 * words), dtype=np.int16) + 1).astype(np.float32)

    @staticmethod
    def sums(hashes: np.ndarray) -> np.ndarray:
        signs = 1 - 2 * ((hashes >> np.uint64(11)) & np.uint64(1)).astype(np.float64)
        return np.bincount((hashes % np.uint64(PLACES)).astype(np.int64), signs, PLACES)

    def __call__(self, sums: np.ndarray) -> np.ndarray:
        """A row of signed longs for each row of ``sums``."""
        exact = np.float32 if len(sums) == 0 or np.abs(sums).sum(axis=1).max() < 1 << 17 else np.float64
        bits = sums.astype(exact) @ self.directions > 0
        return np.packbits(bits, axis=1).view(np.int64)


def _sketches(documents: DataFrame, words: int) -> DataFrame:
    """``doc_id, key, node`` (a hash of all shingles) and ``words`` (the
    fingerprint; of no shingles, none) of every row."""

    def run(batches):
        project = Projection(words)
        for batch in steps(batches):
            nodes, some, sums, found = [], [], [], [[]] * batch.num_rows

            def flush(some=some, sums=sums, found=found):
                for at, own in zip(some, project(np.array(sums)) if some else (), strict=True):
                    found[at] = own
                some.clear()
                sums.clear()

            for i, t in enumerate(texts(column(batch, "text"))):
                hashes = shingles(t)
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                if len(hashes):
                    some.append(i)
                    sums.append(project.sums(hashes))
                if len(some) == ROWS:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "key"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "key", "node", "words"])

    keyed = only(documents, doc_id="doc_id", text="text").withColumn("key", row_key())
    return keyed.mapInArrow(run, "doc_id long, key string, node long, words array<long>")


def _trees(nodes: DataFrame, total: int, bits: int, words: int, shard: int) -> list[simhash.Tree]:
    """Two trees for every word.  Their tops are grown on a sample, which bears
    on balance only, where more fingerprints than a shard takes are there."""
    sample = np.zeros((0, words), np.uint64)
    if total > shard:
        held = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("words").collect()
        sample = np.array([r.words for r in held], np.int64).view(np.uint64)
    low = (1 << bits) - 1
    return [simhash.grow(sample[:, w], total, np.uint64(low << shift), TREE_RADIUS, shard) for w in range(words) for shift in (32, 0)]


def _groups(nodes: DataFrame, bits: int, words: int) -> DataFrame:
    """``bucket, node``: the nodes that the links of a tree lead to, where there
    are two or more; a group that several trees find is one.  A link is a pair within ``TREE_RADIUS`` bits of the tree
    and ``RADIUS`` bits of the word."""
    known = nodes.where(F.size("words") > 0).select("node", "words")
    total = known.count()
    trees = _trees(known, total, bits, words, SHARD)
    cells, masks = 0, []
    for tree in trees:
        for s in tree.shards:
            s.first_cell = cells
            cells += s.grid[0] * s.grid[1]
        masks.append((cells, tree.mask))

    def packed(cell, pairs, home):
        """A row for each cell, as many small ones would cost more than they hold."""
        order = np.argsort(cell, kind="stable")
        cell, pairs = cell[order], pairs[order]
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + 1], pa.int64()), pa.array([pairs[a:b].tobytes()], pa.binary()), pa.array([home])], ["cell", "pairs", "home"])

    def send(batches):
        for batch in batches:
            own = column(batch, "node").to_numpy(zero_copy_only=False).view(np.uint64)
            flat = column(batch, "words").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)
            for k, tree in enumerate(trees):
                fps = np.ascontiguousarray(flat[:, k // 2])
                for cell, who, home in simhash.sent(tree, fps):
                    if len(who):
                        yield from packed(cell, np.stack([own[who], fps[who]], axis=1), home)

    def link(key, table):
        forget()
        cell = key[0].as_py()
        mask = next(m for upto, m in masks if cell < upto)
        held = [np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, 2) for x in table["pairs"]]
        home = np.repeat(np.asarray(table["home"]), [len(x) for x in held])
        node, fps = np.concatenate(held).T
        node, first = np.unique(node, return_index=True)
        homes = np.unique(fps[home])
        queries = homes if home.all() else np.unique(fps[~home])
        a, b = simhash.link_shard(homes, queries, mask, TREE_RADIUS, RADIUS)
        every, at = np.unique(fps[first], return_inverse=True)
        root = np.arange(len(every))
        root[np.searchsorted(every, a)] = np.searchsorted(every, b)
        group = root[at]
        some = np.bincount(group, minlength=len(every))[group] > 1
        mark = np.zeros(len(every), np.uint64)
        np.add.at(mark, group, node ^ (node >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15))
        found = pa.table({"bucket": mark[group[some]].view(np.int64), "node": node[some].view(np.int64)})
        release()
        return found

    return known.mapInArrow(send, "cell long, pairs binary, home boolean").groupBy("cell").applyInArrow(link, "bucket long, node long").distinct()


def near(size: int, common: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which sets of ``sizes``, with ``common`` members in one of ``size``, are
    near that one."""
    a, b = SHARE
    return (a + b) * common >= a * (size + sizes)


def _alike(groups: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """Edges (a, b) that lead to what all pairs of a bucket lead to whose
    fingerprints differ in ``most_apart`` bits or fewer."""
    most = most_apart(words)
    sizes = groups.groupBy("bucket").agg(F.count("*").alias("n"))
    total = groups.count()
    sided = join_unique(groups, sizes.select("bucket", F.ceil(F.col("n") / ALIKE).alias("sides")), ["bucket"], sizes, "n", total).withColumn("side", F.expr("pmod(xxhash64(node), sides)"))
    # small buckets share a cell, a large one is dealt to the pairs of its sides
    whole = sided.where("sides = 1").select(F.expr(f"pmod(xxhash64(bucket), {max(1, total // ALIKE)}L)").alias("cell"), "bucket", "node")
    dealt = sided.where("sides > 1").withColumn("other", F.explode(F.expr("sequence(0L, sides - 1)")))
    dealt = dealt.select(F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other")).alias("cell"), "bucket", "node")

    def link(table: pa.Table) -> pa.Table:
        forget()
        bucket, node = np.asarray(table["bucket"]), np.asarray(table["node"])
        order = np.lexsort((node, bucket))
        bucket, node = bucket[order], node[order]
        fps = table["words"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)[order]
        near = lambda i, j: np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int32) <= most
        cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1, append=bucket[-1] + 1))
        size = np.repeat(np.diff(cuts), np.diff(cuts))
        a, b = [], []
        for k in range(1, FEW):
            i = np.flatnonzero((bucket[:-k] == bucket[k:]) & (size[:-k] < FEW)) if k < len(node) else np.zeros(0, np.int64)
            i = i[near(i, i + k)]
            a.append(i)
            b.append(i + k)
        for start in cuts[:-1][np.diff(cuts) >= FEW]:
            left = np.arange(start, start + size[start])
            while len(left):
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    i = queue.pop()
                    met = near(left, i)
                    a.append(np.full(met.sum(), i))
                    b.append(left[met])
                    queue += left[met].tolist()
                    left = left[~met]
        found = pa.table({"a": node[np.concatenate(a)], "b": node[np.concatenate(b)]})
        release()
        return found

    cells = whole.unionByName(dealt).join(nodes.select("node", "words"), "node")
    return cells.groupBy("cell").applyInArrow(link, "a long, b long").distinct()


def _cells(nodes, size):
    """How many sides so many nodes with hashes of that ``size`` need."""
    return F.ceil(F.greatest(nodes / CELL, size / CELL_BYTES))


def _edges(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) between near nodes of each cell: every node with ``ask``
    is compared with all of the cell that are of another ``part``, unless
    edges of the cell already lead there."""

    def link(table: pa.Table) -> pa.Table:
        node, ask = np.asarray(table["node"]), np.asarray(table["ask"])
        _, part = np.unique(np.asarray(table["part"]), return_inverse=True)
        if part.max() == 0:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sizes = np.asarray(table["bytes"]) // 8
        flat = np.frombuffer(b"".join(x.as_buffer() for x in table["hashes"]), np.uint64)
        distinct = np.unique(flat)
        at = np.searchsorted(distinct, flat).astype(np.int32)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        marked, a, b = np.zeros(len(distinct), np.int64), [], []
        for i in np.flatnonzero(ask):
            if (part == part[i]).all():
                continue
            own = at[starts[i] : starts[i] + sizes[i]]
            marked[own] = 1
            common = np.add.reduceat(marked[at], starts)
            marked[own] = 0
            for j in np.flatnonzero(near(sizes[i], common, sizes) & (part != part[i])):
                if part[j] != part[i]:
                    a.append(node[i])
                    b.append(node[j])
                    part[part == part[j]] = part[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.join(sets, "node").groupBy("cell").applyInArrow(link, "a long, b long")


def _with_leaders(members: DataFrame, families: DataFrame) -> DataFrame:
    """Cells of a family's leaders and a share of the others."""
    joined = join_unique(members, families.select("family", "leaders", "shares"), ["family"], families, "size", members.count())
    others = joined.where(~F.array_contains("leaders", F.col("node"))).select("family", F.expr("pmod(xxhash64(node), shares)").alias("share"), "node", F.lit(False).alias("ask"))
    shares = families.select("family", "leaders", F.explode(F.expr("sequence(0L, shares - 1)")).alias("share"))
    asking = shares.select("family", "share", F.explode("leaders").alias("node"), F.lit(True).alias("ask"))
    return others.unionByName(asking).select(F.xxhash64("family", "share").alias("cell"), "node", "ask", F.col("node").alias("part"))


def _with_the_rest(members: DataFrame, families: DataFrame, parts: DataFrame) -> DataFrame:
    """Cells of those families that have two nodes besides their leaders and
    parts that are apart.  The nodes of the largest part never ask."""
    more = families.where("size > 1 + size(leaders)")
    rooted = join_unique(members, more.select("family"), ["family"], more, "size", members.count()).join(parts, "node", "left")
    rooted = written(rooted.select("family", "node", "bytes", F.coalesce("root", "node").alias("part")))
    by_part = written(rooted.groupBy("family", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")))
    main = by_part.groupBy("family").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("main_n"), F.max_by("bytes", F.struct("n", "part")).alias("main_bytes"), F.sum("n").alias("n"), F.sum("bytes").alias("all_bytes")).where("n > main_n")
    sides = main.select("family", "main", "n", _cells(F.col("n") - F.col("main_n"), F.col("all_bytes") - F.col("main_bytes")).alias("asking"), _cells(F.col("main_n"), F.col("main_bytes")).alias("asked"))
    sides = written(sides)
    dealt = join_unique(rooted, sides.drop("n"), ["family"], sides, "n", rooted.count())
    dealt = dealt.withColumn("side", F.expr("if(part = main, asking + pmod(xxhash64(node), asked), pmod(xxhash64(node), asking))"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, asking + if(part = main, 0L, asked) - 1)")))
    cells = dealt.select(F.xxhash64("family", F.least("side", "other"), F.greatest("side", "other")).alias("cell"), "node", (F.col("side") <= F.col("other")).alias("ask"), "part")
    cells, before = written(cells), (rooted, by_part, sides)
    discard(*before)
    return cells


def one_of_each_group(documents: DataFrame) -> DataFrame:
    """One row of every group of near copies, that with the least ``doc_id``,
    nulls last; groups are what pairs of similarity 0.8 or more lead to.  All
    columns stay.

    Bloom filters of bounded size keep what cannot matter out of the shuffles:
    texts without a candidate, rows that stay in any case.  What they let through is joined exactly.

    Defined cases: texts without words, null ones included, are one group;
    repeated rows are one group, of which the first by all columns stays; rows
    without an id come after those with one; a text of any length is shingled
    whole; columns of any name stay as they are; an empty table gives no rows.
    """
    spark = documents.sparkSession
    _, bits, words = next(x for x in TREES if documents.count() <= x[0])
    rows = written(_sketches(documents, words))
    keys = written(rows.groupBy("key").agg(F.first("node").alias("node"), F.first("doc_id").alias("doc_id"), F.count("*").alias("n")))
    nodes = written(rows.groupBy("node").agg(F.first("words").alias("words"), F.min("key").alias("key"), F.count("*").alias("copies")))
    discard(rows)
    groups = written(_groups(nodes, bits, words))
    alike = written(_alike(groups, nodes, words))
    discard(groups)
    found = connected_components(alike)
    discard(alike)

    def hashed(batches):
        for batch in steps(batches):
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array([shingles(t).tobytes() for t in texts(column(batch, "text"))], pa.binary())], ["node", "hashes"])

    wanted = written(nodes.select("node", "key").join(found.select("node"), "node", "left_semi"))
    keyed = only(documents, doc_id="doc_id", text="text").withColumn("key", row_key()).select("key", "text")
    some = keyed.where(may_hold(spark, bloom_filter(wanted.select(F.xxhash64("key").alias("h")), "h"), F.xxhash64("key")))
    chosen = join_unique(some, wanted, ["key"], keys, "n", keys.agg(F.sum("n")).first()[0] or 0).select("node", "text")
    sets = written(chosen.mapInArrow(hashed, "node long, hashes binary").dropDuplicates(["node"]).withColumn("bytes", F.octet_length("hashes")))
    discard(wanted)
    members = written(found.withColumnRenamed("root", "family").join(sets.select("node", "bytes"), "node"))
    discard(found)
    leaders = F.array_distinct(F.array(*[F.min_by("node", F.struct(F.xxhash64("node", F.lit(k)), "node")) for k in range(LEADERS)]))
    families = written(members.groupBy("family").agg(leaders.alias("leaders"), F.count("*").alias("size"), _cells(F.count("*"), F.sum("bytes")).alias("shares")))
    edges = written(_edges(_with_leaders(members, families), sets))
    parts = connected_components(edges)
    apart = _with_the_rest(members, families, parts)
    rest = written(_edges(apart, sets))
    discard(parts, members, families, sets, apart)
    parts = connected_components(edges.unionByName(rest))
    discard(edges, rest)
    rooted = written(nodes.join(parts, "node", "left").select("node", "copies", F.coalesce("root", "node").alias("root")))
    discard(nodes, parts)
    placed = written(join_unique(keys, rooted.drop("copies"), ["node"], rooted, "copies", keys.count()).select("key", "doc_id", "n", "root"))
    discard(keys, rooted)
    chosen = least_of_each(placed, "root", documents)
    discard(placed)
    return chosen
