"""SimHash near-duplicates, linked through vantage-point trees.

Two fingerprints that differ in ``r`` bits or fewer differ in ``r // 2`` bits
or fewer in one of their halves.  So there is one vantage-point tree per half,
over the Hamming distance of that half alone: the smaller radius makes the
triangle bounds prune far more than they would over all 64 bits.

Beyond ``MANY`` fingerprints 32 bits are crowded, and every level of a tree
sends more queries to both of its sides.  There the trees are over pairs of
``radius + 2`` blocks: two of the blocks hold no differing bit, so the bounds
have radius 0 in one of the trees, and a fingerprint goes to one shard a tree
at any size of the table.

The top of each tree is grown on a bounded sample.  Its leaves are shards: a
fingerprint lives in one shard and is sent as a query to every shard that the
bounds cannot exclude.  Within a shard the tree is grown further, and what is
left is compared exactly.  The sample affects balance only, never the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_filter, may_hold
from .common import LOWER_ASCII, column, discard, free_name, join_unique, only, steps, texts, written
from .components import connected_components

HALVES = (np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF))

#: Fingerprints that the tree tops are grown on, at most (half a MB).
TREE_SAMPLE = 65_536
#: Fingerprints that should live in one shard, and queries that one task takes.
SHARD_HOMES, SHARD_QUERIES = 4_096, 65_536
#: Fingerprints beyond which trees are over pairs of blocks, and those of one task in such a tree (8 MB).
MANY, SHARD_EXACT = 1 << 24, 1 << 20
#: Within a shard, below this many fingerprints all are compared.
SMALL = 192


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of the ``width``-word shingles of ``text``, unsigned."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.array([digest(line[a:b]) for a, b in spans], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, width: int = 3, more: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed long) and the strings
    named in ``more`` of every row."""

    def run(batches):
        for batch in steps(batches):
            fps = np.array([fingerprint(t, width) for t in texts(column(batch, "text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fps, pa.int64()), *[column(batch, m) for m in more]], ["doc_id", "fp", *more])

    return only(documents, doc_id="doc_id", text="text", **{m: m for m in more}).mapInArrow(run, ", ".join(["doc_id long, fp long", *[f"{m} string" for m in more]]))


def block_pairs(radius: int) -> list[np.uint64]:
    """Masks of all pairs of ``radius + 2`` blocks of 64 bits.  ``radius``
    differing bits leave two blocks alone, so one mask has none of them."""
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [np.uint64(a | b) for a, b in combinations(blocks, 2)]


@dataclass
class Node:
    """Inside: distances up to ``mu`` from ``vantage``; outside: beyond."""

    vantage: np.uint64 = np.uint64(0)
    mu: int = 0
    inside: Node | None = None
    outside: Node | None = None
    shard: int = -1
    #: How many tasks share the shard's own fingerprints and its queries.
    grid: tuple[int, int] = (1, 1)
    first_cell: int = 0


@dataclass
class Tree:
    root: Node
    mask: np.uint64
    radius: int
    shards: list[Node] = field(default_factory=list)


def _distance(fps: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((fps ^ vantage) & mask)


def _split(homes: np.ndarray, mask: np.uint64, depth: int) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage point among ``homes``, the median distance, and the distances;
    None where all lie on one side."""
    for k in range(3):
        vantage = homes[(depth * 7919 + k * 104_729) % len(homes)]
        d = _distance(homes, vantage, mask)
        mu = int(np.median(d))
        if mu == d.max():
            mu -= 1
        if mu >= d.min():
            return vantage, mu, d
    return None


def grow(sample: np.ndarray, total: int, mask: np.uint64, radius: int, shard_homes: int | None = None) -> Tree:
    """The top of a tree: nodes are split while the share of the sample that
    lives there stands for more than ``SHARD_HOMES`` fingerprints, or those
    given.  A shard that the bounds cannot split further is dealt to a grid of
    tasks."""
    tree = Tree(Node(), mask, radius)
    scale = total / max(1, len(sample))

    def visit(node: Node, homes: np.ndarray, queries: np.ndarray, depth: int) -> None:
        found = _split(homes, mask, depth) if len(homes) >= 16 and len(homes) * scale > (shard_homes or SHARD_HOMES) else None
        if found:
            vantage, mu, d = found
            dq = _distance(queries, vantage, mask)
            into, out = queries[dq <= mu + radius], queries[dq + radius > mu]
            if min(len(into), len(out)) < 0.9 * len(queries):
                node.vantage, node.mu, node.inside, node.outside = vantage, mu, Node(), Node()
                visit(node.inside, homes[d <= mu], into, depth + 1)
                visit(node.outside, homes[d > mu], out, depth + 1)
                return
        node.shard = len(tree.shards)
        most = (4 * shard_homes, 4 * shard_homes) if shard_homes else (4 * SHARD_HOMES, SHARD_QUERIES) if radius else (SHARD_EXACT, SHARD_EXACT)
        node.grid = (max(1, round(len(homes) * scale / most[0])), max(1, round(len(queries) * scale / most[1])))
        tree.shards.append(node)

    visit(tree.root, sample, sample, 0)
    return tree


def place(tree: Tree, fps: np.ndarray) -> list[tuple[Node, np.ndarray, np.ndarray]]:
    """(shard, positions that live there, positions that query it)."""
    out = []

    def visit(node: Node, homes: np.ndarray, queries: np.ndarray) -> None:
        if node.inside is None:
            out.append((node, homes, queries))
            return
        dh, dq = _distance(fps[homes], node.vantage, tree.mask), _distance(fps[queries], node.vantage, tree.mask)
        visit(node.inside, homes[dh <= node.mu], queries[dq <= node.mu + tree.radius])
        visit(node.outside, homes[dh > node.mu], queries[dq + tree.radius > node.mu])

    every = np.arange(len(fps))
    visit(tree.root, every, every)
    return out


def sent(tree: Tree, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(cells, positions sent there, whether they live there) of each shard."""
    spread = (fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    for shard, homes, queries in place(tree, fps):
        rows, columns = shard.grid
        sides = ((True, homes, rows, columns), (False, queries, columns, rows))
        # where nothing but its own fingerprints can query a shard, they are sent once
        alone = shard.grid == (1, 1) and (tree.radius == 0 or shard is tree.root)
        for home, who, own, others in sides[: 1 if alone else 2]:
            mine = (spread[who] % np.uint64(own)).astype(np.int64)
            for other in range(others):
                yield shard.first_cell + (mine * columns + other if home else other * columns + mine), who, home


def _roots(labels: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := labels[labels], labels):
        labels = up
    return labels


def _join(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the links i-j; a label is the position of a root."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        labels = _roots(labels)


def link_shard(homes: np.ndarray, queries: np.ndarray, mask: np.uint64, half_radius: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between ``homes`` and ``queries`` within ``radius`` bits, as the
    edges of a forest with the same components: (fingerprint, root)."""
    every = np.unique(np.concatenate([homes, queries]))
    labels = np.arange(len(every))
    at_home, at_query = np.searchsorted(every, homes), np.searchsorted(every, queries)
    stack = [(np.arange(len(homes)), np.arange(len(queries)), 0)]
    while stack:
        h, q, depth = stack.pop()
        if not len(h) or not len(q):
            continue
        found = _split(homes[h], mask, depth) if len(h) > SMALL else None
        if found:
            vantage, mu, d = found
            dq = _distance(queries[q], vantage, mask)
            into, out = q[dq <= mu + half_radius], q[dq + half_radius > mu]
            if min(len(into), len(out)) < 0.95 * len(q):
                stack += [(h[d <= mu], into, depth + 1), (h[d > mu], out, depth + 1)]
                continue
        rows = max(1, (1 << 21) // len(q))
        for k in range(0, len(h), rows):
            part = h[k : k + rows]
            i, j = np.nonzero(np.bitwise_count(homes[part][:, None] ^ queries[q][None, :]) <= radius)
            if len(i):
                labels = _join(labels, at_home[part[i]], at_query[q[j]])
    tied = np.flatnonzero(labels != np.arange(len(every)))
    return every[tied], every[labels[tied]]


def links(distinct: DataFrame, radius: int = 3, many: int = MANY) -> DataFrame:
    """Edges (a long, b long) between the distinct fingerprints ``fp`` of
    ``distinct``; their components are those of all pairs within ``radius``.
    ``many`` bears on the work only."""
    total = distinct.count()
    sample = np.array([r.fp for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).collect()], np.int64).view(np.uint64)
    near = radius // 2 if total <= many else 0
    trees = [grow(sample, total, mask, near) for mask in (HALVES if total <= many else block_pairs(radius))]
    cells, masks = 0, []
    for tree in trees:
        for shard in tree.shards:
            shard.first_cell = cells
            cells += shard.grid[0] * shard.grid[1]
        masks.append((cells, tree.mask))

    def send(batches):
        for batch in batches:
            fps = column(batch, "fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for tree in trees:
                for cell, who, home in sent(tree, fps):
                    if len(who):
                        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(fps[who].view(np.int64)), pa.array(np.full(len(who), home))], ["cell", "fp", "home"])

    def link(key, table):
        fps, home = np.asarray(table["fp"], dtype=np.int64).view(np.uint64), np.asarray(table["home"])
        mask = next(m for upto, m in masks if key[0].as_py() < upto)
        queries = fps[home] if home.all() else fps[~home]
        a, b = link_shard(fps[home], queries, mask, near, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return distinct.select("fp").mapInArrow(send, "cell long, fp long, home boolean").groupBy("cell").applyInArrow(link, "a long, b long")


def _components(fps: DataFrame, radius: int) -> DataFrame:
    """``fp``, ``copies``, ``root`` and ``component_id`` of each fingerprint of
    ``fps``."""
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    parts = connected_components(links(distinct, radius))
    rooted = written(distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", "copies", F.coalesce("root", "fp").alias("root")))
    discard(distinct, parts)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    found = written(join_unique(rooted, least.select("root", "component_id"), ["root"], least, "n", rooted.count()).select("fp", "copies", "root", "component_id"))
    discard(rooted)
    return found


def _of_rows(fps: DataFrame, component: DataFrame) -> DataFrame:
    """The rows of ``fps`` with the columns of their fingerprint's component."""
    return join_unique(fps, component.drop("copies"), ["fp"], component, "copies", fps.count())


def near_duplicates(documents: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (the
    least ``doc_id`` that links lead to) of every row.

    Equal fingerprints are grouped before any comparison.

    Defined cases: texts without words, null ones included, have fingerprint
    zero and are linked like any other; a text shorter than a shingle is one
    shingle; repeated rows each get a row; a null ``doc_id`` stays null and is
    no component id unless all of its component are null; an empty table gives
    no rows; columns other than ``doc_id`` and ``text`` are ignored.
    """
    fps = written(fingerprints(documents, width))
    return _of_rows(fps, _components(fps, radius)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def row_key():
    """A key of ``doc_id`` and ``text``, nulls told apart from empty texts."""
    return F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("="), "text"), F.lit(""))).cast("binary"))


def least_of_each(keys: DataFrame, group: str, documents: DataFrame) -> DataFrame:
    """One row of ``documents`` for every ``group`` of ``keys`` (key, doc_id,
    n: its rows): that of the least ``doc_id``, nulls last, then of the least
    key.  Of rows of one id and text, the first by all columns, written as JSON, stays.

    Only rows that may have to go are shuffled: those of keys that are not the
    least of their group, or that have several rows.  A broadcast Bloom filter
    tells which, and an exact join decides on them.
    """
    spark, key = documents.sparkSession, free_name(documents, "key")
    least = keys.groupBy(group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")).alias("least"), F.count("*").alias("n"))
    marked = written(join_unique(keys, least.select(group, F.col("least.key").alias("least")), [group], least, "n", keys.count()).select("key", "n", (F.col("key") == F.col("least")).alias("stays")))
    doubtful = marked.where("not stays or n > 1")
    held = bloom_filter(doubtful.select(F.xxhash64("key").alias("h")), "h")
    keyed = documents.withColumn(key, row_key())
    maybe = free_name(keyed, "maybe")
    probed = keyed.withColumn(maybe, may_hold(spark, held, F.xxhash64(key)))
    sure = probed.where(~F.col(maybe)).drop(maybe, key)
    asked = probed.where(F.col(maybe)).drop(maybe)
    chosen = marked.where("stays").select(F.col("key").alias(key))
    total = marked.agg(F.sum("n")).first()[0] or 0
    found = join_unique(asked, chosen, [key], marked.withColumnRenamed("key", key), "n", total)
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    first = found.groupBy(key).agg(F.min_by(row, F.to_json(row)).alias(key + "row")).select(f"{key}row.*")
    return sure.unionByName(first)
