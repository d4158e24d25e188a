"""Decontamination, centroid clustering and collocations against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from lodestone.llm import bloom, centroids, collocation, common, decontam
from lodestone.llm import queries as llm_queries

from .data import ODD_TEXTS, SCHEMA

# --- decontamination ---

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_contamination(text, items):
    words, hit, found = plain_words(text), set(), set()
    for item, other in items:
        theirs = plain_words(other)
        k = min(10, len(theirs))
        windows = {tuple(theirs[i : i + k]) for i in range(len(theirs) - k + 1)} if k else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add("" if item is None else str(item))
    return len(words), hit, sorted(found)


def contaminated(seed=7, n=150):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdé12") for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    make = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    items = [(i, " ".join(make(rnd.choice((12, 30, 80)))).upper()) for i in range(20)]
    items += [(100, "one Short, item"), (101, None), (102, "!!"), (3, items[4][1]), (None, items[5][1]), (103, items[6][1] + "?"), (10, " ".join(make(40)))]
    docs = []
    for i in range(n):
        words = make(rnd.choice((5, 40, 200)))
        if i % 3 == 0:
            theirs = (items[i % 27][1] or "").split()
            a, k = rnd.randint(0, 5), rnd.randint(8, 30)
            words[len(words) // 2 : len(words) // 2] = theirs[a : a + k]
        if i % 7 == 0:
            words += ["ONE", "short;", "item"]
        docs.append((i, rnd.choice((" ", ", ", "\n")).join(words), "en", "s", 1))
    docs += [(1000 + i, t, None, None, None) for i, t in enumerate(ODD_TEXTS)]
    docs += [docs[0], docs[0], (None, items[2][1], None, None, None), (2000, " ".join(make(60_000)) + " " + items[0][1], "en", "s", 1)]
    return docs, items


@pytest.fixture(scope="module")
def leak(spark):
    docs, items = contaminated()
    return docs, items, spark.createDataFrame(docs, SCHEMA).withColumnsRenamed({"source": "row", "n_chars": "items"}), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("share_bytes", [decontam.SHARE_BYTES, 4_000])
def test_contamination(leak, share_bytes):
    docs, items, rows, benchmark = leak
    got = Counter()
    for r in decontam.contamination(rows, benchmark, share_bytes).collect():
        hit = [k for s in r.spans for k in range(s["first"], s["last"] + 1)]
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r.spans, r.spans[1:], strict=False))
        got[r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(hit)] += 1
    want = Counter()
    for d, t, *_ in docs:
        n, hit, found = plain_contamination(t, items)
        want[d, n, len(hit), tuple(found), tuple(sorted(hit))] += 1
    assert got == want
    assert sum(k[2] > 0 for k in want) > 40


def test_hit_words_or_documents_go(leak):
    docs, items, rows, benchmark = leak
    kept = decontam.decontaminated(rows, benchmark, "documents")
    assert kept.columns == rows.columns
    clean = Counter((d, t) for d, t, *_ in docs if not plain_contamination(t, items)[1])
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == clean
    cut = decontam.decontaminated(rows, benchmark)
    assert cut.columns == rows.columns and cut.count() == len(docs)
    by_id = {r.doc_id: r.text for r in cut.collect()}
    for d, t, *_ in docs:
        hit = plain_contamination(t, items)[1]
        assert plain_words(by_id[d]) == [w for i, w in enumerate(plain_words(t)) if i not in hit]
        if not hit:
            assert by_id[d] == t
    with pytest.raises(ValueError):
        decontam.decontaminated(rows, benchmark, "nothing")


def test_contamination_without_rows_or_items(spark, leak):
    _, _, rows, benchmark = leak
    assert decontam.contamination(rows.limit(0), benchmark).count() == 0
    assert decontam.decontaminated(rows.limit(0), benchmark).count() == 0
    assert {r.n_hit for r in decontam.contamination(rows, benchmark.limit(0)).collect()} == {0}


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontam, "_hashed", lambda numbers, at, length: np.full(len(at), 7, np.uint64))
    share = decontam.Share.of([("a", b"x y"), ("b", b"y z")])
    numbers = np.array([share.numbers.get(w, 0) for w in b"x y z y x".split()])
    at, which = share.windows[0].hits(numbers, np.arange(5, 0, -1))
    assert sorted(zip(at.tolist(), [share.item_ids[share.windows[0].items[share.windows[0].first[k]]] for k in which.tolist()], strict=True)) == [(0, "a"), (1, "b")]


def test_long_items_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE_WORDS", 16)
    rnd = random.Random(1)
    words = [str(rnd.randint(0, 10**6)) for _ in range(200)]
    benchmark = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = spark.createDataFrame([(i, " ".join(["x", *words[i : i + 10], "y"])) for i in range(191)], "doc_id long, text string")
    assert {(r.n_hit, r.n_words) for r in decontam.contamination(rows, benchmark, 3_000).collect()} == {(10, 12)}


# --- centroid clustering ---


def plain_clusters(rows, k=8, rounds=10, scale=1024, dimension=64):
    """Lloyd's rounds over all vectors, in Python's integers."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centroids_ = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids_))
    for _ in range(rounds):
        owned = defaultdict(list)
        for _, v in kept:
            owned[nearest(v)[1]].append(v)
        centroids_ = [[sum(x) // len(owned[j]) for x in zip(*owned[j], strict=True)] if owned[j] else c for j, c in enumerate(centroids_)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids_]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in last)


def some_vectors(n, dimension=64, seed=3):
    rnd = np.random.default_rng(seed)
    middles = rnd.normal(size=(12, dimension))
    rows = [(i, (middles[i % 12] + 0.3 * rnd.normal(size=dimension)).astype(np.float32).tolist()) for i in range(n)]
    bad = [float("nan"), float("inf"), None]
    rows += [(n + i, [x, *[0.0] * (dimension - 1)]) for i, x in enumerate(bad)]
    rows += [(n + 9, None), (n + 10, []), (n + 11, [0.5] * (dimension - 1)), (None, [0.25] * dimension), rows[0], rows[0], (n + 12, rows[1][1])]
    return rows


SOURCE = "vec_id long, embedding array<float>, cluster string, v int"


def test_clusters(spark):
    rows = some_vectors(300)
    got = centroids.cluster(spark.createDataFrame([(*r, "x", 1) for r in rows], SOURCE).repartition(5))
    assert Counter(map(tuple, got.collect())) == plain_clusters(rows)


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_clusters_after_few_rounds(spark, rounds):
    rows = some_vectors(60, seed=rounds)
    got = centroids.cluster(spark.createDataFrame([(*r, "x", 1) for r in rows], SOURCE), rounds=rounds)
    assert Counter(map(tuple, got.collect())) == plain_clusters(rows, rounds=rounds)


def test_few_equal_and_no_vectors(spark):
    rows = [(i, [0.5] * 64) for i in range(5)]
    assert Counter(map(tuple, centroids.cluster(spark.createDataFrame([(*r, "", 1) for r in rows], SOURCE)).collect())) == plain_clusters(rows)
    assert centroids.cluster(spark.createDataFrame([], SOURCE)).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64, "", 1)], SOURCE)).count()


def test_sums_are_exact_beyond_64_bits(spark):
    side = 2**26
    rows = [(i, [float(side * (1 if i % 2 else -1))] + [0.0] * 63) for i in range(40)]
    got = centroids.cluster(spark.createDataFrame([(*r, "", 1) for r in rows], SOURCE), scale=1, k=2, rounds=2)
    assert Counter(map(tuple, got.collect())) == plain_clusters(rows, k=2, rounds=2, scale=1)


# --- collocations ---


def plain_collocations(rows, least, top=2000, longest=3):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                f[lang or "und" if lang is None else lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        n = sum(v for p, v in counts.items() if len(p) == 1)
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            inside = lambda q, p=p: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            if any(inside(q) and 100 * b >= 50 * a for q, b in candidates.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrases_of(seed=11):
    rnd = random.Random(seed)
    words = ["a", "B", "c", "dé", "the", "of", "x-y", " z", "\x01", "'q'"]
    rows = []
    for i in range(120):
        made = [rnd.choice(words[: rnd.choice((3, 10))]) + rnd.choice(("", "", "", "", ".", ",", "\n", "\r\n", "!?")) for _ in range(rnd.choice((3, 30, 120)))]
        rows.append((rnd.choice(("en", "en", "fr", None, "und", "")), rnd.choice((" ", "  ", "\t")).join(made)))
    return [*rows, *[("en", t) for t in ODD_TEXTS], *[(None, None)] * 3, rows[0], rows[0], ("en", "word " * 30_000)]


@pytest.mark.parametrize(("least", "longest"), [(10, 3), (3, 3), (8, 2), (10, 4)])
def test_collocations(spark, least, longest):
    rows = phrases_of()
    table = spark.createDataFrame([(i, t, g, 1) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase int").repartition(3)
    got = sorted(map(tuple, collocation.collocations(table, least, longest, top=40).collect()))
    assert got == plain_collocations(rows, least, 40, longest)


def test_collocations_of_small_shards(spark, monkeypatch):
    rows = phrases_of(12)
    monkeypatch.setattr(collocation, "SHARD_BYTES", 500)
    table = spark.createDataFrame([(t, g) for g, t in rows], "text string, lang string").repartition(2)
    assert sorted(map(tuple, collocation.collocations(table).collect())) == plain_collocations(rows, 10)
    assert collocation.collocations(table.limit(0)).count() == 0


def test_shards_of_one_task_are_row_groups_of_bounded_size(spark, monkeypatch, tmp_path):
    """Else a task that reads them holds all shards of the one that wrote them."""
    monkeypatch.setattr(collocation, "SHARD_BYTES", 1 << 16)
    monkeypatch.setattr(common, "scratch_dir", lambda spark: f"file://{tmp_path}/{len(list(tmp_path.iterdir()))}")
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 99)) for _ in range(8000)), f"l{i}", "s", 1) for i in range(12)]
    monkeypatch.setattr(collocation, "discard", lambda *tables: None)
    collocation.collocations(spark.createDataFrame(rows, SCHEMA).coalesce(1), 10, 3, 50, 50)
    kept = [pq.ParquetFile(f).metadata for f in sorted(tmp_path.glob("0/*.parquet"))]
    assert sum(m.num_rows for m in kept) == 12 and max(m.row_group(i).total_byte_size for m in kept for i in range(m.num_row_groups)) < 4 << 16


def test_suffix_intervals():
    numbers = np.array([1, 2, 3, 1, 2, 3, 1, 2, 0, 1, 2, 3, 0])
    pairs = np.unique(numbers[:-1] * 10 + numbers[1:], return_inverse=True)[1]
    order, common = collocation.suffix_order({1: numbers, 2: np.append(pairs, 0)}, np.array([0, 1, 3, 4, 9]), 3)
    first, width = collocation.intervals(common, 3)
    assert {tuple(numbers[order[a] : order[a] + 3].tolist()): n for a, n in zip(first, width, strict=True)} == {(1, 2, 3): 3, (2, 3, 1): 2}


def test_phrase_hashes_are_those_of_spark(spark):
    rows = [("en", "a"), ("", "a b"), ("fr", "dé x ''q"), ("en", "the of the")]
    for lang, phrase in rows:
        words = phrase.split(" ")
        own = collocation.phrase_hashes(np.array([[collocation._word_hash(lang, w.encode()) for w in words]], np.uint64)).view(np.int64)[0]
        table = spark.createDataFrame([(lang, phrase)], "lang string, phrase string")
        assert table.select(collocation.phrase_hash_column(len(words))).first()[0] == own


def test_bloom_filter_loses_nothing(spark):
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5_000)
    table = spark.createDataFrame([(int(h),) for h in hashes], "h long")
    for most_bits in (bloom.MOST_BITS, 1 << 12):
        held = bloom.bloom_filter(table, "h", most_bits)
        assert held.holds(hashes.view(np.uint64)).all() and 64 * len(held.bits) <= most_bits
    assert bloom.bloom_filter(table, "h").holds(np.random.default_rng(2).integers(0, 2**63, 5_000).view(np.uint64)).mean() < 0.05
    assert not bloom.bloom_filter(table.limit(0), "h").holds(hashes.view(np.uint64)).any()


@pytest.mark.parametrize("name", ["op11_decontaminate", "op12_centroids", "op13_collocations"])
def test_registered_queries_agree_with_sql(spark, name):
    from ..compare import compare

    assert compare(spark, llm_queries.QUERIES[name], llm_queries.ORACLE[name], "/root/testdata/sf0.001") is None
