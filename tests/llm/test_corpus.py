"""Near-duplicates, media, quality, language model, toxicity, chat, sharding and
the pipeline against brute force."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import bloom, chat, common, components, lm, media, nearcopies, quality, sharding, simhash, toxicity

from .data import ODD_TEXTS, SCHEMA, documents


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).withColumn("fp", F.lit("clash")).withColumn("score", F.lit("clash")).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


# --- near-duplicates ---


def plain_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """The root of each of the distinct fingerprints."""
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_near_duplicates(docs):
    rows = [(d, plain_fingerprint(t)) for d, t, *_ in documents()]
    roots = plain_components({f for _, f in rows})
    least = {}
    for d, f in rows:
        if d is not None:
            least[roots[f]] = min(least.get(roots[f], d), d)
    want = Counter((d, f"{f:016x}", least.get(roots[f])) for d, f in rows)
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want


def random_fingerprints(n, seed):
    """Random ones, chains of near ones, and a dense cluster."""
    rnd = np.random.default_rng(seed)
    fps = rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rnd.integers(0, 2, n, dtype=np.uint64)
    near = [fps]
    for _ in range(4):
        flip = np.bitwise_or.reduce(np.uint64(1) << rnd.integers(0, 64, (n // 10, rnd.integers(1, 4)), dtype=np.uint64), axis=1)
        near.append(near[-1][: n // 10] ^ flip)
    centre = fps[0]
    near.append(centre ^ np.bitwise_or.reduce(np.uint64(1) << rnd.integers(0, 64, (n // 4, 3), dtype=np.uint64), axis=1))
    return np.unique(np.concatenate(near))


def assert_same_groups(fps, edges):
    got = {r.node % (1 << 64): r.root for r in components.connected_components(edges).collect()}
    groups, found = defaultdict(set), defaultdict(set)
    for f, r in plain_components([int(f) for f in fps]).items():
        groups[r].add(f)
        found[got.get(f, f"alone {f}")].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_trees_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_HOMES", 64)
    monkeypatch.setattr(simhash, "SHARD_QUERIES", 200)
    monkeypatch.setattr(simhash, "SMALL", 20)
    monkeypatch.setattr(simhash, "TREE_SAMPLE", 300)
    fps = random_fingerprints(1200, 3)
    edges = simhash.links(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"))
    trees = [simhash.grow(fps[:300], len(fps), m, 1) for m in simhash.HALVES]
    assert min(len(t.shards) for t in trees) > 3 and max(s.grid for t in trees for s in t.shards) > (1, 1)
    assert_same_groups(fps, edges)


@pytest.mark.parametrize("most", [1 << 20, 30])
def test_block_trees_lose_no_link(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "SHARD_HOMES", 64)
    monkeypatch.setattr(simhash, "SHARD_EXACT", most)
    monkeypatch.setattr(simhash, "SMALL", 20)
    monkeypatch.setattr(simhash, "TREE_SAMPLE", 300)
    fps = random_fingerprints(1200, 4)
    trees = [simhash.grow(fps[:300], len(fps), m, 0) for m in simhash.block_pairs(3)]
    assert len(trees) == 10 and (max(s.grid for t in trees for s in t.shards) > (1, 1)) == (most == 30)
    assert_same_groups(fps, simhash.links(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"), many=0))


def test_block_masks_leave_every_three_bits_alone():
    masks = simhash.block_pairs(3)
    at = [sum(1 << k for k, m in enumerate(masks) if not int(m) >> b & 1) for b in range(64)]
    assert all(at[a] & at[b] & at[c] for a in range(64) for b in range(a, 64) for c in range(b, 64))


@pytest.mark.parametrize("total", [1 << 25, 1 << 28, 1 << 32])
def test_a_fingerprint_goes_to_as_many_shards_at_any_size(total):
    rnd = np.random.default_rng(1)
    sample = rnd.integers(0, 1 << 63, 16_384, dtype=np.uint64) * np.uint64(2)
    sent = most = 0
    for mask in simhash.block_pairs(3)[:3]:
        tree = simhash.grow(sample, total, mask, 0)
        placed = simhash.place(tree, sample)
        sent += sum(len(h) * (1 if s.grid == (1, 1) else sum(s.grid)) for s, h, _ in placed) / len(sample) / 3
        most = max([most, *[len(h) * total / len(sample) / s.grid[0] for s, h, _ in placed]])
    # a row a tree; from 2^32 on shards are dealt to grids, as the sample ends
    assert sent <= (1.01 if total <= 1 << 28 else 30) and most <= 2 * simhash.SHARD_EXACT


def test_long_paths_and_empty_edges(spark):
    path = spark.range(300).selectExpr("id + 7 AS a", "id + 8 AS b")
    assert {(r.node, r.root) for r in components.connected_components(path).collect()} == {(i, 7) for i in range(7, 308)}
    assert components.connected_components(path.where("a < 0")).count() == 0


def test_one_row_of_each_group_with_null_and_repeated_ids(spark):
    a, b, c, d = ([f"{x}{i}" for i in range(60)] for x in "abcd")
    text = {x[0]: " ".join(x) for x in (a, b, c, d)}
    rows = [(None, text["a0"]), (None, text["b0"]), (None, text["b0"]), (7, text["c0"]), (7, text["d0"]), (9, text["d0"]), (None, text["c0"]), (7, text["c0"]), (None, None), (None, "")]
    got = nearcopies.one_of_each_group(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)).collect()
    assert Counter((r.doc_id, r.text or "") for r in got) == Counter([(None, text["a0"]), (None, text["b0"]), (7, text["c0"]), (7, text["d0"]), (None, "")])


def edited_texts(seed=11):
    """Groups of texts with more and more words changed, and loose ones."""
    rnd = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(500)]
    out = []
    for g in range(12):
        text = list(rnd.choice(words, 150))
        out.append(" ".join(text))
        for _ in range(12 if g else 40):
            copy = list(text)
            for at in rnd.integers(0, 150, rnd.integers(1, 6)):
                copy[at] = "changed"
            out.append(" ".join(copy))
    return [*out, *out[:5], None, "", "one two", "One  two"]


@pytest.mark.parametrize("most_bits", [64, bloom.MOST_BITS])
def test_pipeline_drops_near_copies_from_four_fifths_on(spark, monkeypatch, most_bits):
    """Also where the filters let everything through."""
    import corpus_pipeline

    monkeypatch.setattr(nearcopies, "CELL", 8)
    monkeypatch.setattr(bloom, "MOST_BITS", most_bits)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(edited_texts())]
    sets = []
    for _, t, *_ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    plain = {i: plain_fingerprint(t) for i, t, *_ in rows}
    bits = plain_components(set(plain.values()))
    assert len(set(root)) < len({bits[f] for f in plain.values()})
    table = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"source": "key", "n_chars": "MAYBE"}).withColumn("root", F.col("doc_id") + 1)
    kept = corpus_pipeline.drop_near_copies(spark, table, "")
    assert kept.columns == table.columns
    got = [tuple(r) for r in kept.collect()]
    assert sorted(got) == [(*rows[i], i + 1) for i in sorted(set(root))]
    assert corpus_pipeline.drop_near_copies(spark, table.limit(0), "").count() == 0


@pytest.mark.parametrize("shard", [20, 1 << 18])
def test_near_copies_meet_in_vantage_point_trees(spark, monkeypatch, shard):
    """Every pair within the radii of a tree is in a group of it, however the
    tree is cut into shards, and pairs at 0.8 hardly ever meet in none."""
    monkeypatch.setattr(nearcopies, "SHARD", shard)
    monkeypatch.setattr(simhash, "SMALL", 8)
    assert all(nearcopies.missed(bits, words) <= 0.0005 for _, bits, words in nearcopies.TREES)
    _, bits, words = nearcopies.TREES[0]
    sets = {h.tobytes(): h for h in map(nearcopies.shingles, filter(None, edited_texts()))}
    fps = nearcopies.Projection(words)(np.array([nearcopies.Projection.sums(h) for h in sets.values()]))
    assert {len(t.shards) > 2 for t in nearcopies._trees(spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(fps)], "node long, words array<long>"), len(fps), bits, words, shard)} == {shard == 20}
    want, near, met = set(), 0, 0
    all_sets = list(sets.values())
    for i in range(len(fps)):
        apart = (fps[:i] ^ fps[i]).view(np.uint64)
        low = np.uint64((1 << bits) - 1)
        tree = np.minimum(np.bitwise_count(apart & low), np.bitwise_count(apart & (low << np.uint64(32))))
        linked = ((tree <= 1) & (np.bitwise_count(apart) <= nearcopies.RADIUS)).any(axis=1)
        want |= {(j, i) for j in np.flatnonzero(linked).tolist()}
        for j in range(i):
            common = len(np.intersect1d(all_sets[i], all_sets[j], assume_unique=True))
            if 5 * common >= 4 * (len(all_sets[i]) + len(all_sets[j]) - common):
                near, met = near + 1, met + linked[j]
    assert near > 200 and met >= 0.999 * near
    nodes = spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(fps)] + [(-1, [])], "node long, words array<long>")
    groups = defaultdict(set)
    for r in nearcopies._groups(nodes, bits, words).collect():
        groups[r.bucket].add(r.node)
    got = {(j, i) for g in groups.values() for i in g for j in g if j < i}
    assert want <= got and min(map(len, groups.values())) > 1 and -1 not in {n for g in groups.values() for n in g}


def test_a_large_group_of_near_copies_is_dealt_once(spark, monkeypatch):
    """However many trees find a group, its nodes go to exact comparison a few
    times; it holds copies that are near one another and ones near none."""
    rnd = np.random.default_rng(5)
    base = [f"b{i}" for i in range(150)]
    out = []
    for k in range(300):
        copy = list(base)
        for at in rnd.integers(0, 150, 1 + k % 12):
            copy[at] = f"e{rnd.integers(0, 1 << 30)}"
        out.append(" ".join(copy))
    dealt, plain = [], nearcopies._edges

    def edges(cells, sets):
        dealt.append(cells.count())
        return plain(cells, sets)

    monkeypatch.setattr(nearcopies, "_edges", edges)
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(out)], SCHEMA)
    kept = {r.doc_id for r in nearcopies.one_of_each_group(rows).collect()}
    sets, root = [set(nearcopies.shingles(t).tolist()) for t in out], list(range(len(out)))
    for i in range(len(out)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert kept == set(root) and 20 < len(kept) < 280
    assert sum(dealt) <= 4 * len(out)


@pytest.mark.parametrize("alike", [16, 4096])
def test_families_are_what_alike_fingerprints_of_a_bucket_lead_to(spark, monkeypatch, alike):
    monkeypatch.setattr(nearcopies, "ALIKE", alike)
    words = 28
    sets = list({h.tobytes(): h for h in map(nearcopies.shingles, filter(None, edited_texts()))}.values())
    fps = nearcopies.Projection(words)(np.array([nearcopies.Projection.sums(h) for h in sets]))
    apart = np.bitwise_count((fps[:, None] ^ fps[None]).view(np.uint64)).sum(axis=2, dtype=np.int64)
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 4 * (len(sets[i]) + len(sets[j]) - c)]
    assert len(near) > 200 and max(apart[p] for p in near) <= nearcopies.most_apart(words) < np.median(apart)
    buckets = [range(len(sets)), range(0, len(sets), 3), *[range(i, i + 3) for i in range(0, 90, 2)]]
    root = list(range(len(sets)))
    for bucket in buckets:
        for i in bucket:
            for j in bucket:
                if j < i and root[i] != root[j] and apart[i, j] <= nearcopies.most_apart(words):
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
    groups = spark.createDataFrame([(k, i) for k, bucket in enumerate(buckets) for i in bucket], "bucket long, node long")
    nodes = spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(fps)], "node long, words array<long>")
    found = {r.node: r.root for r in components.connected_components(nearcopies._alike(groups, nodes, words)).collect()}
    assert [found.get(i, i) for i in range(len(sets))] == root


def test_steps_drop_their_tables(spark, tmp_path, monkeypatch):
    """Near copies leave the shared folder less than what they read."""
    made = []
    monkeypatch.setattr(common, "scratch_dir", lambda spark: made.append(f"{tmp_path}/{len(made)}") or f"file://{made[-1]}")
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(edited_texts())], SCHEMA)
    assert nearcopies.one_of_each_group(rows).count() < rows.count()
    left = [p for p in made if Path(p).exists()]
    assert len(made) > 15 and len(left) == 1


# --- media ---


def test_texts_round_trip_as_media(docs):
    seen = set()
    for r in media.features(media.store_texts(docs)).collect():
        seen.add(r.media_type)
        assert r.corrected
    assert seen == set(media.STORED)
    want = Counter()
    for d, t, *_ in documents():
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    got = media.features(media.store_texts(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()
    assert Counter(map(tuple, got)) == want


def samples():
    import gzip
    import io
    import zipfile

    payload = bytes(range(64)) * 3
    out = {k: media.store(payload, k) for k in media.STORED}
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "text")
    out["application/zip"] = z.getvalue()
    out["application/gzip"] = gzip.compress(b"text" * 50)
    out["application/pdf"] = b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"
    out["image/gif"] = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b",\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    out["image/jpeg"] = b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\4xy\xff\xda\0\4zz\1\2\xff\0\3\xff\xd9"
    page = b"OggS\0" + b"\4" + b"\0" * 20 + b"\1\5hello"
    out["audio/ogg"] = page
    return out


def test_every_format_is_found_whole_embedded_and_not_when_cut():
    for kind, data in samples().items():
        assert media.find_media(data)[0] == (kind, 0, len(data)), kind
        assert (kind, 9, len(data)) in media.find_media(b"some text" + data + b" and more"), kind
        assert all(k != kind for k, _, _ in media.find_media(data[:-1])), kind


def test_false_magics_take_one_scan():
    import time

    n = 1_000_000
    for part in (b"%PDF-1 ", b"PK\x03\x04", b"GIF89a.......!", b"GIF89a\0\0\0\0\0\0\0,........\0.", b"OggS\0\0" + bytes(21), b"P5\n1 1\n", b"BM", b"\x1f\x8b\x08", b"RIFF....WAVE"):
        began = time.time()
        assert media.find_media(part * (n // len(part)) + b"x") is not None
        assert time.time() - began < 15, part


@pytest.mark.parametrize("kind", ["wav", "gif"])
def test_chains_of_false_headers_take_linear_time(kind):
    """Headers within chunks of each other, as valid UTF-8 of 10 MB."""
    import time

    if kind == "wav":
        one = b"RIFF\x7f\x7f\x7f\x00WAVEJUNK\x04\0\0\0" + b"JUNK\x0c\0\0\0"
    else:
        one = b"GIF89a\1\0\1\0\0\0\0!\1\3abc\0!\2\x0f"
    text = one * (10_000_000 // len(one))
    began = time.process_time()
    assert media.find_media(text) == []
    assert time.process_time() - began < 10


def test_wav_and_gif_against_plain_walks():
    rnd = np.random.default_rng(8)

    def plain_wav(b, at):
        if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
            return 0
        end, p, seen = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little"), at + 12, set()
        while p + 8 <= end <= len(b):
            n = int.from_bytes(b[p + 4 : p + 8], "little")
            seen.add(b[p : p + 4] if b[p : p + 4] != b"fmt " or n >= 16 else b"")
            p += 8 + n + n % 2
        return end - at if p == end and {b"fmt ", b"data"} <= seen else 0

    found = 0
    for _ in range(300):
        parts = []
        for _ in range(rnd.integers(2, 12)):
            body = b"".join(k + int(n).to_bytes(4, "little") + bytes(int(n)) for k, n in zip(rnd.choice([b"fmt ", b"data", b"JUNK"], 4), rnd.choice([0, 2, 16, 18], 4), strict=True))
            parts.append(b"RIFF" + (4 + len(body) + int(rnd.choice([0, 0, 1, 8, 40]))).to_bytes(4, "little") + b"WAVE" + body)
        data = b"".join(parts)
        value = media.Value(data)
        for at in range(len(data)):
            if data[at : at + 4] == b"RIFF":
                want = plain_wav(data, at)
                assert media._wav(data, at, value) == want
                found += want > 0
    assert found > 100


def test_declared_types(spark):
    png = samples()["image/png"]
    rows = [(1, png, "image/jpeg"), (2, png, "image/png"), (3, b"plain", "text/plain"), (4, b"plain", "image/gif"), (5, None, "image/gif"), (6, b"", None), (7, b"head" + png, None)]
    got = {r.i: r for r in media.sniff(spark.createDataFrame(rows, "i int, media binary, declared string").withColumn("corrected", F.lit("clash")), "media", "declared").collect()}
    assert {i: (r.media_type, r.corrected) for i, r in got.items()} == {
        1: ("image/png", True), 2: ("image/png", False), 3: ("text/plain", False), 4: (media.UNKNOWN, True), 5: ("image/gif", False), 6: (media.UNKNOWN, False), 7: (media.UNKNOWN, False)}
    assert [tuple(x) for x in got[7].embedded] == [("image/png", 4, len(png))]


# --- quality ---


def plain_base(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_against_brute_force(spark, docs):
    trusted = spark.createDataFrame([(i,) for i in range(0, 100, 2)] + [(None,), (4,)], "doc_id long")
    rule = quality.fit(docs, trusted)
    raw, target, scores = Counter(), Counter(), {}
    grams = {}
    for i, (d, t, *_) in enumerate(documents()):
        grams[i] = quality.ngram_buckets(words_of(t), {}).tolist() if words_of(t) else []
        raw.update(grams[i])
        if d is not None and d < 100 and d % 2 == 0:
            target.update(grams[i])
    n_raw, n_target = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    for i, g in grams.items():
        scores[i] = sum(math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in g) / max(1, len(g))
    own = [scores[i] for i, (d, t, *_) in enumerate(documents()) if d is not None and d < 100 and d % 2 == 0 and words_of(t)]
    threshold = np.mean(own) - quality.DEVIATIONS * np.std(own)
    assert rule.threshold == pytest.approx(threshold, abs=1e-5)
    want = Counter()
    for i, (d, t, *_) in enumerate(documents()):
        base = plain_base(t)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        want[d, *base, failed, not failed and scores[i] >= rule.threshold, round(scores[i], 9)] += 1
    got = quality.judge(docs, rule).collect()
    assert Counter((*r[:8], round(r[8], 9)) for r in got) == want
    kept = quality.kept(docs, rule)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({d: n for d, n in Counter(r.doc_id for r in got if r.kept).items()})


def test_quality_without_trusted_rows(spark, docs, none):
    rule = quality.fit(docs, spark.createDataFrame([], "doc_id long"))
    assert quality.judge(docs, rule).where("kept = base_failed").count() == 0
    assert quality.judge(none, quality.fit(none, spark.createDataFrame([(1,)], "doc_id long"))).count() == 0


# --- language model ---


def tokens_of(text):
    return [*(text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split(), None]


def plain_lm():
    rows = [(d, tokens_of(t), zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1) for d, t, *_ in documents()]
    c, pairs = Counter(), Counter()
    for _, tokens, held in rows:
        if not held:
            c.update(tokens)
            pairs.update(zip(["start", *tokens], tokens, strict=False))
    return rows, c, pairs


def test_language_model_base_counts(docs):
    rows, c, pairs = plain_lm()
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for d, tokens, held in rows:
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        want[d, held, len(tokens), sum(c[t] > 0 for t in tokens), n].append(base)
    got = defaultdict(list)
    for r in lm.score(docs).collect():
        got[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens].append(r.base_score)
        assert r.score <= 0
    assert got.keys() == want.keys()
    for k in want:
        assert sorted(got[k]) == pytest.approx(sorted(want[k]), abs=1e-6)


def test_language_model_is_near_the_model_of_exact_counts(docs):
    rows, c, pairs = plain_lm()
    n, v = sum(c.values()), len(c)
    g = sum(x == 1 for x in pairs.values()) / n
    starts = sum(not held for *_, held in rows)
    exact = []
    for _, tokens, _ in rows:
        s = 0
        for u, w in zip(["start", *tokens], tokens, strict=False):
            p = (c[w] + 0.5) / (n + 0.5 * (v + 1))
            before = starts if u == "start" else c[u]
            s += math.log10((1 - g) * pairs[u, w] / before + g * p if before else p)
        exact.append(s)
    got = lm.score(docs).agg(F.sum("score")).first()[0]
    assert abs(got - sum(exact)) < 0.05 * abs(sum(exact))


def test_shares_of_the_filter_give_the_same_scores(docs, monkeypatch):
    monkeypatch.setattr(lm, "SEGMENT_NGRAMS", 2000)
    whole = sorted((r.doc_id is not None, r.doc_id or 0, round(r.score, 6)) for r in lm.score(docs).collect())
    plan = lm.learn(docs, broadcast_bytes=4000)
    assert plan.word_shares > 2 and plan.pair_shares > 2
    sizes = [(m.words.keys.nbytes + len(m.words.single.bits)) if m.words else len(m.pairs.bits) for m in (plan.model(*x) for x in plan.passes())]
    assert max(sizes) < 12_000
    shared = sorted((r.doc_id is not None, r.doc_id or 0, round(r.score, 6)) for r in lm.score(docs, broadcast_bytes=4000).collect())
    assert [x[:2] for x in shared] == [x[:2] for x in whole]
    assert [x[2] for x in shared] == pytest.approx([x[2] for x in whole], abs=1e-5)


def test_filter_never_counts_too_low():
    keys = lm._mixed(np.arange(1, 5001, dtype=np.uint64))
    counts = np.arange(1, 5001)
    bits = lm.build_segment(keys, counts)
    f = lm.Filter.of({0: bits.tobytes()}, 64, 0, 1)
    got = lm._MIDDLE[f.levels(keys)]
    exact = lm._MIDDLE[lm.levels_of(counts)]
    assert (got >= exact).all() and (got == exact).mean() > 0.9
    unseen = f.levels(lm._mixed(np.arange(10_000, 20_000, dtype=np.uint64)))
    assert (unseen > 0).mean() < 0.06


def test_language_model_of_nothing(none, spark):
    assert lm.score(none).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm.score(spark.createDataFrame([(held, "a b", None, None, None)], SCHEMA)).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0)


# --- toxicity ---


def labelled(n=400):
    rows, labels = [], []
    rnd = np.random.default_rng(4)
    for i in range(n):
        words = ["".join(rnd.choice(list("abcdefgh"), rnd.integers(2, 7))) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(int(rnd.integers(0, 60)), str(rnd.choice(["zzgrumpf!", "Qworz", "kyxident"])))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    c = toxicity.fit(docs, marks)
    held = [(r.predicted, labels[r.doc_id][2]) for r in toxicity.score(docs, c).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.97
    clean = toxicity.clean(docs.withColumn("score", F.lit("clash")), c)
    assert clean.columns == [*docs.columns, "score"] and abs(clean.count() - 320) <= 6


def test_toxicity_scores_against_a_plain_model(spark):
    """Dictionaries and loops over the same n-grams, ratios and steps."""
    rows, labels = labelled(120)
    rows = [*rows, rows[3], (None, "no id", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    c = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    def grams(text):
        s = f" {' '.join(text.lower().split())} "
        out = set()
        for n in toxicity.SIZES:
            for i in range(len(s) - n + 1):
                h = n
                for k in range(n):
                    h = ((h ^ ord(s[i + k])) * 0x01000193) % 2**32
                h = ((h ^ h >> 15) * 0x9E3779B1) % 2**32
                out.add(h >> 32 - toxicity.FEATURE_BITS)
        return out

    verdict = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    known = [(i, grams(t), verdict[i]) for i, t, *_ in rows if i in verdict]
    clean, toxic = Counter(), Counter()
    for _, g, t in known:
        (toxic if t else clean).update(g)
    n_toxic = sum(t for *_, t in known)
    n_clean = len(known) - n_toxic
    ratio = {f: math.log((toxic[f] + 1) / (n_toxic + 2)) - math.log((clean[f] + 1) / (n_clean + 2)) for f in {*clean, *toxic}}
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    once = sorted({i: (g, t) for i, g, t in known}.items(), key=lambda x: (hashes[x[0]], x[0]))
    w, mean = defaultdict(float), defaultdict(float)
    rate = (sum(t for _, (_, t) in once) + 1) / (len(once) + 2)
    bias, mean_bias = math.log(rate / (1 - rate)), 0.0
    for p in range(toxicity.PASSES):
        for _, (g, t) in once:
            z = bias + sum(w[f] * ratio[f] for f in g)
            step = 2 / (1 + p) * (t - 1 / (1 + math.exp(-z))) / (1 + sum(ratio[f] ** 2 for f in g))
            for f in g:
                w[f] += step * ratio[f]
            bias += step
        if p:
            for f in w:
                mean[f] += w[f]
            mean_bias += bias
    want = {}
    for i, t, *_ in rows:
        z = (mean_bias + sum(mean[f] * ratio[f] for f in grams(t) if f in mean)) / (toxicity.PASSES - 1)
        want[i] = 1 / (1 + math.exp(-z))
    got = {r.doc_id: r.score for r in toxicity.score(docs, c).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_toxicity_of_very_long_texts_and_bounded_samples(spark, monkeypatch):
    text = "The  quick brown Fox " * 400
    short = set(toxicity.present(text).tolist())
    monkeypatch.setattr(toxicity, "CHUNK", 100)
    assert set(toxicity.present(text).tolist()) == short
    rows, labels = labelled(120)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, marks, most_features=3).weights.any() == np.False_
    assert toxicity.fit(docs, marks, most_features=5000).weights.any()


def test_toxicity_ignores_held_out_labels(spark):
    rows, labels = labelled(200)
    docs = spark.createDataFrame(rows, SCHEMA)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_toxicity_odd_rows(docs, none, spark):
    one_kind = toxicity.fit(docs, spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs, one_kind).collect()
    assert len(got) == len(documents()) and all(0 <= r.score < 0.3 and r.predicted == 0 for r in got)
    assert toxicity.score(none, one_kind).count() == 0


# --- sharding ---


def test_sharding_fills_evenly_and_moves_few():
    table = sharding.fill(sharding.SHARDS, sharding.SLOTS)
    counts = Counter(table)
    assert len(counts) == 32 and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill(sharding.SHARDS[:-1], sharding.SLOTS)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 31)
    assert moved / sharding.SLOTS < 0.15
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            sharding.fill(bad, 7)
    with pytest.raises(ValueError):
        sharding.fill(("a", "b"), 9)


def test_sharding_against_sql(spark, docs):
    shards = sharding.SHARDS[:5]
    rows = docs.withColumn("slot", F.lit("clash")).withColumn("shard", F.lit("clash"))
    placed = sharding.assign(rows, "doc_id", shards, 101)
    assert sorted(placed.columns) == sorted(rows.columns)
    got = Counter(map(tuple, placed.select("doc_id", "slot", "shard").collect()))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint)")
    con.executemany("insert into documents values (?)", [(d,) for d, *_ in documents()])
    assert got == Counter(con.sql(sharding.oracle("documents", "doc_id", shards, 101)).fetchall())
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


# --- chat ---

CHAT = "conv_id long, turn long, role string, text string"


def snapshots():
    full = [(t, "user" if t % 2 == 0 else "assistant", f"line {t}") for t in range(6)]
    rows = [(1, *x) for x in full[:2]] + [(2, *x) for x in full[:4]] + [(3, *x) for x in full] + [(4, *x) for x in full]
    rows += [(5, *full[0]), (5, 1, "assistant", "another answer")]
    rows += [(6, *full[1])]
    rows += [(7, 0, "user", None), (8, 0, "user", ""), (8, 1, None, "x"), (None, 0, "user", "no id"), (None, None, None, None)]
    rows += [(9, 5, "user", "b"), (9, 5, "user", "a"), (9, 5, "assistant", "c"), (9, 5, "assistant", "c")]
    rows += [(10, 3000 * t, "user", f"far {t}") for t in range(4)] + [(11, 0, "user", "far 0"), (11, 3000, "user", "far 1")]
    return rows


def test_chat_keeps_maximal_conversations(spark):
    got = {(r.conv_id, r.segment): r for r in chat.render(spark.createDataFrame(snapshots(), CHAT).withColumn("block", F.lit("clash"))).collect()}
    assert set(got) == {(c, 0) for c in (3, 5, 6, 7, 8, 9, 10, None)}
    assert got[3, 0].n_turns == 6 and got[3, 0].n_copies == 2
    assert got[3, 0].rendered == "".join(f"<|{'user' if t % 2 == 0 else 'assistant'}|>\nline {t}\n" for t in range(6))
    assert got[9, 0].rendered == "<|assistant|>\nc\n<|user|>\na\n<|user|>\nb\n"
    assert got[10, 0].rendered == "".join(f"<|user|>\nfar {t}\n" for t in range(4))
    cut = {r.segment: r for r in chat.render(spark.createDataFrame(snapshots(), CHAT), segment_turns=3).where("conv_id = 10").collect()}
    assert {s: (r.n_turns, r.first_place) for s, r in cut.items()} == {0: (4, 1), 1: (4, 4)}
    assert cut[0].rendered + cut[1].rendered == got[10, 0].rendered
    assert chat.render(spark.createDataFrame([], CHAT)).count() == 0


def test_chat_against_sql(spark):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", snapshots())
    result = con.sql(chat.ORACLE)
    got = chat.render(spark.createDataFrame(snapshots(), CHAT)).select(*result.columns)
    assert Counter(map(tuple, got.collect())) == Counter(result.fetchall())


def test_chat_spreads_a_conversation_with_few_turn_numbers(spark):
    rows = [(None, i % 20 if i % 3 else None, "user", f"text {i}") for i in range(3000)] + [(1, 0, "user", "text 1"), (None, 0, "user", "text 3")]
    rolled = chat.turns(spark.createDataFrame(rows, CHAT))
    held = rolled.groupBy("conv_id", "part").count().agg(F.max("count")).first()[0]
    assert held < 1500
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    result = con.sql(chat.ORACLE)
    got = chat.render(spark.createDataFrame(rows, CHAT)).select(*result.columns)
    assert Counter(map(tuple, got.collect())) == Counter(result.fetchall())


# --- pipeline ---


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows, labels = labelled(240)
    rows += [(1000 + i, r[1], *r[2:]) for i, r in enumerate(rows[:30])]  # copies
    rows += [(2000, "too short", "en", "s", 9), (2001, None, None, None, None), (2002, "spam spam spam " * 80, "en", "s", 1), (2003, "", "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        left = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "toxicity":
            gone = {i for i in ids if any(w in (texts[i] or "") for w in ("zzgrumpf", "Qworz", "kyxident"))}
            assert len(left ^ (ids - gone)) <= 3
        elif name == "quality rules":
            assert ids - left == {i for i in ids if (b := plain_base(texts[i]))[0] < 50 or 2 * b[4] > b[0]}
        else:
            fps = {i: plain_fingerprint(texts[i]) for i in ids}
            roots = plain_components(set(fps.values()))
            least = {}
            for i in sorted(ids):
                least.setdefault(roots[fps[i]], i)
            assert left == set(least.values())
        kept = out
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_odd_texts_are_there():
    assert {t for _, t, *_ in documents()} >= set(ODD_TEXTS)
