"""Packing, BPE and token files against the libraries themselves."""

import base64
import functools
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import bpe, common, packing, tokenfile
from lodestone.llm.encoders import WordEncoder, word_encoder

from .data import SCHEMA, documents

P = pytest.importorskip("public_tokenizers")


@functools.cache
def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return t


def ids_of(name, text):
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids


def u32(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).withColumn("ids", F.lit("clash")).withColumn("length", F.lit(1))


@given(st.text(alphabet=st.sampled_from(" \n\t \x1c.,'abcAB1é́你s"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_pieces_give_the_ids_of_the_text(text):
    for name, plain in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        got = word_encoder(P.path(name), plain).encode([text])[0]
        assert np.frombuffer(got, "<u2").tolist() == ids_of(name, text)


def test_long_texts_are_dealt_to_buckets_by_their_bytes(spark):
    rows = spark.createDataFrame([(1, "some words " * 60_000), (2, "a"), (3, None)], "doc_id long, text string")
    got = packing.pack(rows, P.path("byte_bpe_50k.json"), bytes_per_bucket=40_000).collect()
    of_bucket = Counter()
    for r in got:
        of_bucket[r.sequence_id >> packing.LOCAL_BITS] += r.length
    assert len(of_bucket) > 10 and max(of_bucket.values()) <= 40_000
    assert Counter(r.doc_id for r in got)[2] == 1 and sum(r.length for r in got if r.doc_id == 1) == len(ids_of("byte_bpe_50k.json", "some words " * 60_000)) + 1


def test_packing_holds_every_id_once(spark, docs):
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), docs_per_bucket=40).collect()
    by_sequence = defaultdict(list)
    pieces = Counter()
    want = Counter()
    for doc_id, text, *_ in documents():
        want[doc_id, u32([*ids_of("byte_bpe_50k.json", text), 1])] += 1
    by_doc = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert len(ids) == r.length > 0 and r.ids_crc32 == zlib.crc32(u32(ids))
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.doc_tokens].append((r.start, ids))
        pieces[r.doc_id] += r.length
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(pieces.values()) == sum(len(k[1]) // 4 * n for k, n in want.items())
    for (doc_id, data), n in want.items():
        if doc_id is not None:
            parts = sorted(by_doc[doc_id, len(data) // 4])
            assert Counter(i for _, ids in parts for i in ids) == Counter({k: v * n for k, v in Counter(np.frombuffer(data, "<u4").tolist()).items()})
            if n == 1:
                assert u32([i for _, ids in parts for i in ids]) == data
    p = packing.padding(spark.createDataFrame(rows)).first()
    assert p.padding < 2048 * 6


def test_pieces_go_to_the_lowest_cost_with_room():
    placed = packing.pack_lengths(np.array([60, 50, 40, 30, 20]), 100, 1.0, 0.01)
    assert placed == [(0, 0, 60, 0, 0), (1, 0, 50, 1, 0), (2, 0, 40, 1, 50), (3, 0, 30, 0, 60), (4, 0, 10, 1, 90), (4, 10, 10, 0, 90)]
    assert packing.pack_lengths(np.zeros(0, np.int64), 100) == []


def test_bpe_gives_the_ids_of_tiktoken(docs):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    want = Counter((d, u32(own.encode_ordinary(t or "")), (t or "").encode()) for d, t, *_ in documents())
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_bpe_any_text(text):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    coder = bpe.byte_bpe(path, P.PATTERN)
    if not hasattr(coder, "own"):
        coder.own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.tokens, special_tokens={})
    ids = coder.encode([text])[0]
    assert ids == u32(coder.own.encode_ordinary(text)) and coder.decode(ids) == text.encode("utf-8", "surrogatepass")


def test_long_pretokens_merge_as_in_matrices(monkeypatch):
    coder = bpe.byte_bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    draw = random.Random(3)
    rows = [b"thequickbrown" * 12, b"a" * 200, "éè".encode() * 50, b"zz" * 99]
    rows += [bytes(draw.choice(b) for _ in range(draw.randint(11, 250))) for b in (b"ab", b"aab -", b"etaoinshrdlu", bytes(range(256))) for _ in range(60)]
    short = coder.encode_pretokens(rows)
    monkeypatch.setattr(bpe, "LONG_PRETOKEN", 10)
    assert [x.tolist() for x in coder.encode_pretokens(rows)] == [x.tolist() for x in short]


def test_pretokens_far_beyond_a_matrix_have_the_ids_of_tiktoken():
    tiktoken = pytest.importorskip("tiktoken")
    coder = bpe.byte_bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.tokens, special_tokens={})
    draw = random.Random(9)
    for text in ("a" * 20_001, "".join(draw.choice("abcdefghijklmnop") for _ in range(30_000)), "ab" * 9_000 + "b" * 77, "=-" * 8_000, "é" * 5_000):
        assert coder.encode([text])[0] == u32(own.encode_ordinary(text))


@pytest.mark.parametrize(("name", "plain"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_special_strings_are_text_or_tokens(name, plain):
    from tokenizers import Tokenizer

    texts = ["hi <|endoftext|> yo", "<|startoftext|>", "no such string", "<|endoftext|><|endoftext|>  x\n"]
    untouched = Tokenizer.from_file(P.path(name))
    for special, library in ((False, tokenizer(name)), (True, untouched)):
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
        assert word_encoder(P.path(name), plain, special).encode(texts) == want
    assert 50256 in untouched.encode(texts[0]).ids or plain


def test_a_full_word_cache_starts_anew():
    from lodestone.llm.wordcache import WordCache

    asked = []
    cache = WordCache(np.dtype("<u2"), lambda words: asked.append(len(words)) or [np.array([len(w), 7], "<u2").tobytes() for w in words], None, 60)
    for n in range(40):
        texts = [" ".join(f"w{n + k}" * (k % 3) for k in range(5)), ["one", "two words"]]
        want = [np.array([x for w in t for x in (len(w), 7)], "<u2").tobytes() for t in (texts[0].split(" "), texts[1])]
        assert cache.encode(texts) == want and cache.nbytes() < 400
    assert len(asked) == 40


def test_a_repeated_row_is_spread_over_buckets(spark):
    rows = spark.createDataFrame([(7, "the same row", "en", "s", 12)] * 400, SCHEMA)
    sizes = [r["count"] for r in packing.token_pieces(rows, P.path("byte_bpe_50k.json"), 1, 2048, 8).groupBy("bucket").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 100


@given(st.lists(st.integers(0, 5000), max_size=700), st.integers(0, 1 << 40))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(values, far):
    values = sorted(values) + [far + 5000]
    coded = tokenfile.EliasFano.of(np.array(values))
    back, end = tokenfile.EliasFano.from_bytes(b"??" + coded.to_bytes(), 2)
    assert back.all().tolist() == values and [back.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        back.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 20_000))
    bits = 8 * len(tokenfile.EliasFano.of(values).to_bytes()) / len(values)
    assert bits < 2.5 + np.log2(values[-1] / len(values))


def test_token_files_hold_all_documents_in_order(spark, docs):
    path = P.path("word_bpe_49k.json")
    rows = tokenfile.write_and_read(docs, path, file_tokens=3000).collect()
    want = Counter()
    for doc_id, text, *_ in documents():
        ids = [*ids_of("word_bpe_49k.json", text), 1]
        want[doc_id, len(ids), zlib.crc32(u32(ids))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    start, before = 0, -math.inf
    for r in sorted(rows, key=lambda r: r.start):
        now = -math.inf if r.doc_id is None else r.doc_id
        assert r.start == start and now >= before
        start, before = start + r.n_tokens, now


def test_a_common_id_is_spread_over_ranges(spark, tmp_path):
    rows = spark.createDataFrame([(7, f"text {i % 3}", "en", "s", 6) for i in range(600)], SCHEMA)
    listed = tokenfile.write(rows, P.path("word_bpe_49k.json"), f"file://{tmp_path}", partitions=6).collect()
    assert len(listed) == 6 and max(r.n_docs for r in listed) < 250


def test_a_file_gives_single_documents():
    docs = [np.arange(n, dtype="<u2").tobytes() for n in (3, 0, 7, 1)]
    f = tokenfile.TokenFile(tokenfile.pack_file([None, -5, 9, 9], docs, 2))
    assert f.doc_ids() == [None, -5, 9, 9] and [f.document(i).tobytes() for i in range(4)] == docs
    with pytest.raises(ValueError):
        tokenfile.TokenFile(b"not one of these files")


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack(none, P.path("byte_bpe_50k.json")).count() == 0
    assert bpe.encode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert tokenfile.write_and_read(none, P.path("word_bpe_49k.json")).count() == 0


def test_bpe_query_digests(spark, tmp_path):
    from lodestone.llm.queries import op7_bpe

    spark.createDataFrame(documents(20), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    coder = bpe.byte_bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((d, len(i) // 4, sha(i), sha((t or "").encode())) for d, t, *_ in documents(20) for i in coder.encode([t or ""]))
    assert Counter(map(tuple, op7_bpe(spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize(("name", "plain"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_word_encoder_agrees_with_the_library_on_odd_texts(name, plain):
    draw = random.Random(7)
    letters = "ab Zé'İक़़.,\n\t_-%9² 　\x85\x1cċß̈漢가"
    odd = ["", "a\n\nb", "x \ny z", "x.\n", "\n y", "İ. x", "क़. क़,\nक़.", "it's. don't, I'll!", "a  b\n\n c.\n"]
    odd += ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    encoder = WordEncoder(P.path(name), plain)
    want = [np.array(e.ids, dtype=encoder.dtype).tobytes() for e in encoder.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
    assert encoder.encode(odd) == want


def test_workers_drop_what_another_stage_kept(monkeypatch):
    monkeypatch.setattr(common, "_KEPT", {})
    monkeypatch.setattr(common, "_stage", lambda: 7)
    mine = common.kept(("words",), object)
    list(common.steps(iter([])))
    assert common.kept(("words",), object) is mine
    monkeypatch.setattr(common, "_stage", lambda: 8)
    list(common.steps(iter([])))
    assert not common._KEPT
