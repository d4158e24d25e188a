"""Phrase collocation mining from word-id suffix arrays.

A shard is some megabytes of the texts of one language.  Its words are numbered
and its suffixes sorted by prefix doubling, as far as phrases are long; equal
phrases are then intervals of the longest common prefixes, whose widths are the
phrase's counts in the shard.  The shards' counts are merged by phrase.

Phrases of ``n`` words are counted after those of ``n - 1``: a phrase is as
frequent as its rarest part at most, so only those are sent on of which both
shorter parts reached the least count.  Which did is told by a broadcast Bloom
filter of bounded size; a false hit costs a row in the shuffle and nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import BloomFilter, bloom_filter
from .common import LOWER_ASCII, column, discard, join_unique, only, steps, texts, written

LEAST, LONGEST, TOP = 10, 3, 2000
#: Percentage of a phrase's count from which a longer phrase stands for it.
COVERED = 50
#: Text bytes of a shard, or one text.
SHARD_BYTES = 8 << 20
#: Phrases that a task hands on at a time.
PHRASES = 1 << 16
#: Parts in which a language's phrases are ranked first.
PARTS = 16

# A full stop stands for every break, as none is left in a word; spaces and tabs separate.
_BREAKS = bytes(0x2E if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c in b" \t" else c for c in LOWER_ASCII)


def words_of(text: str) -> list[bytes]:
    """The words in lower case, with a word ``.`` for every break."""
    return text.encode("utf-8", "surrogatepass").translate(_BREAKS).replace(b".", b" . ").split()


def _word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass") + b"\x00" + word, seed=42)


def _chained(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """XXH64 of 8-byte values, each with a seed of its own."""
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = (seeds + _P5 + np.uint64(8)) ^ (turn(values * _P2, 31) * _P1)
    h = turn(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


# --- fixed values: the primes of XXH64 ---
_P1, _P2, _P3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_P4, _P5 = np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5)
# --- end of fixed values ---


def phrase_hashes(word_hashes: np.ndarray) -> np.ndarray:
    """A hash of each row of words, as Spark's ``xxhash64`` gives it for the
    words' hashes in as many columns."""
    h = np.full(len(word_hashes), 42, np.uint64)
    for k in range(word_hashes.shape[1]):
        h = _chained(word_hashes[:, k], h)
    return h


def phrase_hash_column(n: int):
    """The same for the columns ``lang`` and ``phrase``, of ``n`` words."""
    word = lambda k: F.xxhash64(F.concat("lang", F.lit("\x00"), F.element_at(F.split("phrase", " "), k)))
    return F.xxhash64(*[word(k) for k in range(1, n + 1)])


def suffix_order(ranks: dict[int, np.ndarray], at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes from the places ``at``, in order of their first ``n``
    words, and how many of these each has in common with the one before it.

    ``ranks`` has, for every width so far, the rank of each place by so many
    words; those of the widest power of two below ``n`` double to ``n``."""
    width = 1 << (n - 1).bit_length() - 1 if n > 1 else 1
    keys = ranks[width][at].astype(np.int64)
    keys *= int(ranks[width].max(initial=0)) + 1
    keys += ranks[width][at + n - width]
    order = at[np.argsort(keys)]
    del keys
    common = np.zeros(len(order), np.int8)
    for k in range(n):
        words = ranks[1][order + k]
        common[1:] += (words[1:] == words[:-1]) & (common[1:] == k)
    return order, common


def intervals(common: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each interval of suffixes that share ``n`` words begins, and its
    width."""
    first = np.flatnonzero(common < n)
    return first, np.diff(np.append(first, len(common)))


def shard_counts(lang: str, words: list[bytes], ids: np.ndarray, n: int, filters: list[BloomFilter]) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of ``n`` words of a shard, each as the numbers of its words,
    and their counts.  ``ids`` numbers ``words`` from 1; 0 is a break.
    ``filters`` tell which phrases of 1 to ``n - 1`` words are frequent."""
    if n == 1:
        return np.arange(1, len(words) + 1)[:, None], np.bincount(ids, minlength=len(words) + 1)[1:]
    hashes = np.array([0, *[_word_hash(lang, w) for w in words]], np.uint64)
    able = filters[0].holds(phrase_hashes(hashes[:, None]))
    able[0] = False
    able = able[ids]
    ranks = {1: ids}
    for m in range(2, n + 1):
        at = np.flatnonzero(able[:-1] & able[1:]).astype(np.int32)  # a phrase of m words needs two of m - 1
        order, common = suffix_order(ranks, at, m)
        first, width = intervals(common, m)
        phrases = ids[order[first][:, None] + np.arange(m, dtype=np.int32)]
        if m == n:
            return phrases, width
        frequent = filters[m - 1].holds(phrase_hashes(hashes[phrases]))
        able = np.zeros(len(ids), bool)
        able[order[np.repeat(frequent, width)]] = True
        if m & (m - 1) == 0:
            ranks[m] = np.zeros(len(ids), np.int32)
            ranks[m][order] = np.repeat(np.arange(1, len(first) + 1, dtype=np.int32), width)
    raise ValueError(n)


class _Numbers(dict):
    """A number for each word, by order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def shards(rows: DataFrame) -> DataFrame:
    """``lang, words, ids``: the distinct words of about ``SHARD_BYTES`` of
    texts of a language, and the texts as 32-bit numbers of these words from 1
    on, with 0 for each break and between texts."""

    def run(batches):
        held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        size: dict[str, int] = {}

        def shard(lang: str) -> pa.RecordBatch:
            numbers, ids = held.pop(lang)
            del size[lang]
            columns = [pa.array([lang], pa.string()), pa.array([list(numbers)[1:]], pa.list_(pa.binary())), pa.array([np.concatenate(ids).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "words", "ids"])

        for batch in steps(batches):
            new: dict[str, list[str]] = {}
            for lang, text in zip(column(batch, "lang").to_pylist(), texts(column(batch, "text")), strict=True):
                new.setdefault(lang, []).append(text)
            for lang, some in new.items():
                numbers, ids = held.setdefault(lang, (_Numbers({b".": 0}), []))
                words = words_of("\n".join(some))
                # a break after the last word keeps phrases within a text
                ids.append(np.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)), np.int32(0)))
                size[lang] = size.get(lang, 0) + sum(map(len, some))
            while sum(size.values()) > SHARD_BYTES:  # the largest first, so that few languages do not make small shards of many
                yield shard(max(size, key=size.get))
        for lang in list(held):
            yield shard(lang)

    return rows.mapInArrow(run, "lang string, words array<binary>, ids binary")


def counted(cut: DataFrame, n: int, filters: list[BloomFilter], least: int) -> DataFrame:
    """``lang, phrase, f`` of the phrases of ``n`` words that occur ``least``
    times or more in the shards ``cut``; with ``n = 1`` also the empty phrase,
    which stands for all words of the language."""
    held = cut.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                lang, words = column(batch, "lang")[k].as_py(), column(batch, "words")[k].values
                ids = np.frombuffer(column(batch, "ids")[k].as_buffer(), np.int32)
                phrases, count = shard_counts(lang, words.to_pylist() if n > 1 else words, ids, n, held.value)
                named = words.cast(pa.string())
                for a in range(0, len(phrases), PHRASES):
                    some = phrases[a : a + PHRASES]
                    joined = pc.binary_join_element_wise(*[named.take(pa.array(some[:, i] - 1)) for i in range(n)], " ")
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), joined, pa.array(count[a : a + PHRASES])], ["lang", "phrase", "f"])
                if n == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([int(count.sum())])], ["lang", "phrase", "f"])

    # a shard has each phrase once, so the rows are dealt out first: a map of all phrases of a task would be large and combine little
    parts = 2 * int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.mapInArrow(run, "lang string, phrase string, f long").repartition(parts, "lang", "phrase")
    summed = dealt.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    table = written(summed.where((F.col("f") >= least) | (F.col("phrase") == "")))
    held.destroy()
    return table


def _cuts(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """``candidates`` with ``l, r, score`` of the cut of the lowest score."""
    words = F.split("phrase", " ")
    k = F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")
    cut = candidates.select("*", k).select("*", F.slice(words, 1, F.col("k")).alias("a1"), F.slice(words, F.col("k") + 1, F.col("n_words") - F.col("k")).alias("a2"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.array_join(a, " ").alias("part")) for s, a in (("l", "a1"), ("r", "a2"))]))
    asked = written(cut.select("lang", "phrase", "n_words", "a", "k", sides.alias("s")).select("lang", "phrase", "n_words", "a", "k", "s.side", "s.part"))
    counts = asked.groupBy("lang", "part").agg(F.count("*").alias("asks"))
    found = join_unique(asked, frequent.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"], counts, "asks", asked.count())
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f"))).alias(s)
    both = found.groupBy("lang", "phrase", "n_words", "a", "k").agg(side("l"), side("r"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    # products pass 64 bits, so they are decimals of 38 digits
    both = both.withColumns({"over": (exact("a") * exact("a")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), "under": exact("l") * exact("r")})
    scored = both.withColumn("score", F.expr("over div under").cast("long"))
    best = scored.groupBy("lang", "phrase", "n_words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "n_words", "a", "b.l", "b.r", "b.score")


def _uncovered(candidates: DataFrame, covered: int) -> DataFrame:
    """``candidates`` but for those that a longer one stands for."""
    words = F.split("phrase", " ")
    spans = F.expr("flatten(transform(sequence(2, n_words - 1), m -> transform(sequence(1, n_words - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    inner = candidates.where("n_words > 2").withColumn("w", words).select("lang", "a", F.explode(spans).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    joined = candidates.join(most, ["lang", "phrase"], "left")
    return joined.where(F.coalesce(100 * F.col("most") < covered * F.col("a"), F.lit(True))).drop("most")


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n,
    score``.

    A phrase of two to ``longest`` words counts from ``least`` occurrences on.
    ``score`` is floor(1000000 * a * a / (l * r)) at the cut where it is
    lowest.  Phrases within a longer one of at least ``covered`` per cent of
    their count are left out.

    Defined cases: a null ``lang`` is ``und``; null and empty texts have no
    words; a text of breaks alone has none; phrases do not reach across breaks
    or texts; repeated rows count each; ties go by count, then by the phrase's
    bytes; a language without phrases has no rows, nor has an empty table;
    texts of any length are read whole; other columns are ignored.
    """
    rows = only(documents, lang="lang", text="text").withColumn("lang", F.coalesce(F.col("lang").cast("string"), F.lit("und")))
    cut = written(shards(rows), SHARD_BYTES)
    tables, filters = [counted(cut, 1, [], least)], []
    for n in range(2, longest + 1):
        phrases = tables[-1].where("phrase <> ''")
        filters.append(bloom_filter(phrases.select(phrase_hash_column(n - 1).alias("h")), "h"))
        tables.append(counted(cut, n, filters, least))
    discard(cut)
    frequent = tables[0].where("phrase <> ''").withColumn("n_words", F.lit(1))
    for n, table in enumerate(tables[1:], 2):
        frequent = frequent.unionByName(table.withColumn("n_words", F.lit(n)))
    candidates = frequent.where("n_words > 1").withColumnRenamed("f", "a")
    scored = _cuts(_uncovered(candidates, covered), frequent)
    # the best of each part first, so that the task of a language has few rows
    best = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    ranked = best(best(scored, F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))).withColumn("rank", F.col("rank").cast("long"))
    totals = tables[0].where("phrase = ''").select("lang", F.col("f").alias("n"))
    found = written(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    discard(*tables)
    return found


def oracle(least: int = LEAST, top: int = TOP, covered: int = COVERED) -> str:
    """For phrases of up to three words."""
    return rf"""WITH piece AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM
 (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
gram AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM piece, (SELECT unnest([1, 2, 3]) AS m)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY 1),
cand AS MATERIALIZED (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m > 1 AND f >= {least}),
cover AS (SELECT lang, sub AS phrase, max(a) AS most FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS sub FROM cand WHERE m = 3) GROUP BY 1, 2),
cut AS (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS p1, array_to_string(w[k + 1:m], ' ') AS p2 FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scored AS (SELECT cut.lang AS lang, cut.phrase AS phrase, a, k, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score FROM cut
 JOIN f x ON x.lang = cut.lang AND x.phrase = p1 AND x.m = k JOIN f y ON y.lang = cut.lang AND y.phrase = p2 AND y.m = cut.m - k),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT best.* FROM best LEFT JOIN cover ON cover.lang = best.lang AND cover.phrase = best.phrase WHERE most IS NULL OR 100 * most < {covered} * a)
SELECT kept.lang AS lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, kept.phrase) AS rank, kept.phrase AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN total ON total.lang = kept.lang QUALIFY rank <= {top}"""
