"""Chat formatting: logged snapshots of growing conversations are collapsed to
the longest before rendering.

Each turn has a hash of its role and text; the sum of hash times place is a
rolling hash of the turns so far.  A conversation whose whole hash is that of a
proper prefix of another is dropped by an anti-join; of equal conversations the
least id stays.

Rows are dealt to parts by ranges of conversation, turn, role and text.  Running
sums are taken within the parts of a conversation; those of its earlier parts are
added, which only conversations that lie in several parts need.  So a
conversation of any length is spread over tasks, whatever its turn numbers.  A
rendered segment is one value, so it has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_unique, written

#: Rows that a part should have.
PART_ROWS = 200_000

#: What opens and closes a rendered turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n"


KEY = ["conv", "known"]
_WIDE = "decimal(38,0)"


def _digits(first: int):
    """48 bits of the md5 of role and text, as an exact decimal."""
    text = F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("="), "role"), F.lit("")), F.coalesce(F.concat(F.lit("="), "text"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), first, 12), 16, 10).cast("decimal(15,0)")


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with ``place`` (from 1) in order of turn,
    role and text (nulls first), the rolling hashes ``h1`` and ``h2``, whether
    the turn is the ``last``, and the key ``conv, known`` in place of an id that
    may be null."""
    rows = conversations.select("conv_id", "turn", "role", "text").distinct()
    order = ("turn", "role", "text")
    parts = max(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-conversations.count() // PART_ROWS))
    # written, as the ranges come from a sample
    rows = written(rows.repartitionByRange(parts, "conv_id", *order).withColumn("part", F.spark_partition_id()))
    rows = rows.select("*", F.coalesce("conv_id", F.lit(0).cast("long")).alias("conv"), F.col("conv_id").isNotNull().alias("known"), _digits(1).alias("t1"), _digits(13).alias("t2"))
    in_part = Window.partitionBy(*KEY, "part").orderBy(*order)
    upto = in_part.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.row_number().over(in_part)).withColumn("ends", F.lead(F.lit(1)).over(in_part).isNull())
    running = [(F.sum(x).over(upto)).cast(_WIDE).alias(n) for k in (1, 2) for n, x in ((f"s{k}", F.col(f"t{k}")), (f"w{k}", F.col(f"t{k}") * F.col("at")))]
    rows = written(rows.select("conv_id", "turn", "role", "text", *KEY, "part", "at", "ends", *running))
    # of conversations in several parts: what stands before each part
    several = rows.where("ends").select(*KEY, "part", "at", "s1", "w1", "s2", "w2").withColumn("final", F.max("part").over(Window.partitionBy(*KEY))).withColumn("first", F.min("part").over(Window.partitionBy(*KEY))).where("first < final")
    before = Window.partitionBy(*KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = several.withColumn("earlier", F.coalesce(F.sum("at").over(before), F.lit(0)))
    whole = [(F.col(f"w{k}") + F.col(f"s{k}") * F.col("earlier").cast("decimal(18,0)")).cast(_WIDE) for k in (1, 2)]
    placed = placed.withColumn("v1", whole[0]).withColumn("v2", whole[1])
    added = written(placed.select(*KEY, "part", "earlier", "final", *[F.coalesce(F.sum(f"v{k}").over(before).cast(_WIDE), F.lit(0).cast(_WIDE)).alias(f"e{k}") for k in (1, 2)]))
    rows = rows.join(added, [*KEY, "part"], "left")
    none = F.lit(0).cast("decimal(18,0)")
    earlier = F.coalesce(F.col("earlier").cast("decimal(18,0)"), none)
    hashes = [(F.col(f"w{k}") + F.col(f"s{k}") * earlier + F.coalesce(f"e{k}", none)).cast(_WIDE).alias(f"h{k}") for k in (1, 2)]
    last = F.col("ends") & (F.coalesce("final", "part") == F.col("part"))
    return rows.select("conv_id", "turn", "role", "text", *KEY, "part", (F.col("at") + F.coalesce("earlier", F.lit(0))).alias("place"), *hashes, last.alias("last"))


def maximal(rolled: DataFrame) -> DataFrame:
    """``conv, known, n_turns, n_copies`` (equal conversations, itself
    included) of those conversations of ``turns`` that no other extends."""
    hashed = ["place", "h1", "h2"]
    distinct = rolled.where("last").groupBy(*hashed).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = rolled.where("not last").select(*hashed).distinct()
    kept = distinct.join(prefixes, hashed, "left_anti")
    return kept.select(F.coalesce("conv_id", F.lit(0).cast("long")).alias("conv"), F.col("conv_id").isNotNull().alias("known"), F.col("place").alias("n_turns"), "n_copies")


def render(conversations: DataFrame, segment_turns: int | None = None) -> DataFrame:
    """The maximal conversations as chat text, a row each: ``conv_id, segment,
    n_turns, n_copies, first_place, rendered``.

    ``segment_turns``: a row for every so many turns of a conversation, numbered
    by ``segment`` from 0, for conversations whose text would not fit in one
    value (2 GB); in order they give the whole.

    Defined cases: repeated rows of a conversation are one turn; turns of one
    number follow each other by role and text, nulls first; a null role or
    text is rendered empty but differs from an empty one; a null ``conv_id``
    is a conversation of its own; an empty table gives no rows; other columns
    are ignored.
    """
    rolled = turns(conversations)
    kept = written(maximal(rolled))
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    segment = F.floor((F.col("place") - 1) / segment_turns) if segment_turns else F.lit(0)
    lines = rolled.select("conv_id", *KEY, "part", "place", segment.cast("int").alias("segment"), line.alias("line"))
    sizes = rolled.where("last").select(*KEY, F.col("place").alias("n"))
    joined = join_unique(lines, kept, KEY, sizes, "n", rolled.count())
    whole = ("conv_id", "segment", "n_turns", "n_copies")

    def in_order(rows, *by):
        found = rows.groupBy(*by).agg(F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
        return found.select(*by, "place", F.array_join(F.col("lines.line"), "").alias("line"))

    texts = in_order(in_order(joined, *whole, "part"), *whole)
    return texts.select(*whole, F.col("place").alias("first_place"), F.col("line").alias("rendered"))


ORACLE = """
WITH rows_ AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM rows_),
hashed AS (SELECT *, md5(CAST(place AS VARCHAR) || chr(31) || coalesce('=' || role, '') || chr(31) || coalesce('=' || text, '')) AS m FROM placed),
rolled AS (
  SELECT *, sum(('0x' || substr(m, 1, 15))::BIGINT::HUGEINT) OVER w AS h1, sum(('0x' || substr(m, 16, 15))::BIGINT::HUGEINT) OVER w AS h2,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM hashed WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
whole AS (SELECT n AS n_turns, h1, h2, min(conv_id) AS conv_id, count(*) AS n_copies FROM rolled WHERE place = n GROUP BY ALL),
kept AS (SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM rolled r WHERE r.place < r.n AND r.place = whole.n_turns AND r.h1 = whole.h1 AND r.h2 = whole.h2))
SELECT r.conv_id, 0 AS segment, k.n_turns, k.n_copies, min(r.place) AS first_place,
       string_agg('<|' || coalesce(r.role, '') || '|>' || chr(10) || coalesce(r.text, '') || chr(10), '' ORDER BY r.place) AS rendered
FROM rolled r JOIN kept k ON r.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL"""
