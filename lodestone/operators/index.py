"""A stored index of postings: a versioned table in buckets by token hash.

A version is a small manifest that names, for each bucket, the folder that
holds it, and the index state.  Writing puts the touched buckets into a folder
of their own and then publishes a manifest; readers of older versions go on
undisturbed.  A search opens the buckets of its terms and no others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of replaced rows that are broadcast, at most.
BROADCAST_IDS = 1_000_000

SCHEMA = "id {id}, token_hash long, weight double"


class PostingsIndex:
    """Postings under ``root``, a folder that driver and executors share.

    One writer at a time; any number of readers.  ``id_type`` is the type of
    the rows' ids.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, id_type: str = "long"):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.schema = SCHEMA.format(id=id_type)

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _bucket(self, column: str = "token_hash"):
        return F.pmod(F.col(column), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The newest complete version; 0: none."""
        found = self._fs().globStatus(self._path("manifest-*/_SUCCESS"))
        return max((int(x.getPath().getParent().getName().split("-")[1]) for x in found), default=0)

    def state(self, version: int | None = None) -> dict:
        """``version``, ``total`` (rows indexed), ``postings`` and ``buckets``
        (the folder and number of postings of each) of a version."""
        v = self.version() if version is None else version
        if not v:
            return {"version": 0, "total": 0, "postings": 0, "buckets": {}}
        held = json.loads(self.spark.read.text(f"{self.root}/manifest-{v}", wholetext=True).first()[0])
        return held | {"buckets": {int(k): tuple(x) for k, x in held["buckets"].items()}}

    def _publish(self, version: int, total: int, buckets: dict[int, tuple[str, int]]) -> dict:
        """Writes the state and reads it back."""
        state = {"version": version, "total": total, "postings": sum(n for _, n in buckets.values()), "buckets": buckets}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.root}/manifest-{version}")
        if self.state(version) != state:
            raise RuntimeError("the index state read back is not the one that was written")
        return state

    def _store(self, posted: DataFrame, stored: bool = False) -> dict[int, tuple[str, int]]:
        """Writes postings; the folder and number of each bucket's.  Those read
        from ``stored`` buckets lie together already and are not shuffled."""
        name = f"data-{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = posted.select("id", "token_hash", "weight", self._bucket().alias("bucket"))
        if not stored:
            # a bucket is spread over some tasks, as a token of a third of all rows makes one large
            dealt = dealt.repartition(parts, "bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
        dealt.sortWithinPartitions("bucket", "token_hash").write.partitionBy("bucket").parquet(f"{self.root}/{name}")
        if not self._fs().globStatus(self._path(f"{name}/bucket=*")):
            return {}
        found = self.spark.read.parquet(f"{self.root}/{name}").groupBy("bucket").agg(F.count("*").alias("n")).collect()
        return {r.bucket: (f"{name}/bucket={r.bucket}", r.n) for r in found}

    def _read(self, buckets: dict[int, tuple[str, int]]) -> DataFrame:
        paths = [f"{self.root}/{path}" for path, _ in buckets.values()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, posted: DataFrame, total: int) -> dict:
        """A new version of these postings (id, token_hash, weight) alone."""
        return self._publish(self.version() + 1, total, self._store(posted))

    def replace(self, ids: DataFrame, posted: DataFrame, total: int) -> dict:
        """A new version in which the rows ``ids`` (id) have the postings
        ``posted`` and no others; rows without any are thus deleted.  Only
        buckets with postings of theirs, old or new, are written."""
        old, own = self.state(), ids.select("id").distinct()
        own = F.broadcast(own) if own.count() <= BROADCAST_IDS else own
        fresh = self._store(posted)
        # a bucket of new postings is written in any case; of the others, those that lose some
        rest = {b: x for b, x in old["buckets"].items() if b not in fresh}
        changed = self._read(rest).join(own, "id", "left_semi").select(self._bucket().alias("b")).distinct().collect() if rest else []
        touched = {r.b for r in changed} | set(fresh)
        kept = self._read({b: x for b, x in old["buckets"].items() if b in touched}).join(own, "id", "left_anti")
        new = self._store(kept.unionByName(self._read(fresh)), stored=True)
        for path in {path.split("/")[0] for path, _ in fresh.values()}:
            self._fs().delete(self._path(path), True)
        return self._publish(old["version"] + 1, total, {b: x for b, x in old["buckets"].items() if b not in touched} | new)

    def lookup(self, terms: DataFrame) -> DataFrame:
        """The postings in the buckets of the ``terms`` (token_hash)."""
        wanted = {r.b for r in terms.select(self._bucket().alias("b")).distinct().collect()}
        return self._read({b: x for b, x in self.state()["buckets"].items() if b in wanted})

    def vacuum(self) -> int:
        """Deletes what the newest version does not need; the number of folders."""
        state, fs = self.state(), self._fs()
        used = {path for path, _ in state["buckets"].values()}
        gone = [x.getPath() for x in fs.globStatus(self._path("manifest-*")) if int(x.getPath().getName().split("-")[1]) < state["version"]]
        gone += [x.getPath() for x in fs.globStatus(self._path("data-*/bucket=*")) if f"{x.getPath().getParent().getName()}/{x.getPath().getName()}" not in used]
        for path in gone:
            fs.delete(path, True)
        return len(gone)
