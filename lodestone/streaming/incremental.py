"""Incremental indexing as a stream: files or rows that arrive are compared by
checksum with the stored table and merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import checksum
from ..operators.tables import latest, load_current, save_version, upsert


def merge_batch(root: str, key: str, version: str):
    """A ``foreachBatch`` function: rows whose checksum is new for their key
    replace the stored ones.  A batch that runs again changes nothing more."""

    def merge(batch: DataFrame, _batch_id: int) -> None:
        new = latest(batch, key, version)
        stored = load_current(batch.sparkSession, root)
        known = stored.select(key, "checksum")
        changed = new.join(known, [key, "checksum"], "left_anti")
        save_version(upsert(stored, changed, key), root)

    return merge


def follow(stream: DataFrame, root: str, key: str, text: str, version: str, checkpoint: str):
    """Starts the stream; ``stream`` has the stored table's columns but for
    ``checksum``, which is made from ``text``."""
    rows = stream.withColumn("checksum", checksum(F.col(text)))
    return rows.writeStream.foreachBatch(merge_batch(root, key, version)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
