"""Incremental refresh as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coalesced(events: DataFrame, scope: str, ts: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(scope, first, last, n_requests, n_runs): bursts of requests of a scope, apart by less than gap.

    A burst costs one run and at most one follow-up. State is a session a scope; the watermark closes and drops it.
    """
    w = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(scope)).agg(F.count("*").alias("n_requests"))
    return w.select(F.col(scope), F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n_requests", F.when(F.col("n_requests") > 1, 2).otherwise(1).alias("n_runs"))


def upserts(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each key in a batch."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def publish_batches(changes: DataFrame, store, table: str, key: str, order: str, checkpoint: str, deleted: str | None = None):
    """A streaming query that merges each micro-batch into the current generation and publishes the result.

    The later of two rows of a key by `order` stays, so batches out of order and a batch that is replayed after a failure give the
    same table. Where the boolean column `deleted` is true, the key goes; its row is kept as a mark for later batches and
    live() leaves it out.
    """

    def merge(batch: DataFrame, _: int) -> None:
        fresh = upserts(batch, key, order)
        now = store.load(table)
        merged = fresh if now.table is None else upserts(now.table.unionByName(fresh), key, order).select(*now.table.columns)
        store.publish(store.stage({table: merged}))

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(table: DataFrame, deleted: str) -> DataFrame:
    """The rows of a published table whose key has not been deleted."""
    return table.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def lock_is_stale(beat: float, now: float, alive: bool, timeout: float = 30.0) -> bool:
    """Whether a refresh lock can be taken over: its holder is gone or has not beaten for the timeout."""
    return not alive or now - beat > timeout
