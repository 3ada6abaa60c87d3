"""Queries whose plan is a stream run to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import scratch
from ..streaming import refresh
from . import corpus as C
from .registry import query


@query()
def coalesced_refresh_stream(spark, d):
    """The streaming twin of coalesced_refresh: sessions closed by the watermark, the last ones of a scope excepted."""
    schema = C.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch.folder(spark, "stream")
    bursts = refresh.coalesced(events, "user_id", "ts")
    q = bursts.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(bursts.schema).parquet(f"{out}/rows")
