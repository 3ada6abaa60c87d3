"""Shared scratch folders."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, or under a temporary one where that is not set (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """df written once and read back: lineage cut in a form that survives lost executors."""
    path = folder(df.sparkSession, "saved")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
