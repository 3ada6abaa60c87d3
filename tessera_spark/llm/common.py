"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java regular expression and as characters.
SPACE_RE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of fixed size as a literal in the plan."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is set, a local session gets a temporary one; a cluster has to name one that all machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_live: list[str] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared scratch folder and read it back.

    Cuts lineage in a form every executor can reread after a loss, and keeps Spark from recomputing df for each consumer.
    The folder goes with discard() or release(), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, jpath = _file(spark, path)
    fs.deleteOnExit(jpath)
    _live.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _file(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def drop(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for path in (t._scratch for t in tables):
        fs, jpath = _file(tables[0].sparkSession, path)
        fs.delete(jpath, True)
        if path in _live:
            _live.remove(path)


def discard(*tables: DataFrame) -> None:
    """drop(), and let Spark drop the shuffle files behind them."""
    drop(*tables)
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()  # shuffle files go when the driver collects what refers to them


#: Tables of up to so many bytes of Parquet are broadcast; a join by shuffle takes the place beyond.
BROADCAST_BYTES = 4 << 20


def size_of(table: DataFrame) -> int:
    """Bytes of a materialized table's files."""
    fs, path = _file(table.sparkSession, table._scratch)
    return fs.getContentSummary(path).getLength()


def bounded(table: DataFrame, *columns: str) -> DataFrame | None:
    """A materialized table (or some of its columns) to broadcast, if its files have at most BROADCAST_BYTES; else None."""
    if size_of(table) > BROADCAST_BYTES:
        return None
    return F.broadcast(table.select(*columns) if columns else table)


def limit_batches(spark: SparkSession, rows: int = 500) -> None:
    """batches_of() for plans that run after the call that makes them: from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows in what is run inside `with`: texts can be long, and the Python workers share an executor's memory with its heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """The tables materialized inside `with`; release() deletes them, once what was built on them has been written."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        self._from = len(_live)
        return self

    def __exit__(self, *_: object) -> None:
        self.paths += _live[self._from :]

    def release(self, spark: SparkSession) -> None:
        for path in self.paths:
            if path in _live:
                fs, jpath = _file(spark, path)
                fs.delete(jpath, True)
                _live.remove(path)
        self.paths = []


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, in order; null and blank texts have none."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RE))


def n_words(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE_RE))).cast("long")


def java_literal(text: str) -> str:
    """text as a literal inside a Java or RE2 regular expression."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|/#&~" else c for c in text)
