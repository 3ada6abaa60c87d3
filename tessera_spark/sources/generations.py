"""Generations of tables: staged, then published by one rename of a pointer."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


#: Conditions of Spark's errors that say that a file is not what it should be.
BROKEN = ("FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "UNABLE_TO_INFER_SCHEMA", "CANNOT_MERGE_SCHEMAS")


def conditions(e: PySparkException | Py4JJavaError) -> list[str]:
    """The error conditions that Spark gives for an exception and its causes."""
    out = [e.getCondition() or ""] if isinstance(e, PySparkException) else []
    cause = getattr(e, "java_exception", None)
    while cause is not None:
        try:
            out.append(cause.getCondition() or "")
        except (Py4JError, TypeError):  # not one of Spark's
            pass
        cause = cause.getCause()
    return [c for c in out if c]


@dataclass
class Loaded:
    """A table, or why there is none: ok, missing, malformed or unreadable."""

    status: str
    table: DataFrame | None = None
    detail: str = ""


@dataclass
class Marker:
    """A marker's value, or why there is none: ok, missing, malformed, incompatible-version, unreadable or unknown."""

    status: str
    value: dict | None = None
    reason: str = ""


class GenerationStore:
    """Any file system that Spark writes; readers see either the old generation or the new one, never a mix."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        path = self._Path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        rows = self.spark.read.text(str(path.toString()), wholetext=True).collect()
        return json.loads(rows[0][0]) if rows else None

    def _write(self, name: str, value: dict) -> None:
        """Write beside the target, then rename over it."""
        part, path = self._Path(f"{self.root}/.{name.replace('/', '_')}.{uuid.uuid4().hex}"), self._Path(f"{self.root}/{name}")
        self._fs.mkdirs(path.getParent())
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(part, path, options)

    def stage(self, tables: dict[str, DataFrame], now: float | None = None) -> str:
        """Write tables as a new generation and return its id; nothing points at it yet."""
        gid = uuid.uuid4().hex
        self._fs.mkdirs(self._Path(f"{self.root}/generation_id={gid}"))
        self._set(gid, "staged", now=now, tables=sorted(tables))
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/generation_id={gid}/{name}")
        return gid

    def _set(self, gid: str, state: str, now: float | None = None, **more) -> None:
        old = self._read(f"generation_id={gid}/state.json") or {}
        self._write(f"generation_id={gid}/state.json", old | more | {"id": gid, "state": state, "at": now or time.time()})

    def publish(self, gid: str) -> None:
        state = self._read(f"generation_id={gid}/state.json")
        if not state or state["state"] == "abandoned":
            raise ValueError(f"generation {gid} cannot be published")
        self._set(gid, "committed")
        self._write("current.json", {"id": gid})

    def abandon(self, gid: str) -> None:
        self._set(gid, "abandoned")

    def current(self) -> str | None:
        pointer = self._read("current.json")
        return pointer and pointer["id"]

    def load(self, name: str, gid: str | None = None, columns: dict[str, str] | None = None) -> Loaded:
        """A table of a generation, by default the current one. All footers are read, so a broken file shows here; with columns
        (name -> type) a table that lacks one, or has it in another type, is malformed."""
        gid = gid or self.current()
        if gid is None:
            return Loaded("missing", detail="no generation is published")
        path = f"{self.root}/generation_id={gid}/{name}"
        if not self._fs.exists(self._Path(path)):
            return Loaded("missing", detail=path)
        try:
            table = self.spark.read.option("mergeSchema", True).parquet(path)
        except (PySparkException, Py4JJavaError) as e:
            found = conditions(e)
            broken = any(c.startswith(BROKEN) for c in found)
            return Loaded("malformed" if broken else "unreadable", detail=" ".join(found) or str(e)[:300])
        has = {f.name: f.dataType.simpleString() for f in table.schema}
        wrong = [f"{c} {t}" for c, t in (columns or {}).items() if has.get(c) != t]
        return Loaded("malformed", detail="no " + ", ".join(wrong)) if wrong else Loaded("ok", table)

    # -- coordination markers and failures
    def save_marker(self, name: str, value: dict, version: int = 1) -> None:
        self._write(f"coordination/{name}.json", value | {"schemaVersion": version})

    def load_marker(self, name: str, fields: dict[str, type], version: int = 1) -> Marker:
        """A marker whose value has the fields, each of its type (None where a field may be absent or null)."""
        path = self._Path(f"{self.root}/coordination/{name}.json")
        try:
            if not self._fs.exists(path):
                return Marker("missing", reason="the marker does not exist")
            if self._fs.getFileStatus(path).isDirectory():
                return Marker("unreadable", reason="the marker is a directory")
            value = self._read(f"coordination/{name}.json")
        except json.JSONDecodeError as e:
            return Marker("malformed", reason=str(e))
        except Exception as e:  # what the file system raises depends on its kind
            return Marker("unreadable" if "Permission" in str(e) else "unknown", reason=str(e)[:300])
        if not isinstance(value, dict) or not isinstance(value.get("schemaVersion"), int) or any(t is not None and not isinstance(value.get(f), t) for f, t in fields.items()):
            return Marker("malformed", reason="the marker lacks a field")
        if value["schemaVersion"] != version:
            return Marker("incompatible-version", reason=f"version {value['schemaVersion']}, expected {version}")
        return Marker("ok", value)

    def record_failure(self, reason: str, gid: str | None = None, now: float | None = None) -> None:
        """The last failure of a refresh; one that stands already goes to the archive."""
        self.clear_failure()
        self._write("failure.json", {"reason": reason, "generation": gid, "at": now or time.time()})

    def failure(self) -> dict | None:
        return self._read("failure.json")

    def clear_failure(self) -> None:
        if last := self.failure():
            self._write(f"failures/{int(last['at'] * 1000)}-{uuid.uuid4().hex[:8]}.json", last)
            self._fs.delete(self._Path(f"{self.root}/failure.json"), False)

    def failures(self) -> list[dict]:
        """Archived failures, oldest first."""
        found = self._fs.globStatus(self._Path(f"{self.root}/failures/*.json"))
        return sorted((self._read(f"failures/{x.getPath().getName()}") for x in found or []), key=lambda f: f["at"])

    def states(self) -> list[dict]:
        found = self._fs.globStatus(self._Path(f"{self.root}/generation_id=*"))
        return [s for x in found or [] if (s := self._read(f"{x.getPath().getName()}/state.json"))]

    def clean(self, now: float | None = None, after: float = 900.0) -> list[str]:
        """Abandon generations staged longer ago than `after` seconds, and delete abandoned ones that are not current."""
        now, current, gone = now or time.time(), self.current(), []
        for s in self.states():
            if s["state"] == "staged" and now - s["at"] > after:
                self._set(s["id"], "abandoned", now=now)
                s["state"] = "abandoned"
            if s["state"] == "abandoned" and s["id"] != current:
                self._fs.delete(self._Path(f"{self.root}/generation_id={s['id']}"), True)
                gone.append(s["id"])
        return gone
