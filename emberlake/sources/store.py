"""A store of Parquet tables: numbered snapshots, so readers never see half a change.

A change writes new folders, then a snapshot file under the next number; the largest number
is what readers see. Nothing is deleted or replaced in between, so a crash at any point
leaves the last whole snapshot, and two writers cannot both take a number. Folders that a
snapshot no longer names are deleted after a time of grace, in which readers may finish.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake import model

KEYS = {"spans": "span_id"}
UNITS = {"": 1, "B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "KIB": 1 << 10, "MIB": 1 << 20, "GIB": 1 << 30, "TIB": 1 << 40}
DEFAULT_DISK, DEFAULT_MEMORY = 2 * 10**9, 512 * 10**6
TIMES = {"logs": "timestamp", "datapoints": "timestamp"}  # a time that is part of the row's id: known keys are looked for in its range only
MOST_FOLDERS = 64  # of a table, before they are written together
GRACE_SECONDS = 600
KEPT_SNAPSHOTS = 16


class ConflictError(RuntimeError):
    """Another writer changed the store in the meantime."""


class VersionError(RuntimeError):
    """The store was written by another version, or is not a store."""


def byte_size(text: str | None, default: int = DEFAULT_DISK) -> int:
    """``512MB``, ``2GB``; empty means the default, 0 means no limit."""
    if text is None or not text.strip():
        return default
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].upper() not in UNITS:
        raise ValueError(f"not a byte size: {text!r}")
    return int(float(m[1]) * UNITS[m[2].upper()])


class Store:
    """Tables under a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        meta = self._read_text("_meta.json")
        if meta is None:
            if self._exists("") and self._fs.listStatus(self._p("")):
                raise VersionError(f"{path} holds something else")
            self._fs.mkdirs(self._p(""))
            self._write_text("_meta.json", json.dumps({"version": model.VERSION}))
        elif json.loads(meta).get("version") != model.VERSION:
            raise VersionError(f"{path} has version {json.loads(meta).get('version')}, this is {model.VERSION}")

    # files

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._p(name))

    def _read_text(self, name: str) -> str | None:
        if not self._exists(name):
            return None
        stream = self._fs.open(self._p(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, name: str, text: str) -> None:
        """Written aside, then renamed to a name that must be new: readers see all of it or nothing."""
        tmp = f"_tmp.{uuid.uuid4().hex}"
        out = self._fs.create(self._p(tmp), True)
        out.write(bytearray(text.encode()))
        out.close()
        if self._exists(name) or not self._fs.rename(self._p(tmp), self._p(name)):
            self._fs.delete(self._p(tmp), False)
            raise ConflictError(f"{name} is taken")

    def _numbers(self) -> list[int]:
        names = (f.getPath().getName() for f in self._fs.listStatus(self._p("")))
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"_snapshot-(\d+)\.json", n)))

    def _latest(self) -> tuple[int, dict]:
        numbers = self._numbers()
        if not numbers:
            return 0, {"tables": {}, "dropped": []}
        return numbers[-1], json.loads(self._read_text(f"_snapshot-{numbers[-1]:012d}.json"))

    def snapshot(self) -> dict[str, list[str]]:
        """Folders of each table in the current version."""
        return self._latest()[1]["tables"]

    def _commit(self, number: int, tables: dict[str, list[str]], dropped: list) -> None:
        """Make a snapshot the one after ``number``; then tidy up what is past its grace."""
        now = time.time()
        old = [f for f, at in dropped if at < now - GRACE_SECONDS]
        self._write_text(f"_snapshot-{number + 1:012d}.json", json.dumps({"tables": tables, "dropped": [[f, at] for f, at in dropped if f not in old]}))
        for folder in old:
            self._fs.delete(self._p(folder), True)
        for n in self._numbers()[:-KEPT_SNAPSHOTS]:
            self._fs.delete(self._p(f"_snapshot-{n:012d}.json"), False)

    # tables

    def table(self, name: str) -> DataFrame:
        folders = self.snapshot().get(name, [])
        schema = model.schema(name)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in model.DDL}

    def _conform(self, name: str, df: DataFrame) -> DataFrame:
        schema = model.schema(name)
        return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))

    def _numbered(self, name: str, df: DataFrame) -> DataFrame:
        """Short keys that are never used again: numbered on from the largest. New dimension rows are few."""
        top = self.table(name).agg(F.max("seq")).first()[0] or 0
        from pyspark.sql import Window

        return df.withColumn("seq", F.row_number().over(Window.orderBy("id")) + F.lit(top))

    def _known(self, name: str, key: str, batch: DataFrame) -> DataFrame:
        """Keys of a table that a batch may hold: where ids contain a time, only those of the batch's range are read."""
        table = self.table(name)
        if name in TIMES:
            t = TIMES[name]
            low, high = batch.agg(F.min(t), F.max(t)).first()
            table = table.filter(F.col(t).between(low, high) | F.col(t).isNull())
        return table.select(key)

    def append(self, batch: dict[str, DataFrame]) -> None:
        """Add rows whose keys are new (first write wins); all tables change at once."""
        number, was = self._latest()
        now, dropped = was["tables"], was["dropped"]
        for name, df in batch.items():
            key = KEYS.get(name, "id")
            new = df.dropDuplicates([key])
            if now.get(name):
                new = new.join(self._known(name, key, new), key, "left_anti")
            if name in ("resources", "scopes"):
                new = self._numbered(name, new)
            folder = f"{name}/{uuid.uuid4().hex}"
            self._conform(name, new).write.parquet(f"{self.path}/{folder}")
            now.setdefault(name, []).append(folder)
            if len(now[name]) > MOST_FOLDERS:
                now[name], gone = [self._together(name, now[name])], now[name]
                dropped += [[f, time.time()] for f in gone]
        self._commit(number, now, dropped)

    def _together(self, name: str, folders: list[str]) -> str:
        """Small files of many batches as one folder of ordinary ones."""
        folder = f"{name}/{uuid.uuid4().hex}"
        size = sum(self._fs.getContentSummary(self._p(f)).getLength() for f in folders)
        df = self.spark.read.schema(model.schema(name)).parquet(*(f"{self.path}/{f}" for f in folders))
        df.coalesce(max(1, size // (128 << 20))).write.parquet(f"{self.path}/{folder}")
        return folder

    def replace(self, tables: dict[str, DataFrame]) -> None:
        """Write new contents of some tables and switch to them; old files go after their grace."""
        number, was = self._latest()
        now, dropped = was["tables"], was["dropped"]
        for name, df in tables.items():
            folder = f"{name}/{uuid.uuid4().hex}"
            self._conform(name, df).write.parquet(f"{self.path}/{folder}")
            dropped += [[f, time.time()] for f in now.get(name, [])]
            now[name] = [folder]
        self._commit(number, now, dropped)

    def size_bytes(self) -> int:
        """Bytes of the current version's files."""
        return sum(self._fs.getContentSummary(self._p(f)).getLength() for fs in self.snapshot().values() for f in fs)

    def retain(self, cap: int, rounds: int = 3) -> None:
        """Sweep, then prune the oldest tenth up to ``rounds`` times while the files exceed the cap."""
        from emberlake.operators import retention

        if not cap or self.size_bytes() <= cap:
            return
        self.replace(retention.sweep(self.tables()))
        for _ in range(rounds):
            if self.size_bytes() <= cap:
                return
            self.replace(retention.sweep(retention.prune_round(self.tables())))
