"""The translation cache as committed snapshots in a folder.

A commit writes the next whole cache as a data folder of its own and then publishes it: a small log file with the next number,
written under another name and renamed, which fails if that number is taken. Readers take the highest number, so they see one
whole snapshot, and a writer that fails before its rename leaves the old one. A writer that finds its number taken starts
again from the newer snapshot. The log keeps each writer's last batch: a batch that is run again changes nothing.

The cache is bounded by its entries, so rewriting it costs what the bound allows. Times come with the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.config import CACHE_DAYS, CACHE_ENTRIES
from pageflow.operators import cache

SCHEMA = "target_lang string, source string, translated string, ts timestamp"
#: Tries of a commit that others overtake.
TRIES = 20


class Overtaken(RuntimeError):
    """Another writer has published this number."""


class CacheStore:
    """Snapshots under a folder that all executors share, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str, days: int = CACHE_DAYS, entries: int = CACHE_ENTRIES):
        self.spark, self.path, self.days, self.entries = spark, path.rstrip("/"), days, entries

    # --- files
    def _files(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)

    def _numbers(self) -> list[int]:
        jvm, fs, _ = self._files()
        log = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _entry(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/log/{number:020d}.json", wholetext=True).first()[0])

    def _publish(self, number: int, entry: dict) -> None:
        """Write a log file; Overtaken if the number has one."""
        jvm, fs, context = self._files()
        at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{name}")
        own, final = at(f".{uuid.uuid4().hex}"), at(f"{number:020d}.json")
        fs.mkdirs(at("").getParent())
        out = fs.create(own, False)
        out.write(json.dumps(entry).encode())
        out.close()
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(own, final, no_options)  # fails if the number is there
        except Exception as error:  # noqa: BLE001  py4j wraps what Java throws
            fs.delete(own, False)
            if "FileAlreadyExists" in str(error):
                raise Overtaken(str(number)) from error
            raise

    # --- snapshots
    def version(self) -> int:
        """The number of the newest snapshot; 0: none."""
        return max(self._numbers(), default=0)

    def read(self, number: int | None = None) -> DataFrame:
        """The newest snapshot, or that of a number; empty if there is none."""
        number = self.version() if number is None else number
        return self.spark.read.schema(SCHEMA).parquet(self._entry(number)["data"]) if number else self.spark.createDataFrame([], SCHEMA)

    def commit(self, new: DataFrame, writer: str, batch: int, as_of: Column | None = None) -> int:
        """Upsert new rows, evict as of a time (else the newest of their own), publish. The number of the snapshot that holds the batch."""
        new = new.select("target_lang", "source", "translated", F.col("ts").cast("timestamp").alias("ts"))
        for _ in range(TRIES):
            number = self.version()
            before = self._entry(number) if number else {"writers": {}}
            if before["writers"].get(writer, -1) >= batch:
                return number
            merged = cache.upsert(self.read(number), new)
            if as_of is None:
                newest: datetime | None = merged.agg(F.max("ts")).first()[0]
                now = F.lit(newest).cast("timestamp")
            else:
                now = as_of
            data = f"{self.path}/data/{uuid.uuid4().hex}"
            cache.evict(merged, now, self.days, self.entries).write.parquet(data)
            try:
                self._publish(number + 1, {"data": data, "writers": {**before["writers"], writer: batch}})
                return number + 1
            except Overtaken:
                continue
        raise RuntimeError(f"others published first, {TRIES} times")

    def sink(self, writer: str, as_of: Column | None = None) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: rows (target_lang, source, translated, ts) of a stream of translations."""

        def write(rows: DataFrame, batch: int) -> None:
            self.commit(rows.where(F.col("translated").isNotNull()), writer, batch, as_of)

        return write

    def forget(self, keep: int = 2) -> int:
        """Delete data that none of the newest ``keep`` snapshots holds, failed writers' included; how many folders. Run it while nobody commits."""
        jvm, fs, _ = self._files()
        numbers = self._numbers()
        held = {self._entry(n)["data"].rpartition("/")[2] for n in numbers[-keep:]}
        data = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in held] if fs.exists(data) else []
        for p in gone:
            fs.delete(p, True)
        for n in numbers[:-keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{n:020d}.json"), False)
        return len(gone)
