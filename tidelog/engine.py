"""The key-value store as one object: writes go to a log, reads see log and runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidelog.config import Settings
from tidelog.functions.lru import Lru
from tidelog.model import RECORD
from tidelog.operators import integrity, lsm, scans, sketches
from tidelog.plans.snapshot import live
from tidelog.sources import files
from tidelog.sources import log as source
from tidelog.streaming.buckets import step

_LOG = "log/"


def _name(file: str) -> str:
    """What the manifest calls a file of the log."""
    return _LOG + file.rsplit("/", 1)[1]


class RateLimited(Exception):
    """The engine's bucket had no token."""


class Engine:
    """Put, get, delete, scan, iterate, flush, compact and check under ``root``.

    Single writes are for parity with an embedded store; bulk writes are
    ``put_all`` or a stream (``tidelog.streaming.ingest``). Writes are files of
    the log; when as many records wait as the memtables hold they are flushed
    to a run, and levels that are too full are compacted. A flush commits the
    names of the files it took with the manifest, so what waits is the files
    that no manifest names: no write is lost or taken twice, whoever wrote it.
    The snapshot that reads use is cached until the next write. ``limited``:
    every put and delete takes a token from the bucket first.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, limited: bool = False):
        self.spark, self.root, self.settings, self.limited = spark, root, (settings or Settings()).validated(), limited
        self.runs = lsm.RunStore(spark, f"{root}/runs", self.settings)
        self.sketches = sketches.Registry(spark, f"{root}/sketches")
        self.keys = scans.KeyDictionary(spark, f"{root}/keys")
        self._snapshot: DataFrame | None = None
        self.cache = Lru(self.settings.cache.capacity)
        self._seen: set[str] = set()
        self._refresh()

    def _waiting(self) -> list[str]:
        """Files of the log that no run holds yet."""
        held = self.runs.batches()
        return [f for f in source.segments(self.spark, f"{self.root}/log") if _name(f) not in held]

    def _tail(self) -> DataFrame:
        waiting = self._waiting()
        return self.spark.read.schema(RECORD).parquet(*waiting) if waiting else self.spark.createDataFrame([], RECORD)

    def _state(self) -> set[str]:
        """What reads rest on: files that wait, and the version of the manifest."""
        return {*self._waiting(), *map(str, self.runs._versions()[-1:])}

    def _refresh(self) -> None:
        """Numbers go on after the last write, and reads see it, this engine's or another's."""
        now = self._state()
        if not hasattr(self, "_seq") or now != self._seen:
            r = self._tail().agg(F.max("seq").alias("top"), F.count(F.lit(1)).alias("n")).first()
            flushed = self.runs.manifest().agg(F.max("max_seq")).first()[0]
            self._seq, self._rows = max(-1 if x is None else x for x in (r["top"], flushed)) + 1, r["n"]
            self._forget()
        self._seen = now

    def log(self) -> DataFrame:
        """All versions: committed runs, and what has not been flushed yet."""
        rest, runs = self._tail(), self.runs.log()
        return rest if runs is None else rest.unionByName(runs.select(*rest.columns))

    def _forget(self) -> None:
        if self._snapshot is not None:
            self._snapshot.unpersist()
        self._snapshot = None
        self.cache.clear()

    def snapshot(self) -> DataFrame:
        self._refresh()
        if self._snapshot is None:
            self._snapshot = live(self.log()).persist()
        return self._snapshot

    def items(self) -> Iterator[Row]:
        """All live records by key, on the driver one range at a time."""
        return self.snapshot().orderBy("key").toLocalIterator()

    def put_all(self, records: DataFrame) -> None:
        """(key, value[, tombstone]) rows; ``seq`` follows the order of arrival column ``seq`` where given."""
        self._refresh()
        now, base = time.time_ns(), self._seq
        if "seq" not in records.columns:
            records = records.withColumn("seq", F.monotonically_increasing_id())
        records = records.withColumn("seq", F.col("seq") + base).persist()
        gone = F.col("tombstone") if "tombstone" in records.columns else F.lit(False)
        source.append(records.select("key", F.col("value").cast("binary").alias("value"), gone.alias("tombstone"), F.lit(now).alias("timestamp"), "seq"), f"{self.root}/log")
        r = records.agg(F.max("seq").alias("top"), F.count(F.lit(1)).alias("n")).first()
        self._seq, self._rows = (base if r["top"] is None else r["top"] + 1), self._rows + r["n"]
        records.unpersist()
        self._seen = self._state()
        self._forget()
        if self._rows >= self.settings.memtable.capacity * self.settings.tree.max_memtables:
            self.flush()
            self.compact()

    def _one(self, key: str, value: bytes | None) -> None:
        if self.limited and not self.allow():
            raise RateLimited(f"no token for {key}")
        row = (key, None if value is None else bytearray(value), value is None, 0)
        self.put_all(self.spark.createDataFrame([row], "key string, value binary, tombstone boolean, seq long").coalesce(1))

    def put(self, key: str, value: bytes) -> None:
        if not key:
            raise ValueError("a record needs a key")
        self._one(key, value)

    def delete(self, key: str) -> bool:
        """Whether the key existed just before."""
        existed = self.get(key) is not None
        self._one(key, None)
        return existed

    def get(self, key: str) -> dict | None:
        self._refresh()
        if (known := self.cache.get(key)) is None and (r := self.snapshot().filter(F.col("key") == key).first()):
            known = {"key": r["key"], "value": bytes(r["value"] or b""), "timestamp": r["timestamp"], "deleted": False}
            self.cache.put(key, known)
        return known

    def prefix_scan(self, prefix: str, size: int = scans.PAGE_SIZE, page: int = scans.PAGE) -> list[str]:
        return [r["key"] for r in scans._page(self.snapshot().filter(scans.with_prefix(prefix)), size, page, True).collect()]

    def range_scan(self, start: str, end: str, size: int = scans.PAGE_SIZE, page: int = scans.PAGE) -> list[str]:
        return [r["key"] for r in scans._page(self.snapshot().filter(F.col("key").between(start, end)), size, page, True).collect()]

    def prefix_iterate(self, prefix: str, cursor: str = "") -> dict | None:
        r = self.snapshot().filter(scans.with_prefix(prefix) & (F.col("key") > cursor)).orderBy("key").first()
        return r.asDict() if r else None

    def range_iterate(self, start: str, end: str, cursor: str = "") -> dict | None:
        r = self.snapshot().filter(F.col("key").between(start, end) & (F.col("key") > cursor)).orderBy("key").first()
        return r.asDict() if r else None

    def flush(self) -> int | None:
        """What waits in the log becomes a run, in one job over all of it; its files go."""
        waiting = self._waiting()
        if not waiting:
            return None
        there = {_name(f) for f in source.segments(self.spark, f"{self.root}/log")}
        rest = self.spark.read.schema(RECORD).parquet(*waiting)
        run = self.runs.flush(rest, dict.fromkeys(map(_name, waiting), 0), {k for k in self.runs.batches() if k.startswith(_LOG) and k not in there})
        source.drop(self.spark, waiting)
        self._rows, self._seen = 0, self._state()
        self._forget()
        return run

    def compact(self) -> None:
        self.runs.compact()
        self._seen = self._state()
        self._forget()

    def levels(self) -> list[list[int]]:
        found = {r["level"]: list(r["runs"]) for r in lsm.level_lists(self.runs.manifest()).collect()}
        return [found.get(i, []) for i in range(self.settings.tree.max_levels)]

    def statistics(self) -> dict:
        levels = self.levels()
        return {"levels": sum(1 for x in levels if x), "runs": sum(map(len, levels)), "max_runs_per_level": self.settings.tree.max_tables_per_level, "details": [{"level": i, "runs": x} for i, x in enumerate(levels)]}

    def leaves(self, run: int) -> DataFrame:
        return integrity.leaves(self.runs.read(run).withColumn("run_id", F.lit(run).cast("long")))

    def seal(self, run: int) -> None:
        """Keep a run's leaf hashes beside it, for ``check``."""
        self.leaves(run).select("run_id", "pos", "hash").write.mode("overwrite").parquet(f"{self.root}/seals/run={run}")

    def check(self, run: int) -> dict:
        stored = self.spark.read.schema("run_id long, pos long, hash string").parquet(f"{self.root}/seals/run={run}")
        try:
            bad = integrity.differing(stored, self.leaves(run).select("run_id", "pos", "hash"))
            where = integrity.locate(bad, self.runs.read(run).withColumn("run_id", F.lit(run).cast("long")), self.settings.block.size)
            where = where.select("location.*").distinct()  # blocks, however many of their records are damaged
            blocks = sorted((r["file_path"], r["block_index"]) for r in where.collect())
            return {"passed": bad.isEmpty(), "corrupt_blocks": blocks, "fatal": False}
        except Exception as e:  # a run that can't be read at all
            return {"passed": False, "corrupt_blocks": [], "fatal": True, "error": str(e)[:200]}

    def is_data_lost(self) -> bool:
        return self.runs.data_lost()

    def has_data(self) -> bool:
        return self.runs.has_data() or bool(self._waiting())

    def _bucket(self) -> tuple[int, int]:
        kept = files.read_json(self.spark, f"{self.root}/bucket.json")
        return tuple(kept) if kept else (int(time.time()), self.settings.bucket.tokens)

    def allow(self) -> bool:
        """Take a token from the engine's bucket, whose state is kept under ``root``."""
        last, tokens, ok = step(*self._bucket(), int(time.time()), self.settings.bucket)
        files.write_json(self.spark, f"{self.root}/bucket.json", [last, tokens])
        return ok

    def execute(self, operation: Callable, *args, **named):
        """The result of ``operation``, if there is a token for it; else ``RateLimited``."""
        if not self.allow():
            raise RateLimited(getattr(operation, "__name__", "operation"))
        return operation(*args, **named)

    def bucket_status(self) -> dict:
        last, tokens = self._bucket()
        return {"last_reset": last, "tokens": tokens}

    def reset_bucket(self) -> None:
        files.write_json(self.spark, f"{self.root}/bucket.json", [int(time.time()), self.settings.bucket.tokens])
