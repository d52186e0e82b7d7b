"""Sorted runs: flush, boundaries, level statistics, compaction.

Runs are Parquet directories sorted by key under ``root/run=<id>``; the
manifest (level, run_id, pos, min_key, max_key, records, max_seq) says which of
them count, and which batches of which sources they hold. A commit writes a new
manifest version and only then deletes input runs, so a reader or a crash sees
the old state or the new one, and a batch is in it once or not yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.config import Settings
from tidelog.plans.snapshot import newest

MANIFEST = "level int, run_id long, pos int, min_key string, max_key string, records long, tombstones long, max_seq long"
#: Rows without a level say which batch of a source came last.
_ENTRIES = MANIFEST + ", source string, batch long"


# --- runs as columns of one log -------------------------------------------------


def with_runs(log: DataFrame, capacity: int) -> DataFrame:
    """``run_id``: which memtable of ``capacity`` arrivals a record falls into."""
    return log.withColumn("run_id", F.floor(F.col("seq") / capacity).cast("long"))


def flush(log: DataFrame) -> DataFrame:
    """What each run holds when flushed: the newest version per key, tombstones included."""
    return newest(log, by=("run_id", "key"))


def boundaries(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run_id").agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("records"),
        F.count_if("tombstone").alias("tombstones"), F.max("seq").alias("max_seq"),
    )


#: Keys a range of ``positions`` has, about, and ranges at most.
RANGE, RANGES = 1 << 16, 4096


def positions(runs: DataFrame, size: str | None = None) -> DataFrame:
    """``runs`` (run_id, key, ...) with ``position``, the row's number in its run by
    key, and with ``size`` also ``offset``, the sum of that column before it.

    No task sorts a run: keys are cut into ranges at bounds drawn by hash, at
    most ``RANGES``; rows are numbered within their range of their run, on top
    of the rows (and sizes) of the ranges before, one row per range and run.
    """
    n = runs.count()
    many = min(RANGES, -(-n // RANGE))
    bounds = []
    if many > 1:
        drawn = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(max(1, n // (4 * many)))) == 0  # about 4 a range
        found = sorted((r["key"] for r in runs.select("key").filter(drawn).distinct().limit(64 * RANGES).collect()), key=str.encode)
        bounds = found[:: max(1, len(found) // many)]
    where = F.lit(0)
    if bounds:  # by bisection
        steps = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])
        where = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(F.lit(bounds), at + step - 1) <= F.col("key")), at + step).otherwise(at))
    d = runs.withColumn("range", where)
    inside = Window.partitionBy("run_id", "range").orderBy("key")
    before = Window.partitionBy("run_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("run_id", "range").agg(F.count(F.lit(1)).alias("n"), F.sum(size or F.lit(0)).alias("s"))
    base = sums.select("run_id", "range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c}") for c in "ns"])
    d = d.withColumn("position", F.row_number().over(inside) - 1)
    if size:
        d = d.withColumn("offset", F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.join(base, ["run_id", "range"]).withColumn("position", (F.col("base_n") + F.col("position")).cast("long"))
    if size:
        d = d.withColumn("offset", F.col("base_s") + F.col("offset"))
    return d.drop("range", "base_n", "base_s")


def sparse_summary(runs: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th key of each run, from the first."""
    return positions(runs.select("run_id", "key")).filter(F.col("position") % step == 0).select("run_id", "position", "key")


def offsets(runs: DataFrame) -> DataFrame:
    """Byte offset of each record in its run's data component."""
    return positions(runs.select("run_id", "key", plain_size().alias("size")), "size").select("run_id", "key", "offset")


def lower_bound(runs: DataFrame, key: str) -> DataFrame:
    """The first key of each run above ``key``."""
    return runs.filter(F.col("key") > key).groupBy("run_id").agg(F.min("key").alias("key"))


def overlapping(manifest: DataFrame, run_level: int) -> DataFrame:
    """For leveled compaction: the oldest run of a level and the runs of the next
    whose key ranges meet its own. One row is joined to a manifest."""
    oldest = manifest.filter(F.col("level") == run_level).orderBy("pos").limit(1)
    a = F.broadcast(oldest.select(F.col("run_id").alias("run"), F.col("min_key").alias("lo"), F.col("max_key").alias("hi")))
    b = manifest.filter(F.col("level") == run_level + 1)
    return b.join(a, (F.col("min_key") <= F.col("hi")) & (F.col("max_key") >= F.col("lo"))).select("run", F.col("run_id").alias("overlaps"))


def level_lists(manifest: DataFrame) -> DataFrame:
    """Run ids of each level, oldest first."""
    runs = F.array_sort(F.collect_list(F.struct("pos", "run_id")))
    return manifest.groupBy("level").agg(F.transform(runs, lambda r: r["run_id"]).alias("runs"))


def level_statistics(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("level").agg(F.count(F.lit(1)).alias("runs"), F.sum("records").alias("records"), F.sum("tombstones").alias("tombstones"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))


def totals(manifest: DataFrame) -> DataFrame:
    per = manifest.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("levels"), F.coalesce(F.sum("n"), F.lit(0)).alias("runs"), F.coalesce(F.max("n"), F.lit(0)).alias("most_in_a_level"))


def compact(runs: DataFrame, bottom: bool) -> DataFrame:
    """Newest version per key of the given runs. Only at the bottom, where nothing
    older lies below, may tombstones go."""
    merged = newest(runs.drop("run_id") if "run_id" in runs.columns else runs)
    return merged.filter(~F.col("tombstone")) if bottom else merged


# --- sizes of the record and log formats ----------------------------------------


def _length(c: str) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def plain_size() -> Column:
    return F.lit(25) + _length("key") + _length("value")


def compressed_size() -> Column:
    return F.when(F.col("tombstone"), F.lit(17).cast("long")).otherwise(F.lit(25) + _length("value"))


def fragments(size: Column, block: int, header: int = 17, crc: int = 4) -> Column:
    """Frames that a record takes in the log: one if it fits a block with its header and checksum."""
    return F.when(size + header + crc <= block, F.lit(1).cast("long")).otherwise(F.ceil(size / (block - header - crc)).cast("long"))


def size_with_checksums(payload: Column, block: int, crc: int = 4) -> Column:
    return F.ceil(payload / (block - crc)).cast("long") * block


# --- runs on disk ---------------------------------------------------------------


@dataclass
class RunStore:
    """Runs and manifest under ``root``, any path that Spark reads and writes."""

    spark: SparkSession
    root: str
    settings: Settings
    _keep: bool = field(default=False, init=False)

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(self._fs(f"{self.root}/manifest/{n}/_SUCCESS")[1]))

    def _entries(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], _ENTRIES)
        return self.spark.read.schema(_ENTRIES).parquet(f"{self.root}/manifest/v{versions[-1]}")

    def manifest(self) -> DataFrame:
        return self._entries().filter("level is not null").drop("source", "batch")

    def batches(self) -> dict[str, int]:
        """The last batch of each source that the runs hold."""
        return {r["source"]: r["batch"] for r in self._entries().filter("level is null").collect()}

    def data_lost(self) -> bool:
        """Whether a run that the manifest names is missing."""
        return any(not (x := self._fs(f"{self.root}/run={r['run_id']}/_SUCCESS"))[0].exists(x[1]) for r in self.manifest().select("run_id").collect())

    def has_data(self) -> bool:
        return bool(self._versions())

    def _commit(self, rows: list[tuple], batches: dict[str, int] | None = None) -> None:
        """A new version of the manifest; ``batches`` replaces what it says of sources."""
        batches = self.batches() if batches is None else batches
        version = (self._versions() or [-1])[-1] + 1
        entries = [(*r, None, None) for r in rows] + [(*[None] * 8, source, n) for source, n in batches.items()]
        # what a failed commit left of this version is no version
        self.spark.createDataFrame(entries, _ENTRIES).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v{version}")

    def _rows(self) -> list[tuple]:
        return [tuple(r) for r in self.manifest().orderBy("level", "pos").collect()]

    def next_run(self) -> int:
        return self.manifest().agg(F.coalesce(F.max("run_id") + 1, F.lit(0))).first()[0]

    def write_run(self, records: DataFrame, run_id: int) -> tuple:
        """Sort by key over as many files as the data needs; row-group bounds and a
        Bloom filter on the key, of the configured rate, then prune point reads
        and scans. A run without compression is written plainly."""
        path = f"{self.root}/run={run_id}"
        ordered = records.repartitionByRange("key").sortWithinPartitions("key")
        kind = "zstd" if self.settings.run.compression else "uncompressed"
        w = ordered.write.mode("overwrite").option("compression", kind).option("parquet.bloom.filter.enabled#key", "true")
        w.option("parquet.bloom.filter.fpp#key", str(self.settings.bloom.false_positive_rate)).parquet(path)
        r = boundaries(self.spark.read.schema(records.schema).parquet(path).withColumn("run_id", F.lit(run_id).cast("long"))).first()
        return (run_id, r["min_key"], r["max_key"], r["records"], r["tombstones"], r["max_seq"]) if r else (run_id, None, None, 0, 0, None)

    def read(self, *run_ids: int, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(*[f"{self.root}/run={r}" for r in run_ids])

    def log(self) -> DataFrame | None:
        """All committed runs as one log."""
        ids = [r[1] for r in self._rows()]
        return self.read(*ids) if ids else None

    def iterate(self, run_id: int) -> Iterator[Row]:
        """All records of a run by key, on the driver one range of the run at a time."""
        return self.read(run_id).orderBy("key").toLocalIterator()

    def summary(self, run_id: int) -> DataFrame:
        """Every key of a run that its sparse summary holds, by the configured step."""
        return sparse_summary(self.read(run_id).withColumn("run_id", F.lit(run_id).cast("long")), self.settings.run.sparse_step)

    def flush(self, memtable: DataFrame, batches: dict[str, int] | None = None, forget: set[str] | None = None) -> int:
        """A memtable becomes the newest run of level 0; ``batches`` (source to its
        last batch) are committed with it, sources to ``forget`` leave the manifest."""
        run = self.next_run()
        entry, rows = self.write_run(newest(memtable), run), self._rows()
        pos = max((r[2] for r in rows if r[0] == 0), default=-1) + 1
        kept = {k: n for k, n in self.batches().items() if k not in (forget or ())}
        self._commit(rows + [(0, run, pos, *entry[1:])], kept | (batches or {}))
        return run

    def compact(self, keep_tombstones: bool = False) -> None:
        """Compaction by the configured strategy, level by level while one is too full.
        ``keep_tombstones``: older versions may still arrive, so deletes stay."""
        self._keep = keep_tombstones
        if self.settings.tree.compaction in ("level", "leveled"):
            self._leveled()
        else:
            self._size_tiered()

    def _replace(self, rows: list[tuple], old: list[tuple], level: int) -> list[tuple]:
        gone = {r[1] for r in old}
        top = max(r[7] for r in old)
        # what lies below the output: runs of deeper levels, and older runs of its own
        older = [r for r in rows if r[1] not in gone and (r[0] > level or r[0] == level and r[7] < top)]
        low, high = min(r[3] for r in old), max(r[4] for r in old)
        bottom = not self._keep and not any(r[3] <= high and r[4] >= low for r in older)
        run = self.next_run()
        entry = self.write_run(compact(self.read(*sorted(gone)), bottom), run)
        kept = [r for r in rows if r[1] not in gone]
        if entry[3]:
            here = sorted([r for r in kept if r[0] == level] + [(level, run, 0, *entry[1:])], key=lambda r: r[7])
            kept = [r for r in kept if r[0] != level] + [(*r[:2], i, *r[3:]) for i, r in enumerate(here)]
        self._commit(kept)
        for r in gone:
            fs, p = self._fs(f"{self.root}/run={r}")
            fs.delete(p, True)
        return self._rows()

    def _size_tiered(self) -> None:
        rows, most, last = self._rows(), self.settings.tree.max_tables_per_level, self.settings.tree.max_levels - 1
        for level in range(self.settings.tree.max_levels):
            while len(here := sorted((r for r in rows if r[0] == level), key=lambda r: r[2])) > most:
                rows = self._replace(rows, here[:most] if most > 1 else here[:2], min(level + 1, last))

    def _leveled(self) -> None:
        rows, most = self._rows(), self.settings.tree.max_tables_per_level
        for level in range(self.settings.tree.max_levels - 1):
            while len(here := sorted((r for r in rows if r[0] == level), key=lambda r: r[2])) > most:
                a = here[0]
                meets = [r for r in rows if r[0] == level + 1 and r[3] <= a[4] and r[4] >= a[3]]
                rows = self._replace(rows, [a, *meets], level + 1)
