"""Ingest as streams: log to runs, latest values, sketches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators import sketches
from tidelog.operators.lsm import RunStore


def to_runs(log: DataFrame, store: RunStore, checkpoint: str, compact: bool = True) -> StreamingQuery:
    """Every micro-batch is a memtable: its newest versions become a run of level 0.

    The manifest version that adds the run also says which batch of this query it
    was, so a batch that is replayed after a failure is skipped and every other
    is kept, in whatever order of ``seq`` the files come. As older versions of
    a key may still come, compaction keeps deletes.
    """
    spark = log.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        query = "stream/" + json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        if number <= store.batches().get(query, -1):
            return
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                store.flush(batch, {query: number})
                if compact:
                    store.compact(keep_tombstones=True)
        finally:
            batch.unpersist()

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(log: DataFrame) -> DataFrame:
    """Newest version per key as a streaming aggregate (update or complete mode)."""
    return log.groupBy("key").agg(F.max_by(F.struct("value", "tombstone", "timestamp", "seq"), "seq").alias("v")).select("key", "v.*")


def sketch_cells(log: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """Count-Min cells as a streaming aggregate: micro-batches merge by sum."""
    return sketches._cells(log.withColumn("n", F.lit(1)), column, m, k).groupBy("row", "col").agg(F.sum("n").alias("cnt"))


def sketch_registers(log: DataFrame, column: str, p: int) -> DataFrame:
    """HyperLogLog registers as a streaming aggregate: micro-batches merge by maximum."""
    return sketches.hll_registers(log, column, p)


def sketch_bits(log: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """Bloom filter bits as a streaming aggregate: micro-batches merge by union. ``n``
    says how often a bit was set."""
    raw = log.select(F.col(column).cast("string").cast("binary").alias("raw"))
    return sketches._bits(raw, m, k).groupBy("bit").agg(F.count(F.lit(1)).alias("n"))
