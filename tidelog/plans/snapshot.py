"""Last write wins: the newest version of every key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(log: DataFrame, *, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """The row of largest ``seq`` per key, tombstones included.

    One aggregate with a partial step per task, so a key with any number of
    versions reaches the shuffle once per task; a filter on ``key`` placed above
    moves below it and into the scan.
    """
    rest = [c for c in log.columns if c not in by]
    best = log.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col("seq")).alias("v"))
    return best.select(*by, *[F.col(f"v.{c}").alias(c) for c in rest])


def live(log: DataFrame) -> DataFrame:
    """The snapshot: newest versions that are no tombstones. The tombstone filter
    stays above the aggregate, or older versions would come back."""
    return newest(log).filter(~F.col("tombstone"))


def state_as_of(log: DataFrame, seq: int) -> DataFrame:
    return live(log.filter(F.col("seq") <= seq))


def layered(*layers: DataFrame) -> DataFrame:
    """Merge of layers (memtables, runs) into one snapshot; ``seq`` orders them."""
    return live(reduce(DataFrame.unionByName, layers))


def counts(log: DataFrame) -> DataFrame:
    """Distinct keys, those that are live, and all versions."""
    n = newest(log).agg(F.count(F.lit(1)).alias("total_keys"), F.count_if(~F.col("tombstone")).alias("active_keys"))
    return n.crossJoin(log.agg(F.count(F.lit(1)).alias("versions")))  # one row each


def delete_effects(log: DataFrame) -> DataFrame:
    """Every delete, and whether its key was live just before it."""
    from pyspark.sql import Window

    before = F.lag("tombstone").over(Window.partitionBy("key").orderBy("seq"))
    d = log.select("key", "seq", "tombstone", before.alias("before")).filter("tombstone")
    return d.select("key", "seq", F.coalesce(~F.col("before"), F.lit(False)).alias("existed"))
