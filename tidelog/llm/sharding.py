"""Sharding by extendible hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import columns, store

STEP = 12  # directory bits opened at a time: at most 4096 cells per open bucket
ROUNDS = 5  # 60 of the 64 hash bits


def shard(docs: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """Deal documents to shards of at most ``limit`` bytes of text.

    The directory is indexed by the leading bits of a 64-bit hash of id and
    text. A bucket over the limit that holds more than one row splits on its
    next bit; all others stay as they are. Sizes are summed per cell of
    ``STEP`` further bits, only below buckets that are still too large, so the
    directory work follows the number of shards, not of documents. Rows whose
    hash agrees in all bits used (identical rows) can't be split by hash: they
    overflow into numbered pages of the same bucket, dealt by a salt, the number
    of the task that reads them.

    Returns doc_id, bytes, shard (the prefix as bits, with ``+page`` for
    overflow pages), depth, one row per row. Null or empty text has 0 bytes.
    A single document over the limit is a shard of its own. Null and repeated
    ids are ordinary keys; an empty table gives no rows; extra columns are
    ignored, whatever their names.
    """
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    h = F.conv(F.substring(F.md5(key), 1, 16), 16, -10).cast("long")
    d = store(columns(docs, "doc_id", "text").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), h.alias("h"), F.shiftright(F.monotonically_increasing_id(), 33).alias("salt")), "hashed")
    out = d.withColumn("depth", F.lit(None).cast("int"))
    everything = d.agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if (everything["b"] or 0) <= limit or everything["n"] <= 1:
        out = d.withColumn("depth", F.lit(0))
        return out.select("doc_id", "bytes", F.lit("").alias("shard"), "depth")
    opened, bits = None, 0
    for _ in range(ROUNDS):
        low, bits = bits, bits + STEP
        part = d.withColumn("cell", F.shiftrightunsigned("h", 64 - bits))
        if opened is not None:
            part = part.withColumn("up", F.shiftrightunsigned("h", 64 - low)).join(opened, "up", "left_semi")
        cells = store(part.groupBy("cell").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")), "cells")
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(low + 1), F.lit(bits))))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
        fits = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).filter((F.col("b") <= limit) | (F.col("n") <= 1))
        leaf = levels.select("cell", "depth", "prefix").join(fits.select("depth", "prefix"), ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("d"))
        leaf = store(cells.select("cell").join(leaf, "cell", "left"), "directory")
        here = leaf.select(F.col("cell").alias(f"c{bits}"), F.col("d").alias(f"d{bits}"))
        out = out.withColumn("cell", F.shiftrightunsigned("h", 64 - bits)).join(here, F.col("cell") == F.col(f"c{bits}"), "left")
        out = out.withColumn("depth", F.coalesce("depth", f"d{bits}")).drop("cell", f"c{bits}", f"d{bits}")
        opened = leaf.filter("d is null").select(F.col("cell").alias("up"))
        if opened.isEmpty():
            break
    else:
        out = store(out, "overflow")
        page = Window.partitionBy("h", "salt").orderBy("bytes")
        each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))))
        over = out.filter("depth is null").withColumn("page", F.concat_ws(".", "salt", F.floor((F.row_number().over(page) - 1) / each)))
        out = out.filter("depth is not null").withColumn("page", F.lit(None).cast("string")).unionByName(over)
        out = out.withColumn("depth", F.coalesce("depth", F.lit(bits)))
    prefix = F.expr("substring(lpad(bin(h), 64, '0'), 1, depth)")
    if "page" in out.columns:
        prefix = F.concat(prefix, F.coalesce(F.concat(F.lit("+"), "page"), F.lit("")))
    return out.select("doc_id", "bytes", prefix.alias("shard"), "depth")
