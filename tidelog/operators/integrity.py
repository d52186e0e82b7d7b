"""Checksums and Merkle trees over records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.operators import lsm

_ZERO = "0" * 32


def checksums(records: DataFrame) -> DataFrame:
    """CRC32 of each record."""
    return records.select("key", "seq", F.crc32(codec.plain()).alias("crc"))


def leaves(runs: DataFrame) -> DataFrame:
    """(run_id, pos, hash): the MD5 of each record of a run in key order."""
    hashed = runs.select("run_id", "key", F.md5(codec.plain()).alias("hash"))
    return lsm.positions(hashed).select("run_id", "key", F.col("position").alias("pos"), "hash")


def leaves_of(values: DataFrame, pos: str, value: str) -> DataFrame:
    return values.select(F.lit(0).cast("long").alias("run_id"), F.col(pos).cast("long").alias("pos"), F.md5(F.col(value).cast("binary")).alias("hash"))


def levels(leaf: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to the roots, all runs in one pass: as many pair
    reductions as the largest run needs. A run that is down to its root is
    carried up unchanged."""
    n = leaf.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    most = n.agg(F.max("n")).first()[0] or 0
    out, level, height = [leaf.select("run_id", "pos", "hash")], leaf.join(n, "run_id").select("run_id", "pos", "hash", "n"), 0
    while (1 << height) < most:
        height += 1
        l, r = (F.max(F.when(F.col("pos") % 2 == i, F.col("hash"))) for i in (0, 1))
        up = level.groupBy("run_id", "n", F.floor(F.col("pos") / 2).cast("long").alias("pos")).agg(l.alias("l"), r.alias("r"))
        pair = F.md5(F.concat(F.unhex("l"), F.unhex(F.coalesce("r", F.lit(_ZERO)))))
        level = up.select("run_id", "pos", F.when(F.col("n") <= 1 << (height - 1), F.col("l")).otherwise(pair).alias("hash"), "n")
        out.append(level.select("run_id", "pos", "hash"))
    return out


def roots(leaf: DataFrame) -> DataFrame:
    """(run_id, root). A run without records has none here; by definition md5 of nothing."""
    return levels(leaf)[-1].select("run_id", F.col("hash").alias("root"))


def tree(leaf: DataFrame) -> DataFrame:
    """(height, run_id, pos, hash) breadth first when ordered by height descending."""
    out = None
    for height, level in enumerate(levels(leaf)):
        now = level.select(F.lit(height).alias("height"), "run_id", "pos", "hash")
        out = now if out is None else out.unionByName(now)
    return out


def depth_first(nodes: DataFrame) -> DataFrame:
    """``tree``'s rows with ``number``, what to order a run by for a visit depth first,
    left before right: the path from the root down, in binary digits. Rows that
    only carry a run's root further up are left out."""
    high = nodes.groupBy("run_id").agg(F.count_if(F.col("height") == 0).alias("n"))
    top = F.ceil(F.log2("n")).cast("int")
    d = nodes.join(high, "run_id").withColumn("top", F.when(F.col("n") > 1, top).otherwise(0)).filter("height <= top")
    path = F.expr("if(top = height, '', lpad(bin(pos), top - height, '0'))")
    return d.select("height", "run_id", "pos", "hash", path.alias("number"))


def height(n: int) -> int:
    return max(0, (n - 1).bit_length())


def most_leaves(height: int) -> int:
    """Leaves that a tree of this height can hold."""
    return 1 << height


def most_nodes(height: int) -> int:
    return (2 << height) - 1


def serialised(nodes: DataFrame) -> DataFrame:
    """(run_id, height, raw): each level of each run as the hashes of its nodes in
    order, 16 bytes each; levels follow each other from the root to the leaves."""
    at = F.array_sort(F.collect_list(F.struct("pos", "hash")))
    return nodes.groupBy("run_id", "height").agg(F.unhex(F.concat_ws("", F.transform(at, lambda x: x["hash"]))).alias("raw"))


def deserialised(raw: DataFrame) -> DataFrame:
    """The rows of ``tree`` again."""
    each = F.posexplode(F.expr("transform(sequence(0, octet_length(raw) div 16 - 1), i -> lower(hex(substring(raw, i * 16 + 1, 16))))"))
    return raw.select("height", "run_id", each.alias("pos", "hash")).withColumn("pos", F.col("pos").cast("long"))


def differing(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Positions whose leaf hashes differ; a leaf missing on one side counts as zeros."""
    a = stored.select("run_id", "pos", F.col("hash").alias("stored"))
    b = now.select("run_id", "pos", F.col("hash").alias("found"))
    both = a.join(b, ["run_id", "pos"], "full").select("run_id", "pos", F.coalesce("stored", F.lit(_ZERO)).alias("stored"), F.coalesce("found", F.lit(_ZERO)).alias("found"))
    return both.filter("stored <> found")


def check(stored: DataFrame, now: DataFrame) -> DataFrame:
    """One row per run: whether it passed, and how many records differ."""
    bad = differing(stored, now).groupBy("run_id").agg(F.count(F.lit(1)).alias("corrupt"))
    runs = stored.select("run_id").unionByName(now.select("run_id")).distinct()
    return runs.join(bad, "run_id", "left").select("run_id", F.col("corrupt").isNull().alias("passed"), F.coalesce("corrupt", F.lit(0)).alias("corrupt_records"))


def locate(diff: DataFrame, records: DataFrame, block: int = 4096, crc: int = 4) -> DataFrame:
    """Block index of each differing record, from byte offsets in its run."""
    at = lsm.positions(records.select("run_id", "key", lsm.plain_size().alias("size")), "size")
    at = at.select("run_id", F.col("position").alias("pos"), F.concat(F.lit("run="), "run_id").alias("file_path"), F.floor(F.col("offset") / (block - crc)).cast("long").alias("block_index"))
    return diff.join(at, ["run_id", "pos"]).select("run_id", "pos", F.struct("file_path", "block_index").alias("location"))
