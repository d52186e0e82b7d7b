"""Point reads, ordered scans with pages, and cursor iteration over a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.plans.snapshot import live
from tidelog.sources import files

#: Page size and number that replace bad ones.
PAGE_SIZE, PAGE = 5, 0


def get(log: DataFrame, key: str) -> DataFrame:
    return live(log.filter(F.col("key") == key)).select("key", "value", "timestamp", F.col("tombstone").alias("deleted"))


def get_many(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The live versions of the keys in ``keys``, narrowed before the aggregate."""
    return live(log.join(keys.select("key").distinct(), "key", "left_semi"))


def _page(rows: DataFrame, size: int, number: int, keys_only: bool) -> DataFrame:
    size = size if size > 0 else PAGE_SIZE
    number = number if number >= 0 else PAGE
    page = rows.orderBy("key").offset(number * size).limit(size) if number else rows.orderBy("key").limit(size)
    return page.select("key") if keys_only else page


def with_prefix(prefix: str) -> Column:
    return F.col("key").startswith(prefix)


def prefix_scan(log: DataFrame, prefix: str, size: int = PAGE_SIZE, number: int = PAGE, keys_only: bool = True) -> DataFrame:
    """A page of the live keys with the prefix, ascending bytewise; pages count from 0."""
    return _page(live(log.filter(with_prefix(prefix))), size, number, keys_only)


def range_scan(log: DataFrame, start: str, end: str, size: int = PAGE_SIZE, number: int = PAGE, keys_only: bool = True) -> DataFrame:
    """A page of the live keys in [start, end], both ends included."""
    return _page(live(log.filter(F.col("key").between(start, end))), size, number, keys_only)


def prefix_iterate(log: DataFrame, prefix: str, cursor: str = "") -> DataFrame:
    """The first live record after ``cursor`` with the prefix. Keyset pagination:
    a call costs the same however far the cursor has come."""
    return live(log.filter(with_prefix(prefix) & (F.col("key") > cursor))).orderBy("key").limit(1)


def range_iterate(log: DataFrame, start: str, end: str, cursor: str = "") -> DataFrame:
    """The first live record after ``cursor`` in [start, end]; ``start`` itself counts
    while the cursor is before it."""
    return live(log.filter(F.col("key").between(start, end) & (F.col("key") > cursor))).orderBy("key").limit(1)


def prefix_after(log: DataFrame, prefix: str, cursor: str, size: int) -> DataFrame:
    """The ``size`` live keys after ``cursor``: deep pages without an offset."""
    return live(log.filter(with_prefix(prefix) & (F.col("key") > cursor))).orderBy("key").limit(size)


def predecessor(text: str) -> str:
    """A string just below ``text`` to start a cursor from: the last character that
    can go down does, what follows becomes U+10FFFF; empty stays empty."""
    for i in range(len(text) - 1, -1, -1):
        c = ord(text[i])
        if c:
            c = 0xD7FF if c == 0xE000 else c - 1
            return text[:i] + chr(c) + "\U0010ffff" * (len(text) - i - 1)
    return ""


def key_dictionary(log: DataFrame) -> DataFrame:
    """Numbers for keys, from 1 in order of first arrival.

    Keys are cut into ranges of first ``seq`` and numbered within; a range's
    base is the count of all before it, one row per range, so no task sorts
    every key.
    """
    from pyspark.sql import Window

    first = log.groupBy("key").agg(F.min("seq").alias("first_seq")).withColumn("part", F.floor(F.col("first_seq") / 65536))
    sizes = first.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("part").orderBy("first_seq", "key"))
    return first.withColumn("i", inside).join(base, "part").select((F.col("base") + F.col("i")).cast("long").alias("id"), "key")


class KeyDictionary:
    """Numbers for keys that stay: a Parquet table (id, key) under ``path``.

    Keys that are added get the next numbers in order of first arrival; a key
    keeps its number. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame:
        fs, p = files.at(self.spark, self.path)
        return self.spark.read.schema("id long, key string").parquet(self.path) if fs.exists(p) else self.spark.createDataFrame([], "id long, key string")

    def add(self, log: DataFrame) -> int:
        """Add the keys of (key, seq) that have no number yet; returns how many."""
        known = self.entries()
        top = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        new = key_dictionary(log.select("key", "seq").join(known.select("key"), "key", "left_anti"))
        new.select((F.col("id") + top).alias("id"), "key").write.mode("append").parquet(self.path)
        return self.entries().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] - top

    def add_key(self, key: str) -> int:
        """The key's number, a new one if it has none."""
        if (known := self.id_of(key)) is None:
            self.add(self.spark.createDataFrame([(key, 0)], "key string, seq long"))
            known = self.id_of(key)
        return known

    def id_of(self, key: str) -> int | None:
        r = self.entries().filter(F.col("key") == key).first()
        return r["id"] if r else None

    def key_of(self, number: int) -> str | None:
        r = self.entries().filter(F.col("id") == number).first()
        return r["key"] if r else None

    def encode(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``key_id`` for their key; null where it has none."""
        return rows.join(self.entries().withColumnRenamed("id", "key_id"), "key", "left")
