"""The record log and the views of relational tables as record logs.

A log row is (key, value, tombstone, timestamp, seq). ``seq`` is the order of
arrival, the only thing that decides which version of a key is newest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("tombstone", T.BooleanType(), False),
    T.StructField("timestamp", T.LongType(), False),
    T.StructField("seq", T.LongType(), False),
])
VERSION = ("value", "tombstone", "timestamp", "seq")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a time without zone, whatever the session's zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def events_log(events: DataFrame) -> DataFrame:
    """A user's latest properties; an error event deletes them."""
    gone = F.col("event_type") == "error"
    return events.select(
        F.concat(F.lit("user_"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        F.when(~gone, F.col("props")).alias("value"),
        gone.alias("tombstone"),
        epoch_seconds(F.col("ts")).alias("timestamp"),
        F.col("event_id").alias("seq"),
    )


def orders_log(orders: DataFrame) -> DataFrame:
    gone = F.col("o_orderstatus") == "F"
    part = [F.lit("cust_"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")]
    return orders.select(F.concat(*part).alias("key"), F.when(~gone, F.col("o_orderpriority")).alias("value"), gone.alias("tombstone"), epoch_seconds(F.col("o_orderdate")).alias("timestamp"), F.col("o_orderkey").alias("seq"))


def part_log(part: DataFrame) -> DataFrame:
    key = F.concat("p_name", F.lit("#"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    return part.select(key.alias("key"), F.col("p_type").alias("value"), F.lit(False).alias("tombstone"), F.lit(0).cast("long").alias("timestamp"), F.col("p_partkey").alias("seq"))
