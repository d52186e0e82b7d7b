"""The binary forms of records and of the log's frames, as column expressions.

Whole numbers are little-endian. A plain record is timestamp 8, tombstone 1,
key length 8, value length 8, key, value; with a key dictionary it is timestamp
8, tombstone 1, key number 8 and, unless it is a tombstone, value length 8 and
value. A frame is payload length 8, kind 1, log number 8, payload.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.text import little_endian

FIRST, MIDDLE, LAST, FULL = 1, 2, 3, 4
HEAD = 17


def _size(c: str) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0))


def _flag() -> Column:
    return F.when(F.col("tombstone"), "01").otherwise("00")


def _bytes(c: str) -> Column:
    return F.coalesce(F.col(c).cast("binary"), F.lit(b""))


def plain() -> Column:
    """The record in columns timestamp, tombstone, key, value."""
    head = F.concat(little_endian(F.col("timestamp")), _flag(), little_endian(_size("key")), little_endian(_size("value")))
    return F.concat(F.unhex(head), F.col("key").cast("binary"), _bytes("value"))


def compressed(key_id: Column) -> Column:
    """The same with the key's number in place of the key."""
    head = F.unhex(F.concat(little_endian(F.col("timestamp")), _flag(), little_endian(key_id)))
    return F.when(F.col("tombstone"), head).otherwise(F.concat(head, F.unhex(little_endian(_size("value"))), _bytes("value")))


def whole(raw: Column, at: int) -> Column:
    """The 8-byte number at byte ``at`` (from 1)."""
    h = F.hex(F.substring(raw, at, 8))
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]), 16, -10).cast("long")


def _rest(raw: Column, at: Column, size: Column) -> Column:
    """``size`` bytes from ``at`` on; none is null, as an empty value and no value are written alike."""
    return F.when(size > 0, F.substring(raw, at.cast("int"), size.cast("int")))


def from_plain(raw: Column) -> Column:
    """struct(timestamp, tombstone, key, value) of a plain record."""
    key, value = whole(raw, 10), whole(raw, 18)
    return F.struct(
        whole(raw, 1).alias("timestamp"),
        (F.hex(F.substring(raw, 9, 1)) == "01").alias("tombstone"),
        F.decode(F.substring(raw, F.lit(26), key.cast("int")), "UTF-8").alias("key"),
        _rest(raw, key + 26, value).alias("value"),
    )


def from_compressed(raw: Column) -> Column:
    """struct(timestamp, tombstone, key_id, value) of a record with a key number."""
    gone = F.hex(F.substring(raw, 9, 1)) == "01"
    value = F.when(~gone, whole(raw, 18))
    return F.struct(whole(raw, 1).alias("timestamp"), gone.alias("tombstone"), whole(raw, 10).alias("key_id"), _rest(raw, F.lit(26), value).alias("value"))


def frames(raw: Column, block: int = 4096, log: int = 0, crc: int = 4) -> Column:
    """array<binary>: the frames of a record, one if it fits a block beside its
    header and checksum, else as many full ones as it needs."""
    room = block - HEAD - crc
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / room)).cast("int")

    def frame(i: Column) -> Column:
        part = F.substring(raw, i * room + 1, F.lit(room))
        kind = F.when(n == 1, f"{FULL:02x}").when(i == 0, f"{FIRST:02x}").when(i == n - 1, f"{LAST:02x}").otherwise(f"{MIDDLE:02x}")
        return F.concat(F.unhex(F.concat(little_endian(F.octet_length(part)), kind, little_endian(F.lit(log)))), part)

    return F.transform(F.sequence(F.lit(0), n - 1), frame)


def frame_kind(frame: Column) -> Column:
    return F.conv(F.hex(F.substring(frame, 9, 1)), 16, 10).cast("int")


def joined(parts: Column) -> Column:
    """The record of all its frames in order."""
    return F.aggregate(parts, F.lit(b""), lambda a, f: F.concat(a, F.substring(f, F.lit(HEAD + 1), F.octet_length(f) - HEAD)))


def _checksum(part: Column) -> Column:
    """CRC32 as 4 bytes, least first."""
    h = F.lpad(F.hex(F.crc32(part)), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def sealed(raw: Column, block: int = 4096, crc: int = 4) -> Column:
    """array<binary>: bytes as blocks, each its checksum and ``block - crc`` bytes;
    zeros fill up the last. No bytes: no blocks."""
    room = block - crc
    n = F.ceil(F.octet_length(raw) / room).cast("int")

    def one(i: Column) -> Column:
        part = F.rpad(F.substring(raw, i * room + 1, F.lit(room)), room, b"\x00")
        return F.concat(_checksum(part), part)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<binary>"))


def intact(block: Column) -> Column:
    """Whether a block's checksum is that of its bytes; one too short for it isn't."""
    size = F.octet_length(block)
    return F.when(size < 4, F.lit(False)).otherwise(F.substring(block, 1, 4) == _checksum(F.substring(block, F.lit(5), size - 4)))


def resealed(block: Column) -> Column:
    """The block with its checksum made anew: what repairs a block written in part."""
    part = F.substring(block, F.lit(5), F.octet_length(block) - 4)
    return F.concat(_checksum(part), part)


def unsealed(blocks: Column, size: Column) -> Column:
    """The first ``size`` bytes that the blocks hold, without checksums."""
    whole = F.aggregate(blocks, F.lit(b""), lambda a, b: F.concat(a, F.substring(b, F.lit(5), F.octet_length(b) - 4)))
    return F.substring(whole, F.lit(1), size)
