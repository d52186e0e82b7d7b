"""Text functions: tokens, key prefixes, tagged values, little-endian fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX_MARK, LONGEST_PREFIX = "000102", 10


def tokens(text: Column) -> Column:
    """Lower-cased words: apostrophes and all but ASCII word characters dropped. ``\\w``
    is one table lookup a character; ranges in its place took 20 times as long."""
    clean = F.regexp_replace(F.lower(text), "[^\\w\\t\\n\\f\\r ]", "")
    return F.filter(F.split(clean, "[\\t\\n\\f\\r ]+"), lambda w: w != "")


def marked_prefixes(key: Column) -> Column:
    """The key's bytes, the marker alone, and the marker before each beginning of
    up to ten bytes: what a prefix Bloom filter holds for a key."""
    raw = key.cast("binary")
    mark = F.unhex(F.lit(PREFIX_MARK))
    begin = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(LONGEST_PREFIX), F.octet_length(key)))), lambda i: F.concat(mark, F.substring(raw, F.lit(1), i)))
    return F.concat(F.array(raw, mark), F.when(F.octet_length(key) > 0, begin).otherwise(F.array().cast("array<binary>")))


def prefix_probe(prefix: Column) -> Column:
    """What to ask a prefix Bloom filter for: the marked first ten bytes."""
    return F.concat(F.unhex(F.lit(PREFIX_MARK)), F.substring(prefix.cast("binary"), 1, LONGEST_PREFIX))


def little_endian(n: Column) -> Column:
    """A whole number as 8 bytes, least first, in hex."""
    h = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])


# The codes of stored files' types.
FILE_TYPES = {
    "": 0,
    "png": 1, "jpg": 2, "jpeg": 3, "gif": 4, "bmp": 5, "webp": 6, "svg": 7,
    "mp3": 10, "wav": 11, "ogg": 12,
    "pdf": 20, "txt": 21, "md": 22,
}
VALUE_KINDS = {0: "text", **dict.fromkeys(range(1, 8), "image"), **dict.fromkeys(range(10, 13), "audio"), **dict.fromkeys(range(20, 23), "document")}


def value_type(value: Column) -> Column:
    """File type of a tagged value by its leading code; none for text, an unknown code or no value."""
    code, out = F.ascii(F.substring(value, 1, 1)), F.lit("")
    for name, k in FILE_TYPES.items():
        if k:
            out = F.when(code == k, name).otherwise(out)
    return F.coalesce(out, F.lit(""))


def tag_typed(value: Column, kind: Column) -> Column:
    """A value tagged with a file type's code, whatever its case; unknown types count as text."""
    code = F.lit(0)
    for name, k in FILE_TYPES.items():
        code = F.when(F.lower(kind) == name, k).otherwise(code)
    return F.concat(F.char(code), value)


def value_kind(value: Column) -> Column:
    """Kind of a tagged value by its leading type code."""
    code, out = F.ascii(F.substring(value, 1, 1)), F.lit(None).cast("string")
    for k, v in VALUE_KINDS.items():
        out = F.when((code == k) & (F.length(value) > 0), v).otherwise(out)
    return out


def tag_value(value: Column, code: int) -> Column:
    return F.concat(F.char(F.lit(code)), value)


def untag_value(value: Column) -> Column:
    return F.substring(value, F.lit(2), F.length(value))
