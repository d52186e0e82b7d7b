"""Hash functions as column expressions, and the one that needs Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def seed_hex(i: int) -> str:
    return f"{i:016x}"


def seeded(item: Column, seed: int) -> Column:
    """The first 64 bits of md5(item, 8-byte seed), as a whole decimal."""
    data = F.concat(item.cast("string").cast("binary"), F.unhex(F.lit(seed_hex(seed))))
    return F.conv(F.substring(F.md5(data), 1, 16), 16, 10).cast("decimal(20,0)")


def seeded_bytes(item: Column, seed: Column) -> Column:
    """The same for an item of bytes and a column of seeds."""
    data = F.concat(item, F.unhex(F.lpad(F.hex(seed), 16, "0")))
    return F.conv(F.substring(F.md5(data), 1, 16), 16, 10).cast("decimal(20,0)")


def sha64(item: Column) -> Column:
    """The first 64 bits of SHA-256 as a bit pattern in a long."""
    return F.conv(F.substring(F.sha2(item.cast("string"), 256), 1, 16), 16, -10).cast("long")


def trailing_rank(h: Column) -> Column:
    """Trailing zero bits + 1; 65 for zero."""
    return F.when(h == 0, F.lit(65)).otherwise(F.bit_count(h.bitwiseXOR(h - 1)))


# Offset and prime (2^88 + 0x13B) of the 128-bit FNV-1a hash.
_OFFSET = 0x6C62272E07BB014262B821756295C58D
_PRIME_SHIFT, _PRIME_LOW = 24, 0x13B  # the prime's bit in the upper half, and its lower half


def fnv128(words: list[str]) -> np.ndarray:
    """FNV-1a of each word as 16 bytes, a byte of all words at a time, in halves of 64 bits."""
    raw = [w.encode() for w in words]
    size = np.array([len(r) for r in raw], np.int64)
    order = np.argsort(-size, kind="stable")
    start, size = (np.cumsum(size) - size)[order], size[order]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    high = np.full(len(raw), _OFFSET >> 64, np.uint64)
    low = np.full(len(raw), _OFFSET & (1 << 64) - 1, np.uint64)
    u, prime, mask = np.uint64, np.uint64(_PRIME_LOW), np.uint64(0xFFFFFFFF)
    for i in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -i, "left"))  # words longer than i come first
        h, x = high[:n], low[:n] ^ data[start[:n] + i]
        top = (x >> u(32)) * prime + ((x & mask) * prime >> u(32))  # x * prime beyond its lower 32 bits
        high[:n] = h * prime + (x << u(_PRIME_SHIFT)) + (top >> u(32))
        low[:n] = x * prime
    out = np.empty((len(raw), 2), ">u8")
    out[order, 0], out[order, 1] = high, low
    return out.view(np.uint8).reshape(len(raw), 16)


def simhashes(texts: list) -> list[str | None]:
    """128-bit SimHash of each list of weighted tokens as 32 hex digits; no tokens:
    all ones; null: null. A batch's distinct words are hashed once."""
    kept = [t for t in texts if t is not None]
    n = np.array([len(t) for t in kept], np.int64)
    words: dict[str, int] = {}
    at = np.array([words.setdefault(w, len(words)) for t in kept for w in t], np.int64)
    votes = np.unpackbits(fnv128(list(words)), axis=1).astype(np.int64) * 2 - 1
    ends, out = np.cumsum(n), []
    for a, b in zip(ends - n, ends):
        one, many = np.unique(at[a:b], return_counts=True)
        out.append(np.packbits(many @ votes[one] >= 0).tobytes().hex())
    found = iter(out)
    return [None if t is None else next(found) for t in texts]


def simhash(tokens: Column) -> Column:
    """``simhashes`` over Arrow batches."""

    def prints(batch: pd.Series) -> pd.Series:
        return pd.Series([x for i in range(0, len(batch), 512) for x in simhashes(batch.iloc[i : i + 512].tolist())], dtype=object)

    return F.pandas_udf(prints, "string")(tokens)


def half(fingerprint: Column, which: int) -> Column:
    """A 64-bit half (0 high, 1 low) of 32 hex digits."""
    return F.conv(F.substring(fingerprint, 1 + 16 * which, 16), 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return sum((F.bit_count(half(a, k).bitwiseXOR(half(b, k))) for k in (0, 1)), F.lit(0)).cast("int")


def fingerprint(text: Column) -> Column:
    """32 hex digits read back as a fingerprint, lower-cased; an error for anything else."""
    good = text.rlike("^[0-9A-Fa-f]{32}$")
    return F.when(text.isNull() | good, F.lower(text)).otherwise(F.raise_error(F.lit("a fingerprint has 32 hex digits")).cast("string"))


def is_zero(fingerprint: Column) -> Column:
    return fingerprint == "0" * 32


# Largest distance, name and percentage of each band.
BANDS = ((0, "Identical", 100), (3, "Very Similar", 98), (6, "Similar", 90), (12, "Somewhat Similar", 75), (20, "Slightly Similar", 50), (30, "Different", 25))


def band(distance: Column) -> tuple[Column, Column]:
    """Name and percentage of a Hamming distance."""
    name, share = F.lit("Very Different"), F.lit(5)
    for most, n, s in reversed(BANDS):
        name, share = F.when(distance <= most, n).otherwise(name), F.when(distance <= most, s).otherwise(share)
    return name, share
