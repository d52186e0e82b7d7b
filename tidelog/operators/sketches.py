"""Sketches by exact formula: Bloom, prefix Bloom, Count-Min, HyperLogLog, SimHash.

Each sketch is a small table that merges by an aggregate: set bits by union,
cells by sum, registers by maximum. Seeds are 0 .. k-1.
"""

from __future__ import annotations

import math
import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import hashing, text
from tidelog.sources import files


def bloom_size(items: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions for a number of items at a false-positive rate."""
    n = items if items > 0 else 1
    p = rate if 0 < rate < 1 else 0.01
    m = math.ceil(n * abs(math.log(p)) / math.log(2) ** 2)
    return m, max(1, math.ceil(m / n * math.log(2)))


def _bits(raw: DataFrame, m: int, k: int) -> DataFrame:
    each = raw.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return each.withColumn("bit", (hashing.seeded_bytes(F.col("raw"), F.col("i")) % m).cast("int"))


def bloom_bits(items: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """The set bits, at most ``m`` rows."""
    return _bits(items.select(F.col(column).cast("string").cast("binary").alias("raw")).distinct(), m, k).select("bit").distinct()


def prefix_bloom_bits(keys: DataFrame, column: str, m: int, k: int) -> DataFrame:
    raw = keys.select(F.explode(text.marked_prefixes(F.col(column))).alias("raw")).distinct()
    return _bits(raw, m, k).select("bit").distinct()


def bloom_test(bits: DataFrame, probes: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """(column, maybe): whether all k bits of each distinct probe are set."""
    p = probes.select(column).distinct().withColumn("raw", F.col(column).cast("string").cast("binary"))
    hit = _bits(p, m, k).join(bits.withColumn("set", F.lit(1)), "bit", "left")
    return hit.groupBy(column).agg((F.count("set") == k).alias("maybe"))


def prefix_bloom_test(bits: DataFrame, probes: DataFrame, column: str, m: int, k: int) -> DataFrame:
    p = probes.select(column).distinct().withColumn("raw", text.prefix_probe(F.col(column)))
    hit = _bits(p, m, k).join(bits.withColumn("set", F.lit(1)), "bit", "left")
    return hit.groupBy(column).agg((F.count("set") == k).alias("maybe"))


def cms_size(epsilon: float, delta: float) -> tuple[int, int]:
    return math.ceil(math.e / epsilon), math.ceil(math.log(math.e / delta))


def _cells(items: DataFrame, column: str, m: int, k: int) -> DataFrame:
    each = items.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return each.withColumn("col", (hashing.seeded_bytes(F.col(column).cast("string").cast("binary"), F.col("row")) % m).cast("int"))


def cms_cells(items: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """Count-Min cells that are not 0. Equal items are counted before they are
    hashed, so a frequent item is hashed once per task and reaches the shuffle once."""
    n = items.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return _cells(n, column, m, k).groupBy("row", "col").agg(F.sum("n").alias("cnt"))


def cms_query(cells: DataFrame, probes: DataFrame, column: str, m: int, k: int) -> DataFrame:
    hit = _cells(probes.select(column).distinct(), column, m, k).join(cells, ["row", "col"], "left")
    return hit.groupBy(column).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def hll_registers(items: DataFrame, column: str, p: int) -> DataFrame:
    """Registers that are not 0, at most 2^p rows."""
    if not 4 <= p <= 16:
        raise ValueError("precision must lie in 4..16")
    h = items.select(hashing.sha64(F.col(column)).alias("h"))
    return h.groupBy(F.shiftrightunsigned("h", 64 - p).cast("int").alias("bucket")).agg(F.max(hashing.trailing_rank(F.col("h"))).cast("int").alias("rank"))


def hll_estimate(registers: DataFrame, p: int) -> DataFrame:
    m = 1 << p
    r = registers.agg(F.count(F.lit(1)).alias("used"), F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("part"))
    e = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("part") + (m - F.col("used")))
    empty, far = F.lit(m) - F.col("used"), 2.0**32
    low = F.lit(float(m)) * F.log(F.lit(float(m)) / F.greatest(empty, F.lit(1)))
    big = -far * F.log(F.greatest(F.lit(1) - e / far, F.lit(1e-300)))
    return r.select(F.when((e <= 2.5 * m) & (empty > 0), low).when((e > 2.5 * m) & (e > far / 30), big).otherwise(e).alias("estimate"))


def native_distinct(items: DataFrame, column: str) -> DataFrame:
    """Spark's own sketch, for speed where the exact formula doesn't matter."""
    return items.agg(F.approx_count_distinct(column).alias("estimate"))


def token_frequency(docs: DataFrame) -> DataFrame:
    """Occurrences of each token over all texts."""
    return docs.select(F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def word_frequency(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(key, F.explode(text.tokens(F.col("text"))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, hashing.simhash(text.tokens(F.col("text"))).alias("fingerprint"))


def _bands(most: int, prints: int, spread: int = 4) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Blocks (start, length) of the 128 bits, and which of them make a band each.

    Two prints ``most`` bits apart agree in at least ``blocks - most`` of any
    number of blocks, so every choice of that many blocks is a band. The fewest
    blocks whose bands hold ``spread`` of ``prints`` evenly dealt prints at most
    are taken: 8 bands of 16 bits, 36 of 28 bits, 120 of 36 bits, ... for the
    largest distance, so that candidates grow with the prints, not their square.
    """
    for blocks in range(most + 1, most + 5):
        ends = [128 * i // blocks for i in range(blocks + 1)]
        chosen = list(combinations(range(blocks), blocks - most))
        bits = min(sum(ends[i + 1] - ends[i] for i in c) for c in chosen)
        if prints <= spread << bits:
            break
    return [(a + 1, b - a) for a, b in zip(ends, ends[1:])], chosen


_DENSE = 12  # pairs in blocks that cost as much as a candidate of a join, about 4 to 50 ns


def _blocks(size: Column) -> Column:
    """Blocks of a group of so many prints: about 1024 prints each up to 32 blocks, then 4096."""
    return F.greatest(F.lit(1), F.least(F.lit(32), F.ceil(size / 1024)), F.ceil(size / 4096)).cast("int")


def _met(b: DataFrame, most: int, parts: int) -> DataFrame:
    """Pairs (a, b, distance) of prints of a band at most ``most`` bits apart."""
    left, right = (b.select("band", *[F.col(c).alias(f"{c}{k}") for c in ("fingerprint", "h", "l")]).repartition(parts, "band") for k in (1, 2))
    distance = (F.bit_count(F.col("h1").bitwiseXOR(F.col("h2"))) + F.bit_count(F.col("l1").bitwiseXOR(F.col("l2")))).cast("int")
    pairs = left.join(right.hint("merge"), "band").filter((distance <= most) & (F.col("fingerprint1") < F.col("fingerprint2")))
    return pairs.select(F.col("fingerprint1").alias("a"), F.col("fingerprint2").alias("b"), distance.alias("distance"))


def _met_by_blocks(b: DataFrame, most: int, parts: int) -> DataFrame:
    """The same of large bands, cut into ``blocks``: every two blocks of a band meet by themselves."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):  # then that side has no columns
            return pa.table({"a": pa.array([], "string"), "b": pa.array([], "string"), "distance": pa.array([], "int32")})
        names = [t.column(f"fingerprint{n}").combine_chunks() for t, n in ((left, 1), (right, 2))]
        (h, l), (g, k) = ([np.asarray(t[f"{c}{n}"]).view(np.uint64) for c in "hl"] for t, n in ((left, 1), (right, 2)))
        found = []
        for i in range(0, len(h), 64):
            far = np.bitwise_count(h[i : i + 64, None] ^ g) + np.bitwise_count(l[i : i + 64, None] ^ k)
            x, y = np.nonzero(far <= most)
            found.append([x + i, y, far[x, y]])
        x, y, far = map(np.concatenate, zip(*found))
        if len(x) and left["i"][0] == left["j"][0]:  # a block and itself: each pair comes twice, and each print with itself
            one, two = (np.array(n.to_pylist()) for n in names)
            once = one[x] < two[y]
            x, y, far = x[once], y[once], far[once]
        return pa.table({"a": names[0].take(pa.array(x)), "b": names[1].take(pa.array(y)), "distance": pa.array(far.astype(np.int32))})

    b = b.withColumn("block", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    left = b.withColumns({"i": F.col("block"), "j": F.explode(F.sequence("block", F.col("blocks") - 1))})
    right = b.withColumns({"i": F.explode(F.sequence(F.lit(0), "block")), "j": F.col("block")})
    # named anew on both sides: Spark takes columns that two sides share for one
    sides = [x.select(F.col("band").alias("band"), "i", "j", *[F.col(c).alias(f"{c}{n}") for c in ("fingerprint", "h", "l")]) for x, n in ((left, 1), (right, 2))]
    left, right = (x.repartition(parts, "band", "i", "j").groupBy("band", "i", "j") for x in sides)
    pairs = left.cogroup(right).applyInArrow(meet, "a string, b string, distance int")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def fingerprint_pairs(prints: DataFrame, most: int = 7) -> DataFrame:
    """Distinct fingerprints at most ``most`` (up to 7) bits apart.

    Candidates agree in a band, see ``_bands``; exact distances follow. Where the
    prints lie so close that the candidates of the bands would cost more than all
    pairs of prints, all prints are one band instead, and every pair is met once.
    Large bands meet by blocks, so no task holds more than two blocks of a band
    or grows with its square. Equal fingerprints are one row here, so copies add
    no pairs; members are found by joining back on the fingerprint. Null
    fingerprints take no part. The distinct fingerprints stay cached.
    """
    if not 0 <= most <= 7:
        raise ValueError("distances up to 7 can be found")
    halves = [hashing.half(F.col("fingerprint"), i) for i in (0, 1)]
    d = prints.select("fingerprint").filter("fingerprint is not null").distinct()
    d = d.select("fingerprint", halves[0].alias("h"), halves[1].alias("l")).filter("h is not null and l is not null").persist()
    n = d.count()
    blocks, chosen = _bands(most, n)
    bits = F.concat(*[F.lpad(F.bin(c), 64, "0") for c in ("h", "l")])
    part = [F.substring(bits, a, k) for a, k in blocks]
    keys = F.array(*[F.xxhash64(F.lit(i), *[part[k] for k in c]) for i, c in enumerate(chosen)])
    b = d.select("*", F.explode(keys).alias("band"))
    size = b.groupBy("band").agg(F.count(F.lit(1)).alias("size"))
    met, every = size.agg(F.sum(F.col("size") * (F.col("size") - 1) / 2)).first()[0] or 0, n * (n - 1) // 2
    dense = every <= _DENSE * met
    # tasks of about 2^21 pairs or 2^18 rows: few bytes make many pairs, so Spark would put them all in one
    parts = 1 + int(min(4096, max((every if dense else met) // 2**21, n * len(chosen) // 2**18)))
    if dense:
        return _met_by_blocks(d.withColumns({"band": F.lit(0), "blocks": _blocks(F.lit(n))}), most, parts)
    large = size.select("band", _blocks(F.col("size")).alias("blocks")).filter("blocks > 1")
    return _met(b.join(large, "band", "left_anti"), most, parts).unionByName(_met_by_blocks(b.join(large, "band"), most, parts)).distinct()


def bands_of(pairs: DataFrame) -> DataFrame:
    name, share = hashing.band(F.col("distance"))
    return pairs.withColumns({"band": name, "similarity": share})


# --- named sketches on disk -----------------------------------------------------


class Registry:
    """Named sketches below ``root``: create, add to, ask, drop.

    A sketch keeps its own sizes, in a file beside its partial sketches. Each
    partial sketch has an id; one that is added again under its id replaces
    itself, so a retried count counts once.
    """

    MERGE = {"bloom": (["bit"], None), "cms": (["row", "col"], ("cnt", F.sum)), "hll": (["bucket"], ("rank", F.max)), "simhash": (["name", "fingerprint"], None)}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, kind: str, name: str) -> str:
        if kind not in self.MERGE:
            raise ValueError(f"unknown kind {kind}")
        return f"{self.root}/{kind}/{name}"

    def _parts(self, kind: str, name: str) -> list[str]:
        fs, p = files.at(self.spark, self._path(kind, name))
        return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def create(self, kind: str, name: str, **sizes: int | float) -> dict:
        """A new sketch: ``items`` and ``rate`` for bloom, ``epsilon`` and ``delta`` for
        cms, ``precision`` for hll. An error where the name is taken."""
        if self.sizes(kind, name) is not None or self._parts(kind, name):
            raise ValueError(f"there is a {kind} named {name}")
        if kind == "bloom":
            m, k = bloom_size(sizes["items"], sizes["rate"])
            sizes |= {"m": m, "k": k}
        elif kind == "cms":
            m, k = cms_size(sizes["epsilon"], sizes["delta"])
            sizes |= {"m": m, "k": k}
        elif kind == "hll" and not 4 <= sizes["precision"] <= 16:
            raise ValueError("precision must lie in 4..16")
        files.write_json(self.spark, f"{self._path(kind, name)}/sizes.json", sizes)
        return sizes

    def sizes(self, kind: str, name: str) -> dict | None:
        return files.read_json(self.spark, f"{self._path(kind, name)}/sizes.json")

    def _known(self, kind: str, name: str) -> dict:
        if (sizes := self.sizes(kind, name)) is None:
            raise KeyError(f"no {kind} named {name}")
        return sizes

    def add(self, kind: str, name: str, rows: DataFrame, part: str | None = None) -> str:
        """Add a partial sketch under an id, a new one if none is given; partial
        sketches merge when read."""
        part = part or uuid.uuid4().hex
        rows.write.mode("overwrite").parquet(f"{self._path(kind, name)}/part={part}")
        return part

    def add_items(self, kind: str, name: str, items: DataFrame, column: str, part: str | None = None) -> str:
        """Add the values of a column to a sketch that ``create`` made."""
        z = self._known(kind, name)
        if kind == "bloom":
            rows = bloom_bits(items, column, z["m"], z["k"])
        elif kind == "cms":
            rows = cms_cells(items, column, z["m"], z["k"])
        elif kind == "hll":
            rows = hll_registers(items, column, z["precision"])
        else:
            raise ValueError(f"a {kind} takes no items")
        return self.add(kind, name, rows, part)

    def load(self, kind: str, name: str) -> DataFrame:
        keys, value = self.MERGE[kind] if kind in self.MERGE else self._path(kind, name)
        parts = self._parts(kind, name)
        if not parts:
            if self.sizes(kind, name) is None:
                raise KeyError(f"no {kind} named {name}")
            return self.spark.createDataFrame([], ", ".join(f"{c} int" for c in keys) + (f", {value[0]} long" if value else ""))
        d = self.spark.read.parquet(*parts)
        return d.groupBy(*keys).agg(value[1](value[0]).alias(value[0])) if value else d.select(*keys).distinct()

    def test(self, name: str, probes: DataFrame, column: str) -> DataFrame:
        """(column, maybe) of a bloom."""
        z = self._known("bloom", name)
        return bloom_test(self.load("bloom", name), probes, column, z["m"], z["k"])

    def count(self, name: str, probes: DataFrame, column: str) -> DataFrame:
        """(column, estimate) of a cms."""
        z = self._known("cms", name)
        return cms_query(self.load("cms", name), probes, column, z["m"], z["k"])

    def estimate(self, name: str) -> float:
        """Distinct values of an hll."""
        return hll_estimate(self.load("hll", name), self._known("hll", name)["precision"]).first()["estimate"]

    def empty_registers(self, name: str) -> int:
        return (1 << self._known("hll", name)["precision"]) - self.load("hll", name).count()

    def save_fingerprint(self, name: str, text: str) -> str:
        """Keeps the fingerprint of a text under a name, and returns it."""
        rows = fingerprints(self.spark.createDataFrame([(name, text)], "name string, text string"), "name")
        self.add("simhash", name, rows, "one")
        return self.fingerprint(name)

    def fingerprint(self, name: str) -> str:
        return self.load("simhash", name).select(hashing.fingerprint(F.col("fingerprint")).alias("f")).first()["f"]

    def compare(self, a: str, b: str) -> dict:
        """Distance, band and similarity of two kept fingerprints."""
        return compare(self.spark, self.fingerprint(a), self.fingerprint(b))

    def drop(self, kind: str, name: str) -> bool:
        fs, p = files.at(self.spark, self._path(kind, name))
        return fs.delete(p, True)


def compare(spark: SparkSession, a: str, b: str) -> dict:
    """Distance, band and similarity of two fingerprints; an error for other texts."""
    d = spark.createDataFrame([(a, b)], "a string, b string").select(*[hashing.fingerprint(F.col(c)).alias(c) for c in "ab"])
    return bands_of(d.select(hashing.hamming(F.col("a"), F.col("b")).alias("distance"))).first().asDict()


def compare_documents(spark: SparkSession, a: str, b: str) -> dict:
    """The same of the fingerprints of two texts."""
    rows = fingerprints(spark.createDataFrame([(0, a), (1, b)], "doc_id long, text string"))
    return compare(spark, *[r["fingerprint"] for r in rows.orderBy("doc_id").collect()])
