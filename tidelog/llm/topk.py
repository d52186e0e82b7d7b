"""Exact top-k search by multi-resolution segment statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import columns, store
from tidelog.llm.vectors import lists, matrices, matrix

#: Bytes of queries that go to the executors at a time, and queries and
#: candidates that are compared at a time.
BLOCK, TOGETHER = 32 << 20, 1024
NOTHING = np.iinfo(np.int64).min


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of equal segments (zeros fill up the last), each times
    the root of the segment's length. The squared distance of two rows of this
    is a lower bound on the squared distance of the vectors."""
    wide = -(-x.shape[1] // segments)
    s = np.zeros((len(x), segments * wide))
    s[:, : x.shape[1]] = x
    s = s.reshape(len(x), segments, wide)
    return np.concatenate([s.mean(2), s.std(2)], 1) * np.sqrt(wide)


def levels(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine: 1, 4, 16, ... below half the dimension."""
    return [n for n in (4**k for k in range(16)) if n == 1 or n * 2 <= dim]


def products(a: np.ndarray, b: np.ndarray, top: float) -> np.ndarray:
    """Inner products of rows of whole numbers, exact as longs; ``top`` bounds
    their size. Beyond the range of longs they stay at its ends."""
    if top < 2**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    if top < 2**63 and max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 2**63:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    whole = (sum(int(p) * int(q) for p, q in zip(r, s)) for r, s in zip(a, b))
    return np.array([max(NOTHING + 1, min(2**63 - 1, w)) for w in whole], np.int64)


class Search:
    """A block of queries, and the k best candidates for each so far. Rows are told
    apart by their place ``at``; ``key`` is the id by which ties are broken."""

    def __init__(self, at: np.ndarray, x: np.ndarray, k: int):
        self.at, self.x, self.k = at, x, k
        self.levels = levels(x.shape[1])
        self.stats = [statistics(x, n) for n in self.levels]
        self.norm = (x**2).sum(1)
        self.top = np.abs(x).max(initial=0) * x.shape[1]
        self.score = np.full((len(at), k), NOTHING)
        self.key = np.full((len(at), k), np.iinfo(np.int64).max)
        self.null = np.ones((len(at), k), bool)
        self.exact = 0

    def offer(self, at: np.ndarray, key: np.ndarray, null: np.ndarray, x: np.ndarray) -> None:
        """Candidates go through the levels: a pair survives while its lower-bound
        distance allows a score that reaches the query's k-th; then exact scores."""
        full = self.score[:, -1] > NOTHING
        if not full.all():  # first candidates: the exact scores of a few set the bar
            few = min(len(at), 4 * self.k)
            self._take(np.repeat(np.arange(len(self.at)), few), np.tile(np.arange(few), len(self.at)), at, key, null, x)
            at, key, null, x = at[few:], key[few:], null[few:], x[few:]
        if not len(at):
            return
        both = self.norm[:, None] + (x**2).sum(1)[None, :]
        slack = 1e-9 * (both + 1)
        worst = both - 2 * self.score[:, -1:].astype(float) + slack  # a larger squared distance can't reach the k-th score
        q = c = None
        for n, stats in zip(self.levels, self.stats):
            s = statistics(x, n)
            if q is None or len(q) * 8 > both.size:
                low = (stats**2).sum(1)[:, None] + (s**2).sum(1)[None, :] - 2 * stats @ s.T
                alive = low - slack <= worst
                if q is not None:
                    kept = np.zeros_like(alive)
                    kept[q, c] = True
                    alive &= kept
                q, c = np.nonzero(alive)
            else:
                keep = np.empty(len(q), bool)
                for i in range(0, len(q), 1 << 18):
                    a, b = q[i : i + (1 << 18)], c[i : i + (1 << 18)]
                    keep[i : i + (1 << 18)] = ((stats[a] - s[b]) ** 2).sum(1) - slack[a, b] <= worst[a, b]
                q, c = q[keep], c[keep]
        self._take(q, c, at, key, null, x)

    def _take(self, q, c, at, key, null, x) -> None:
        top, score = self.top * np.abs(x).max(initial=0), np.empty(len(q), np.int64)
        for i in range(0, len(q), 1 << 17):
            a, b = q[i : i + (1 << 17)], c[i : i + (1 << 17)]
            score[i : i + (1 << 17)] = products(self.x[a], x[b], top)
        self.exact += len(q)
        better = (at[c] != self.at[q]) & (score >= self.score[q, -1])
        q, c, score = q[better], c[better], score[better]
        q = np.concatenate([q, np.repeat(np.arange(len(self.at)), self.k)])
        key, null, score = (np.concatenate([new, old.ravel()]) for new, old in ((key[c], self.key), (null[c], self.null), (score, self.score)))
        order = np.lexsort((null, key, ~score, q))  # ~score: highest first
        q, key, null, score = q[order], key[order], null[order], score[order]
        starts = np.searchsorted(q, np.arange(len(self.at)))
        best = starts[:, None] + np.arange(self.k)[None, :]
        self.key, self.null, self.score = key[best], null[best], score[best]

    def found(self) -> list[pa.Array]:
        """at of the query, id of the candidate, score."""
        at = np.nonzero(self.score > NOTHING)
        return [pa.array(self.at[at[0]]), pa.array(self.key[at], mask=self.null[at]), pa.array(self.score[at])]


def quantised(vectors: DataFrame) -> DataFrame:
    """(at, vec_id, x) of the rows that take part: every component floor(256 * c),
    ``at`` the row's number. Vectors that are null or empty, hold null or
    non-finite components, or leave the range of doubles when multiplied, don't."""

    def run(batches):
        for b in batches:
            for rows, x in matrices(b.column(1)):
                with np.errstate(over="ignore"):
                    x = np.floor(256 * x)
                good = np.isfinite(x).all(1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[good])), lists(x[good])], names=["vec_id", "x"])

    d = columns(vectors, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    return store(d.mapInArrow(run, "vec_id long, x array<double>").withColumn("at", F.monotonically_increasing_id()), "quantised")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """The ``k`` vectors of largest inner product for each query, all but itself.

    Both tables: (at, vec_id, x array<double> of whole numbers), where ``at``
    tells rows apart and is the same for a row in both. Queries of one length
    go to the executors in blocks of about ``block`` bytes, which is what the
    driver and each task hold of them; every partition of the candidates is
    read against the block and keeps its k best per query. A pair is dropped
    at the first resolution whose lower-bound distance d satisfies
    (|q|^2 + |x|^2 - d^2) / 2 < the k-th score so far, so no pair that belongs
    to the result is lost. The partitions' bests are merged per query. Where
    there is more than one block, each one's bests are written before the next
    goes out.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id,
    a null id last. Scores are exact; beyond the range of longs they stay at
    its ends. Vectors of another length than the query's are no candidates.
    Rows that repeat an id are candidates and queries each for itself. Empty
    tables give no rows.
    """
    spark = vectors.sparkSession
    asked = store(queries.withColumn("dim", F.size("x")), "queries")
    counts = asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()  # one row per vector length
    parts = {r["dim"]: -(-8 * r["dim"] * r["n"] // block) for r in counts}
    found = None
    for dim, n in parts.items():
        for part in range(n):
            mine = asked.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("at"), F.lit(n)) == part)).select("at", "x").toArrow()  # about `block` bytes
            held = spark.sparkContext.broadcast((mine.column(0).to_numpy(), matrix(mine.column(1))))
            got = vectors.filter(F.size("x") == dim).select("at", "vec_id", "x").mapInArrow(_partition(held, k), "at long, vec_id long, score long")
            if sum(parts.values()) > 1:
                got = store(got, "bests")
                held.unpersist()
            found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("at").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    ranked = ranked.join(asked.select("at", F.col("vec_id").alias("query_id")), "at")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _partition(held, k: int):
    def run(batches):
        all_ = None
        for b in batches:
            if not b.num_rows:
                continue
            if all_ is None:
                at, x = held.value
                all_ = [Search(at[i : i + TOGETHER], x[i : i + TOGETHER], k) for i in range(0, len(at), TOGETHER)]
            at, x, null = b.column(0).to_numpy(), matrix(b.column(2)), b.column(1).is_null().to_numpy(zero_copy_only=False)
            key = b.column(1).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            for s in all_:
                for i in range(0, len(at), TOGETHER):
                    part = slice(i, i + TOGETHER)
                    s.offer(at[part], key[part], null[part], x[part])
        for s in all_ or []:
            yield pa.RecordBatch.from_arrays(s.found(), names=["at", "vec_id", "score"])

    return run


def topk(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``search`` for the rows of ``vectors`` (vec_id, embedding) whose id is
    divisible by ``every`` against all others, over quantised components.
    Vectors that are null or empty or hold null or non-finite components take
    no part; a null id is never a query, but a candidate. Other columns are
    ignored, whatever their names."""
    x = quantised(vectors)
    return search(x, x.filter(F.col("vec_id") % every == 0), k)
