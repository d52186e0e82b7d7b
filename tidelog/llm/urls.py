"""URL filters: rules first, then a ratio of two character language models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import columns, store

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: The longest context in bytes. A context, and a byte after one, is kept where it
#: makes up one in ``SUPPORT`` of all learned bytes or more: so at most this many an order.
ORDER, SUPPORT = 5, 1 << 20
#: Bytes of urls worked on at a time.
BATCH = 1 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/ ? #`` or end, A-Z lower-cased; path
    from there up to ``?`` or ``#`` or end; both empty for null or no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.when(path.startswith("/"), path).otherwise(F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and subdomains, path by prefix), and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def grams(raw: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each byte of each text the text's number and, for each order k, its cell:
    the byte and its k predecessors (0 before the start) as one number, with k
    above them. A cell's context is what remains without its last byte."""
    n = np.array([len(r) for r in raw], np.int64)
    of = np.repeat(np.arange(len(raw)), n)
    code = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    at = np.arange(code.size) - np.repeat(np.cumsum(n) - n, n)
    cells, cell = [code], code
    for back in range(1, ORDER + 1):
        before = np.zeros(code.size, np.int64)
        before[back:] = code[:-back]
        before[at < back] = 0
        cell = cell + (before << 8 * back)
        cells.append(cell + (back << 56))
    return of, cells


def context(cell):
    """The context of cells (arrays or columns), with its order above it."""
    if isinstance(cell, Column):
        return F.shiftright(cell, 56) * (1 << 56) + F.shiftright(cell.bitwiseAND(F.lit((1 << 56) - 1)), 8)
    return (cell >> 56 << 56) + ((cell & ((1 << 56) - 1)) >> 8)


def _parts(raw: list[bytes]):
    """(start, stop) of parts of about ``BATCH`` bytes."""
    start = 0
    while start < len(raw):
        stop, size = start, 0
        while stop < len(raw) and (stop == start or size < BATCH):
            size += len(raw[stop])
            stop += 1
        yield start, stop
        start = stop


def counted(texts: DataFrame) -> DataFrame:
    """(text, allow boolean) to (cell, allow count, block count), over all rows."""

    def count(batches):
        for b in batches:
            raw, allow = [t.encode() for t in b.column(0).to_pylist()], b.column(1).to_numpy(zero_copy_only=False)
            for i, j in _parts(raw):
                of, cells = grams(raw[i:j])
                both, n = np.unique(np.concatenate([c * 2 + allow[i:j][of] for c in cells]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (both >> 1, n * (both & 1), n * (1 - (both & 1)))], names=["cell", "allow", "block"])

    found = texts.select("text", "allow").mapInArrow(count, "cell long, allow long, block long")
    return found.groupBy("cell").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


class Ratio:
    """Two byte models of variable order, from contexts and cells as ``learned`` returns them.

    A model interpolates orders 0 to ``ORDER`` as far as the context is kept, by
    Witten-Bell: the weight of the shorter context is the number of kinds of
    bytes seen after this one, and whatever was counted in cells not kept.
    """

    def __init__(self, contexts: pa.Table, cells: pa.Table):
        self.context, self.total, self.rest = self._sorted(contexts, "context", ("allow_all", "block_all"), ("allow_rest", "block_rest"))
        self.cell, self.n = self._sorted(cells, "cell", ("allow", "block"))

    @staticmethod
    def _sorted(t: pa.Table, key: str, *values):
        k = t.column(key).to_numpy().astype(np.int64)
        order = np.argsort(k)
        return k[order], *[np.stack([t.column(c).to_numpy()[order] for c in v]).astype(float) for v in values]

    @staticmethod
    def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return at, keys[at] == asked

    def scored(self, raw: list[bytes]) -> np.ndarray:
        """Mean log-likelihood difference per byte, allow less block; 0 for an empty text."""
        out = [np.zeros(0)]
        for i, j in _parts(raw):
            of, cells = grams(raw[i:j])
            p = np.full((2, len(of)), 1 / 256)
            for cell in cells:
                at, there = self._found(self.context, context(cell))
                here, seen = self._found(self.cell, cell)
                n = np.where(seen, self.n[:, here], 0) if len(self.cell) else np.zeros_like(p)
                total, rest = (self.total[:, at], self.rest[:, at]) if len(self.context) else (p * 0, p * 0)
                p = np.where(there & (total > 0), (n + rest * p) / np.maximum(total, 1), p)
            both = np.log(p)
            out.append(np.bincount(of, both[0] - both[1], j - i) / np.maximum(np.bincount(of, minlength=j - i), 1))
        return np.concatenate(out)


def learned(cells: DataFrame, support: int = SUPPORT) -> Ratio:
    """The models from the counts of all cells: what is kept of them, at most
    ``support`` contexts and cells an order, goes to the driver."""
    total = cells.filter(F.shiftright("cell", 56) == 0).agg(F.coalesce(F.sum(F.col("allow") + F.col("block")), F.lit(0))).first()[0]
    least = max(1, -(-total // support))
    enough = F.col("allow") + F.col("block") >= least
    kept = cells.filter(enough).select("cell", "allow", "block").toArrow()
    sums = []
    for c in ("allow", "block"):
        kinds, all_, own = F.count_if(F.col(c) > 0), F.sum(c), F.coalesce(F.sum(F.when(enough, F.col(c))), F.lit(0))
        sums += [(all_ + kinds).alias(f"{c}_all"), (kinds + all_ - own).alias(f"{c}_rest"), all_.alias(f"{c}_n")]
    contexts = cells.groupBy(context(F.col("cell")).alias("context")).agg(*sums).filter(F.col("allow_n") + F.col("block_n") >= least)
    return Ratio(contexts.drop("allow_n", "block_n").toArrow(), kept)


def filter_urls(pages: DataFrame, rules=RULES, bins: int = 4096, support: int = SUPPORT) -> DataFrame:
    """Judge every url: by the longest rule that fits, else by the models.

    The rules' verdicts label the urls that they cover. Four in five of these
    (by crc32) give counts of bytes and their up to five predecessors, summed
    over all of them; contexts grow as long as the counts support them. The
    others calibrate: of ``bins`` cuts of their length-normalised log-likelihood
    difference the one with the highest mean of both classes' hit rates, the
    one nearest 0 among equals. A url without a rule is allowed at or above it.
    Where the calibrating part lacks a class, the cut is 0. Where all labelled
    urls are of one class, every url without a rule gets it; where there are
    none, it is allowed.

    Returns page_id, host, path, rule, verdict, score, one row per row; null ids,
    repeated rows and very long urls are judged like any other, an empty table
    gives no rows, other columns are ignored, whatever their names. A null url
    or one without ``://`` has empty host and path and no rule, and is judged
    by the models on the empty text, that is by a score of 0.
    """
    d = columns(pages, "page_id", "url")
    host, path = host_and_path(F.col("url"))
    d = d.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    d = d.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), F.concat("host", "path").alias("text"))
    told = d.filter("by_rule is not null").select("text", (F.col("by_rule") == "allow").alias("allow"), (F.crc32("text") % 5 == 0).alias("held"))
    n = told.agg(F.count_if("allow").alias("allow"), F.count_if(~F.col("allow")).alias("block")).first()
    model = pages.sparkSession.sparkContext.broadcast(learned(store(counted(told.filter("not held")), "cells"), support))
    top = 8.0

    def histogram(batches):
        for b in batches:
            s = model.value.scored([t.encode() for t in b.column(0).to_pylist()])
            at = np.clip(((s + top) / (2 * top) * bins).astype(np.int64), 0, bins - 1)
            both, times = np.unique(at * 2 + b.column(1).to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(times)], names=["bin", "n"])

    seen = told.filter("held").select("text", "allow").mapInArrow(histogram, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros(2 * bins)
    held[seen["bin"].to_numpy(int)] = seen["n"]
    block, allow = held[0::2], held[1::2]
    if not n["allow"] or not n["block"]:
        cut = np.inf if n["block"] else -np.inf
    else:
        cut = _cut(allow, block, bins, top) if allow.sum() and block.sum() else 0.0

    def judge(batches):
        for b in batches:
            s = model.value.scored([t.encode() for t in b.column(5).to_pylist()])
            v = pa.array(np.where(s >= cut, "allow", "block").tolist(), pa.string())
            row = [*b.columns[:4], pc.coalesce(b.column(4), v), pa.array(s)]
            yield pa.RecordBatch.from_arrays(row, names=["page_id", "host", "path", "rule", "verdict", "score"])

    kind = dict(d.dtypes)["page_id"]
    return d.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def _cut(allow: np.ndarray, block: np.ndarray, bins: int, top: float) -> float:
    hit = 1 - np.concatenate([[0], np.cumsum(allow)]) / allow.sum() + np.concatenate([[0], np.cumsum(block)]) / block.sum()
    cuts = np.arange(bins + 1) / bins * 2 * top - top
    best = np.flatnonzero(hit >= hit.max() - 1e-12)
    return float(cuts[best[np.argmin(np.abs(cuts[best]))]])
