"""Toxicity: gradient-boosted trees over dense features, calibrated isotonically."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import columns, numbered, place, store

SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
#: Lexicon entries are whole words and word beginnings of these lengths.
STEMS = (4, 5)
FOLDS = 5
#: Labelled rows that the classifier is fitted on, at most; its lexicon comes from these.
SAMPLE = 20_000
#: Tokens whose lexicon entries a task keeps; beyond it the cache starts anew.
CACHE = 400_000

_TOKEN = re.compile(r"\w+")
#: What stands between two letters in an obfuscated word.
_OBFUSCATED = re.compile(r"[@$*#0-9.\-_](?<=[^\W\d_].)(?:(?<=[@$*#0-9])[@$*#0-9]*[^\W\d_]|(?<=[.\-_])(?=[^\W\d_][.\-_])[^\W\d_])")
_PUNCTUATION = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~", np.uint8))


def entries(text: str) -> set[str]:
    """What of a text may become a lexicon entry; beginnings end in ``*``."""
    tokens = set(_TOKEN.findall(text.lower()))
    found = set(tokens)
    for n in STEMS:
        found.update(w[:n] + "*" for w in tokens if len(w) > n)
    return found


class Describer:
    """Dense features of whole texts under a lexicon. What the lexicon says of a
    token is looked up once per task."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self._forget()

    def _forget(self) -> None:
        # per token: its entry's number or -1, the entry's weight, 0 for words and 1, 2, ... for beginnings, second person
        self.known, self.kinds = {}, {}
        self.kind, self.weight, self.stem, self.person = np.full(1024, -1), np.zeros(1024), np.zeros(1024, np.int8), np.zeros(1024, bool)

    def _learn(self, token: str) -> int:
        k = self.known[token] = len(self.known)
        if k == len(self.kind):
            fill = (np.full(k, -1), np.zeros(k), np.zeros(k, np.int8), np.zeros(k, bool))
            self.kind, self.weight, self.stem, self.person = (np.concatenate(c) for c in zip((self.kind, self.weight, self.stem, self.person), fill))
        self.person[k] = token in SECOND_PERSON
        for n, entry in [(0, token), *((n + 1, token[:size] + "*") for n, size in enumerate(STEMS) if len(token) > size)]:
            if (weight := self.lexicon.get(entry)) is not None:
                self.kind[k], self.weight[k], self.stem[k] = self.kinds.setdefault(entry, len(self.kinds)), weight, n
                break
        return k

    def features(self, text: str | None) -> list[float]:
        """The features of a text; all zero for null and empty texts."""
        text = text or ""
        low = text.lower()
        tokens = _TOKEN.findall(low)
        if len(self.known) > CACHE:
            self._forget()
        at = list(map(self.known.get, tokens))
        if None in at:
            at = [self._learn(t) if (k := self.known.get(t)) is None else k for t in tokens]
        at, n = np.array(at, np.int64), max(1, len(tokens))
        hits = np.flatnonzero(self.kind[at] >= 0)
        found = at[hits]
        stems = np.bincount(self.stem[found], minlength=len(STEMS) + 1)
        weight = float(self.weight[found].sum())
        person = np.concatenate([[0], np.cumsum(self.person[at])])
        near = int((person[np.minimum(hits + 4, len(at))] > person[np.maximum(hits - 3, 0)]).sum())
        code = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        size = max(1, int(raw.sum()))
        return [
            stems[0] / n, stems[1:].sum() / n, len(hits) / n, weight / n, float(stems[0]), float(stems[1:].sum()), float(len(np.unique(self.kind[found]))), weight,
            near / n, person[-1] / n, raw[65:91].sum() / size, raw[33] / size, raw[63] / size, raw[_PUNCTUATION].sum() / size,
            sum(1 for _ in _OBFUSCATED.finditer(text)) / n, _repeated(code) / n, raw[48:58].sum() / size, size / n, float(np.log1p(n)),
        ]


def _repeated(code: np.ndarray) -> int:
    """How often a letter stands three times in a row."""
    if len(code) < 3:
        return 0
    same = np.flatnonzero((code[2:] == code[1:-1]) & (code[1:-1] == code[:-2]))
    return sum(1 for i in same if chr(code[i]).isalpha())


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    return Describer(lexicon).features(text)


WIDTH = len(features("", {}))


@dataclass
class Trees:
    """Boosted trees of one depth for the logistic loss, over quantile bins."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 64
    ridge: float = 1.0
    start: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        self.start = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T)], 1)
        score, (rows, wide), deep = np.full(len(y), self.start), x.shape, 2**self.depth
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            node = np.zeros(rows, np.int64)
            column, at = np.full(deep - 1, -1), np.zeros(deep - 1)
            for level in range(self.depth):
                many = 2**level
                gain, where = np.full(many, 1e-6), np.full((many, 2), -1)
                for f in range(wide):
                    if not len(cuts[f]):
                        continue
                    key, size = node * self.bins + b[:, f], many * self.bins
                    gs = np.bincount(key, g, size).reshape(many, -1).cumsum(1)
                    hs = np.bincount(key, h, size).reshape(many, -1).cumsum(1)
                    gr, hr = gs[:, -1:] - gs, hs[:, -1:] - hs
                    value = gs**2 / (hs + self.ridge) + gr**2 / (hr + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    value = np.where((hs > 0.5) & (hr > 0.5), value, -1)[:, : len(cuts[f])]
                    best = value.argmax(1)
                    more = value[np.arange(many), best] > gain
                    gain[more] = value[np.arange(many), best][more]
                    where[more] = np.stack([np.full(many, f), best], 1)[more]
                right = np.zeros(rows, np.int64)
                for k in range(many):
                    f, cut = where[k]
                    if f >= 0:
                        column[many - 1 + k], at[many - 1 + k] = f, cuts[f][cut]
                        right[node == k] = b[node == k, f] > cut
                node = node * 2 + right
            leaf = self.rate * np.bincount(node, g, deep) / (np.bincount(node, h, deep) + self.ridge)
            self.trees.append((column, at, leaf))
            score += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for column, at, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                k = 2**level - 1 + node
                f = column[k]
                node = node * 2 + ((f >= 0) & (x[np.arange(len(x)), f] >= at[k]))
            score += leaf[node]
        return score


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit of y on x by pooling adjacent violators;
    returns the knots (x of the pools' ends, fitted value)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, count, first x, last x
    for v, t in zip(x[order], y[order]):
        pools.append([float(t), 1.0, float(v), float(v)])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
            s, n, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = last
    knots = np.array([e for s, n, a, b in pools for e in ((a, s / n), (b, s / n))])
    return knots[:, 0], knots[:, 1]


@dataclass
class Scorer:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    prior: float
    describer: Describer | None = None

    def score(self, texts) -> np.ndarray:
        """Calibrated probability; a thousandth of the raw one keeps the order inside a pool."""
        if self.trees is None:
            return np.full(len(texts), self.prior)
        if self.describer is None:
            self.describer = Describer(self.lexicon)
        raw = self.trees.raw(np.array([self.describer.features(t) for t in texts]).reshape(-1, WIDTH))
        return 0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw))


def _log_odds(pos, neg, pos_all, neg_all):
    return np.log((pos + 0.5) / (pos_all + 1)) - np.log((neg + 0.5) / (neg_all + 1))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, support: int = 3, edge: float = 1.5) -> Scorer:
    """Learn from at most ``sample`` labelled rows whose crc32(doc_id) mod 5 is not 0,
    chosen by hash of the id; of rows that agree in id and text one.

    Lexicon entries are words and word beginnings found in ``support`` toxic
    rows at least, with log-odds of ``edge`` or more. Rows are in five folds by hash of the text, so copies share one. A
    training row's features use the lexicon of the other folds; the isotonic
    map is fitted on scores of trees that did not see the row's fold.
    """
    spark = docs.sparkSession
    key = F.col("doc_id").cast("string")
    docs, labels = columns(docs, "doc_id", "text"), columns(labels, "doc_id", "toxic")
    told = labels.filter("doc_id is not null and toxic is not null").filter(F.crc32(key) % 5 != 0)
    told = told.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.withColumn("at", F.xxhash64("doc_id", "text")).join(F.broadcast(told), "doc_id")  # at most `sample` ids
    chosen = rows.select("at", "doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "at").limit(sample)
    chosen = store(chosen.select(F.col("at").alias("chosen"), "toxic"), "chosen")  # and at most `sample` rows
    rows = docs.withColumn("at", F.xxhash64("doc_id", "text")).join(F.broadcast(chosen), F.col("at") == F.col("chosen")).dropDuplicates(["at"])
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = store(rows.select("at", "text", (F.col("toxic") > 0).cast("int").alias("y"), fold), "labelled")
    sizes = rows.groupBy("fold", "y").count().toPandas()
    n = np.zeros((FOLDS, 2))
    n[sizes["fold"], sizes["y"]] = sizes["count"]
    prior = float(n[:, 1].sum() / n.sum()) if n.sum() else 0.0
    nothing = Scorer({}, None, (np.zeros(2), np.zeros(2)), prior)
    if not n[:, 0].sum() or not n[:, 1].sum():
        return nothing

    def count(batches):
        for b in batches:
            c = Counter()
            for t, f, y in zip(b["text"], b["fold"], b["y"]):
                c.update((e, f * 2 + y) for e in entries(t or ""))
            yield pd.DataFrame([(e, k, v) for (e, k), v in c.items()], columns=["entry", "cell", "n"])

    found = rows.mapInPandas(count, "entry string, cell int, n long").groupBy("entry")
    cells = [F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(2 * FOLDS)]
    found = found.agg(*cells).withColumn("pos", sum(F.col(f"c{k}") for k in range(1, 2 * FOLDS, 2))).withColumn("neg", sum(F.col(f"c{k}") for k in range(0, 2 * FOLDS, 2)))
    odds = F.log((F.col("pos") + 0.5) / (n[:, 1].sum() + 1)) - F.log((F.col("neg") + 0.5) / (n[:, 0].sum() + 1))
    found = found.withColumn("odds", odds).filter((F.col("pos") >= support) & (F.col("odds") >= edge))
    best = found.toPandas()  # entries of `support` of at most `sample` rows
    counts = best[[f"c{k}" for k in range(2 * FOLDS)]].to_numpy(float).reshape(-1, FOLDS, 2)

    def without(fold: int | None) -> dict[str, float]:
        kept = [f for f in range(FOLDS) if f != fold]
        neg, pos = counts[:, kept].sum(1).T
        odds = _log_odds(pos, neg, n[kept, 1].sum(), n[kept, 0].sum())
        return {e: float(o) for e, o, p in zip(best["entry"], odds, pos) if p >= support - (fold is not None) and o >= edge}

    lexicons = spark.sparkContext.broadcast([without(f) for f in range(FOLDS)])

    def describe(batches):
        by_fold = [Describer(x) for x in lexicons.value]
        for b in batches:
            x = [by_fold[f].features(t) for t, f in zip(b["text"], b["fold"])]
            yield pd.DataFrame({"at": b["at"], "fold": b["fold"], "y": b["y"], "x": x})

    seen = rows.mapInPandas(describe, "at long, fold int, y int, x array<double>").toPandas().sort_values(["at", "y"])
    x, y, folds = np.stack(seen["x"].to_numpy()), seen["y"].to_numpy(float), seen["fold"].to_numpy()
    out = np.full(len(y), np.nan)
    for f in range(FOLDS):
        use, held = folds != f, folds == f
        if held.any() and 0 < y[use].sum() < use.sum():
            out[held] = Trees().fit(x[use], y[use]).raw(x[held])
    known = ~np.isnan(out)
    if not known.any():
        return nothing
    return Scorer(without(None), Trees().fit(x, y), isotonic(out[known], y[known]), prior)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """All columns of ``docs`` (but its own of these names) and score double,
    predicted int. Null and empty texts are scored as having no features; very
    long texts are read whole."""
    model = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def toxic(text: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(text))

    names = [n for n in docs.columns if n not in ("score", "predicted")]
    d = numbered(docs).withColumn("score", toxic(F.col(place(docs, "text"))))
    d = d.select(*[place(docs, n) for n in names], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    return d.toDF(*names, "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    ``held_out`` marks rows whose crc32(doc_id as text) mod 5 is 0; their labels
    are never learned from (null ids count as 0: not held out, never learned).
    lang, source and doc_id are no features. Without labels of both classes
    every score is the share of toxic labels, or 0. Repeated ids and rows are
    scored each for itself; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    docs = columns(docs, "doc_id", "text")
    return score(docs.select("doc_id", "text", held), fit(docs, labels, **options)).select("doc_id", "held_out", "score", "predicted")


def reject_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, columns as given, whatever
    their names."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    @F.pandas_udf("double")
    def toxic(text: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(text))

    return numbered(docs).filter(toxic(F.col(place(docs, "text"))) < 0.5).toDF(*docs.columns)
