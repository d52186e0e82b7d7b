"""Language identification by segmentation-marginalised unigrams."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import columns, store
from tidelog.llm.pieces import MARK, NORMAL, load

#: A language is learned from this share of its documents, from about so many where
#: the share is less; passes of expectation-maximisation.
SHARE, PER_LANGUAGE, PASSES = 1 / 8, 600, 2
#: Words and characters of words whose scores a task keeps; beyond it the cache starts anew.
CACHE, CACHED = 200_000, 1 << 24
UNKNOWN = 1e-6
#: Steps after which forward and backward sums are scaled.
SCALED = 8

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _class(kinds: str) -> str:
    """The characters of some general categories, as ranges of a regular expression."""
    ranges, last = [], -2
    for i in range(sys.maxunicode + 1):
        if unicodedata.category(chr(i))[0] in kinds:
            if i != last + 1:
                ranges.append([i, i])
            ranges[-1][1] = last = i
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


_LETTERS: list[re.Pattern] = []


def words(text: str | None) -> list[str]:
    """Lower-cased words: a letter (category L) and the letters and marks (M) after it."""
    if not _LETTERS:
        letter = _class("L")
        _LETTERS.extend((re.compile(f"[{letter}]+"), re.compile(f"[{letter}][{letter}{_class('M')}]*")))
    text = (text or "").lower()
    # the first mark is U+0300; most texts have no character beyond, but for dashes and quotes
    return _LETTERS[not _BELOW.fullmatch(text)].findall(text)


_BELOW = re.compile(r"[\x00-\u02ff\u2000-\u206f\u20a0-\u20bf]*")


class Vocabulary:
    """The fixed pieces, found by the hash of a substring."""

    def __init__(self, pieces: list[str]):
        known = {}
        for p in pieces:
            p = MARK + p.lstrip(MARK) if p.startswith(MARK) else p
            if p.strip(MARK):
                known.setdefault(self._hash(p), (len(known), len(p)))
        self.longest = max((n for _, n in known.values()), default=1)
        self.size = len(known)
        self.keys = np.array(sorted(known), np.uint64)
        self.ids = np.array([known[int(k)][0] for k in self.keys], np.int64)
        self.power = np.array([pow(int(_BASE), i, 1 << 64) for i in range(self.longest + 1)], np.uint64)

    @staticmethod
    def _hash(piece: str) -> int:
        h, base = 0, int(_BASE)
        for c in piece:
            h = (h * base + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def spans(self, chosen: list[str]):
        """For words of one length: their length with the marker, and a function
        that gives for each end the first start and the pieces' numbers by start
        (``size`` where the substring is no piece, ``size + 1`` for such a single
        character)."""
        n = len(chosen[0]) + 1
        code = np.array([MARK + w for w in chosen], f"<U{n}").view(np.uint32).reshape(len(chosen), n).astype(np.uint64)
        pre = np.zeros((len(chosen), n + 1), np.uint64)
        for j in range(n):
            pre[:, j + 1] = pre[:, j] * _BASE + code[:, j] + np.uint64(1)

        def at(j: int) -> tuple[int, np.ndarray]:
            first = max(0, j - self.longest)
            h = pre[:, j : j + 1] - pre[:, first:j] * self.power[j - np.arange(first, j)]
            if not self.size:
                ids = np.zeros(h.shape, np.int64)
            else:
                found = np.searchsorted(self.keys, h)
                found[found == self.size] = 0
                ids = np.where(self.keys[found] == h, self.ids[found], self.size)
            ids[:, -1][ids[:, -1] == self.size] = self.size + 1
            return first, ids

        return n, at


class Unigrams:
    """Piece probabilities of each language, and sums over all segmentations."""

    def __init__(self, vocabulary: Vocabulary, languages: list[str], probability: np.ndarray | None = None):
        self.vocabulary, self.languages = vocabulary, languages
        if probability is None:
            probability = np.full((vocabulary.size, len(languages)), 1 / max(1, vocabulary.size))
        tail = np.zeros((2, len(languages)))
        tail[1] = UNKNOWN
        self.table = np.concatenate([probability, tail])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows, self.held = np.zeros((1024, len(self.languages))), 0

    def _groups(self, chosen: list[str]):
        """Positions of words of one length, a bounded number of characters at a time."""
        order = np.argsort([len(w) for w in chosen], kind="stable")
        start = 0
        while start < len(order):
            n, stop = len(chosen[order[start]]), start
            most = max(1, (1 << 18) // ((n + 1) * max(1, len(self.languages))))
            while stop < len(order) and stop - start < most and len(chosen[order[stop]]) == n:
                stop += 1
            yield order[start:stop]
            start = stop

    def _forward(self, n: int, at, table: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Forward sums a and the logs s of their scales, by position: a exp(s) is
        the probability of all segmentations up to there. Every few steps what
        later steps need is scaled, so words of any length neither under- nor
        overflow."""
        a, s = np.zeros((n + 1, count, table.shape[1])), np.zeros((n + 1, count, table.shape[1]))
        a[0] = 1
        for j in range(1, n + 1):
            first, ids = at(j)
            a[j] = np.einsum("kwl,wkl->wl", a[first:j], table[ids])
            s[j] = s[j - 1]
            if j % SCALED == 0:
                since = max(0, j + 1 - self.vocabulary.longest)
                m = a[since : j + 1].max(0)
                a[since : j + 1] /= m
                s[since : j + 1] += np.log(m)
        return a, s

    def likelihood(self, chosen: list[str]) -> np.ndarray:
        """Log of the summed probability of all segmentations, per word and language."""
        out = np.zeros((len(chosen), len(self.languages)))
        for k in self._groups(chosen):
            n, at = self.vocabulary.spans([chosen[i] for i in k])
            a, s = self._forward(n, at, self.table, len(k))
            out[k] = np.log(a[-1]) + s[-1]
        return out

    def expected(self, chosen: list[str], counts: np.ndarray, language: int) -> np.ndarray:
        """Expected piece counts of one language, each word counted as often as said."""
        total, table = np.zeros(len(self.table)), self.table[:, language : language + 1]
        for k in self._groups(chosen):
            n, at = self.vocabulary.spans([chosen[i] for i in k])
            a, s = (x[:, :, 0] for x in self._forward(n, at, table, len(k)))
            whole = np.log(a[-1]) + s[-1]
            b, r = np.zeros_like(a), np.zeros(len(k))  # backward sums, with one scale for all that are still needed
            b[n] = 1
            found, shares = [], []
            for j in range(n, 0, -1):
                if j % SCALED == 0:
                    m = b[j].copy()
                    r += np.log(m)
                    b[max(0, j - self.vocabulary.longest) : j + 1] /= m
                first, ids = at(j)
                share = table[ids, 0] * b[j][:, None]
                b[first:j] += share.T
                scale = np.exp(s[first:j] + (r - whole)[None, :])
                shares.append((share * (a[first:j] * scale).T * counts[k][:, None]).ravel())
                found.append(ids.ravel())
            total += np.bincount(np.concatenate(found), np.concatenate(shares), len(total))
        return total[:-2]

    def totals(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-likelihood of each text per language, and its number of words."""
        cut = [words(t) for t in texts]
        new = list({w for c in cut for w in c if w not in self.known})
        if len(self.known) + len(new) > CACHE or self.held > CACHED:
            self._forget()
            new = list({w for c in cut for w in c})
        if new:
            first = len(self.known)
            self.known.update((w, first + i) for i, w in enumerate(new))
            self.held += sum(map(len, new))
            while len(self.rows) < len(self.known):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first : first + len(new)] = self.likelihood(new)
        out, n = np.zeros((len(cut), len(self.languages))), np.array([len(c) for c in cut], np.int64)
        get = self.known.__getitem__
        for i, c in enumerate(cut):
            if c:
                out[i] = self.rows[np.fromiter(map(get, c), np.int64, len(c))].sum(0)
        return out, n


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, path: str, share: float = SHARE, per_language: int = PER_LANGUAGE, passes: int = PASSES, smooth: float = 0.05) -> Unigrams:
    """Learn each language's piece probabilities from ``share`` of its documents, or
    about ``per_language`` where that is more, drawn by hash among those whose
    crc32(doc_id) mod 4 is not 2: what is learned from grows with the input.

    Their whole texts are counted to words on the executors, and each pass of
    expectation-maximisation over all segmentations of these words runs there
    too; the driver gets one number per piece and language.
    """
    spark = docs.sparkSession
    told = docs.filter("lang is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in told.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    vocabulary = Vocabulary([p for p, _, kind in load(path).pieces if kind == NORMAL])
    if not languages:
        return Unigrams(vocabulary, [])
    part = [F.lit(min(1.0, max(share, per_language / sizes[x]))) for x in languages]
    part = F.element_at(F.map_from_arrays(F.array(*[F.lit(x) for x in languages]), F.array(*part)), F.col("lang"))
    drawn = told.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20)).select("lang", "text")
    number = {x: i for i, x in enumerate(languages)}

    def count(batches):
        for b in batches:
            c = Counter()
            for lang, t in zip(b["lang"], b["text"]):
                k = number[lang]
                c.update((w, k) for w in words(t))
            yield pd.DataFrame([(w, k, n) for (w, k), n in c.items()], columns=["word", "lang", "n"])

    seen = drawn.mapInPandas(count, "word string, lang int, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    seen = store(seen, "words")
    model = Unigrams(vocabulary, languages)
    for _ in range(passes):
        held = spark.sparkContext.broadcast(model)

        def expect(batches, held=held):
            total = np.zeros((held.value.vocabulary.size, len(held.value.languages)))
            for b in batches:
                lang, n, chosen = b.column(1).to_numpy(), b.column(2).to_numpy().astype(float), np.array(b.column(0).to_pylist(), object)
                for k in np.unique(lang):
                    mine = lang == k
                    total[:, k] += held.value.expected(chosen[mine].tolist(), n[mine], int(k))
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(k), pa.array(total[piece, k])], names=["piece", "lang", "n"])

        got = seen.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        held.unpersist()
        table = np.full((vocabulary.size, len(languages)), smooth)
        table[got["piece"].to_numpy(int), got["lang"].to_numpy(int)] += got["n"].to_numpy()
        model = Unigrams(vocabulary, languages, table / table.sum(0))
    return model


def identify(docs: DataFrame, path: str, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``.

    A text is lower-cased and cut into words, a letter (category L*) with all
    letters and marks that follow it; each word, of any length, with the word
    marker before it, is scored under each language by the sum over all its
    segmentations into pieces of the fixed vocabulary at ``path``, a character
    in no piece counting as one of probability 1e-6. ``lang_pred`` has the
    largest product over the whole text, ``score`` its share of all languages'
    products (equal priors); among equals the first by name. Null texts and
    texts without a letter, and all texts if no language could be learned, get
    ``und`` and 0. Null ids are not held out and never learned from; null
    languages are never learned. Repeated rows are judged each for itself; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    docs = columns(docs, "doc_id", "text", "lang")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, path, **options))

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model.value
        for texts in batches:
            parts = []
            for i in range(0, len(texts), 500):
                total, n = m.totals(texts.iloc[i : i + 500])
                if not m.languages:
                    parts.append(pd.DataFrame({"lang_pred": ["und"] * len(n), "score": 0.0}))
                    continue
                best = total.argmax(1)
                share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                parts.append(pd.DataFrame({"lang_pred": np.where(n > 0, np.array(m.languages, object)[best], "und"), "score": np.where(n > 0, share, 0.0)}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": [], "score": []})

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), judge(F.col("text")).alias("j"))
    return out.select("doc_id", "held_out", "j.lang_pred", "j.score")
