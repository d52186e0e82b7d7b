"""SentencePiece models run by the tokenizers library."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import numbered, place

MARK = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6  # piece types of the model file
UNIGRAM, BPE = 1, 2
#: Distinct chunks whose ids a task keeps; beyond it the cache starts anew.
CACHE = 200_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) fields of a protobuf message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class Model:
    """What a SentencePiece model file says: pieces with scores and types, and
    the settings of its trainer and normaliser that encoding depends on."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normal = {}, {}
        for number, value in _fields(raw):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.name = normal.get(1, b"").decode()
        self.charsmap = normal.get(2, b"")
        self.dummy_prefix = bool(normal.get(3, 1))
        self.squeeze = bool(normal.get(4, 1))
        self.escape = bool(normal.get(5, 1))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def splits_at_mark(self) -> bool:
        """Whether no piece holds the marker after another character, so that text
        cut before each run of markers encodes to the same ids."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind == NORMAL)

    def tokenizer(self):
        """The model rebuilt for the tokenizers library."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        elif self.kind == BPE:
            model = models.BPE(vocabulary, self._merges(vocabulary), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        t = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        t.normalizer = normalizers.Sequence(steps)
        ends = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        t.decoder = decoders.Sequence(ends + [decoders.Strip(" ", 1, 0)] * self.dummy_prefix)
        return t

    def _merges(self, vocabulary: dict[str, int]) -> list[tuple[str, str]]:
        """Every way to join two pieces into a third, best score first: the order
        in which the file's scores make SentencePiece merge."""
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                cuts = ((piece[:i], piece[i:]) for i in range(1, len(piece)))
                own = sorted((vocabulary[a], vocabulary[b], a, b) for a, b in cuts if a in vocabulary and b in vocabulary)
                found += [(-score, n, a, b) for n, (_, _, a, b) in enumerate(own)]
        found.sort(key=lambda m: m[0])
        return [(a, b) for _, _, a, b in found]


def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


_CHUNK = re.compile(" +[^ ]*")


class Codec:
    """Encodes and decodes batches of texts.

    Where the model allows it a text is cut before each run of spaces and every
    distinct chunk goes through the library once per task, many chunks to a
    string and many strings to a batch, which the library spreads over its
    threads; a token that begins with the marker begins a chunk. Each string
    is decoded again and compared, which settles the round trip of every text
    built from its chunks.
    """

    TOGETHER = 64  # chunks of one space to a string

    def __init__(self, model: Model):
        self.model, self.backend = model, model.tokenizer()
        self.chunked = model.splits_at_mark and model.escape and model.dummy_prefix and not model.squeeze and not model.charsmap
        self.begins = np.array([p.startswith(MARK) for p, _, _ in model.pieces])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.length, self.good = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.flat = np.zeros(0, np.int32)

    def _through(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        ids = [e.ids for e in self.backend.encode_batch_fast(texts, add_special_tokens=False)]
        ids = [i if t else [self.backend.token_to_id(MARK)] for i, t in zip(ids, texts)] if self.chunked else ids
        return ids, [a == b for a, b in zip(self.decode(ids), texts)]

    def _learn(self, new: list[str]) -> None:
        plain = [c for c in new if len(c) > 1 and c[1] != " "]
        blocks = [plain[i : i + self.TOGETHER] for i in range(0, len(plain), self.TOGETHER)]
        order, lengths, flat, good = [], [], [], []
        single = [c for c in new if len(c) == 1 or c[1] == " "]
        for block, ids, same in zip(blocks, *self._through(["".join(b)[1:] for b in blocks])):
            ids = np.array(ids, np.int32)
            at = np.flatnonzero(self.begins[ids])
            if same and len(at) == len(block):
                order += block
                lengths.append(np.diff(np.append(at, len(ids))))
                flat.append(ids)
                good.append(np.ones(len(block), bool))
            else:
                single += block
        for c, ids, same in zip(single, *self._through([c[1:] for c in single])):
            order.append(c)
            lengths.append(np.array([len(ids)]))
            flat.append(np.array(ids, np.int32))
            good.append(np.array([same]))
        if not order:
            return
        lengths = np.concatenate(lengths)
        self.known.update(zip(order, range(len(self.length), len(self.length) + len(order))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.good = np.concatenate([self.good, *good])
        self.flat = np.concatenate([self.flat, *flat])

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets, ids of all texts end to end, and which texts they decode to again."""
        if not self.chunked:
            ids, same = self._through(texts)
            return np.concatenate([[0], np.cumsum([len(i) for i in ids])]), np.array(list(chain.from_iterable(ids)), np.int32), np.array(same, bool)
        # The model turns spaces into its marker, so a marker of the text's own counts as a space.
        cut = [_CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        n = np.array([len(c) for c in cut], np.int64)
        at = list(map(self.known.get, chain.from_iterable(cut)))
        if None in at:
            new = {c for c, k in zip(chain.from_iterable(cut), at) if k is None}
            if len(self.known) + len(new) > CACHE:
                self._forget()
                new = set(chain.from_iterable(cut))
            self._learn(sorted(new))
            at = list(map(self.known.get, chain.from_iterable(cut)))
        at = np.array(at, np.int64)
        length = self.length[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.start[at] - ends[:-1], length)]
        bad = np.bincount(np.repeat(np.arange(len(texts)), n), ~self.good[at], len(texts)) if len(at) else np.zeros(len(texts))
        return ends[np.concatenate([[0], np.cumsum(n)])], ids, (bad == 0) & np.array([MARK not in t for t in texts], bool)

    def encode(self, texts: Iterable[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of each text, and whether they decode to the text again."""
        ends, ids, same = self.encode_flat(list(texts))
        return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])], same.tolist()

    def decode(self, ids: Iterable[list[int]]) -> list[str]:
        return self.backend.decode_batch([list(i) for i in ids], skip_special_tokens=False)


#: Characters of text that are encoded at a time.
BATCH = 1 << 19


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), batch: int = BATCH) -> DataFrame:
    """Ids of every whole text under the SentencePiece model at ``path``, a file
    that the driver reads and ships to the executors with the job.

    Returns the columns ``keep``, ids array<int>, n_tokens int, and round_trip
    boolean: whether the ids decode to the text, byte for byte. Null text: all
    three null. Empty text: no ids, true. A text that holds the marker U+2581
    decodes with a space in its place: false. Very long texts are encoded in
    one piece; ``batch`` bounds how many characters wait at a time, save one
    text. Null or repeated ids and repeated rows are encoded each for itself; an
    empty table gives no rows. Other columns are dropped, whatever their names;
    kept columns named like one of the three new ones give way to it.
    """
    with open(path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    keep = tuple(k for k in keep if k not in ("ids", "n_tokens", "round_trip"))
    kinds = dict(docs.dtypes)
    frame = numbered(docs).select(*[F.col(place(docs, k)) for k in keep], F.col(place(docs, "text")))
    frame = frame.toDF(*[f"k{i}" for i in range(len(keep))], "text")
    fields = [pa.field("ids", pa.list_(pa.int32())), pa.field("n_tokens", pa.int32()), pa.field("round_trip", pa.bool_())]
    n = len(keep)

    def run(batches):
        os.environ.setdefault("RAYON_NUM_THREADS", "2")  # the library's threads, beside those of other tasks
        codec = Codec(Model(raw.value))
        for b in batches:
            texts = b.column(n)
            start = 0
            while start < b.num_rows:
                stop, size = start, 0
                while stop < b.num_rows and (stop == start or size < batch):
                    size += len(texts[stop].as_py() or "")
                    stop += 1
                part = texts.slice(start, stop - start)
                ends, ids, same = codec.encode_flat(part.fill_null("").to_pylist())
                null = part.is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids), mask=pa.array(null))
                columns = [lists, pa.array(np.diff(ends).astype(np.int32), mask=null), pa.array(same, mask=null)]
                yield pa.RecordBatch.from_arrays([b.column(k).slice(start, stop - start) for k in range(n)] + columns, schema=pa.schema([b.schema.field(k) for k in range(n)] + fields))
                start = stop

    shape = [f"k{i} {kinds[k]}" for i, k in enumerate(keep)] + ["ids array<int>", "n_tokens int", "round_trip boolean"]
    return frame.mapInArrow(run, ", ".join(shape)).toDF(*keep, "ids", "n_tokens", "round_trip")


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Texts of the column ids again, beside the columns ``keep``; null ids: null."""
    with open(path, "rb") as f:
        raw = encoded.sparkSession.sparkContext.broadcast(f.read())
    n = len(keep)

    def run(batches):
        codec = Codec(Model(raw.value))
        for b in batches:
            ids = b.column(n).to_pylist()
            texts = iter(codec.decode(i for i in ids if i is not None))
            out = pa.array([None if i is None else next(texts) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(n)] + [out], schema=pa.schema([b.schema.field(k) for k in range(n)] + [pa.field("text", pa.string())]))

    kinds = dict(encoded.dtypes)
    return encoded.select(*[F.col(f"`{k}`") for k in keep], "ids").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", text string")
