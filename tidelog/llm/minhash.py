"""MinHash near-dedup by ProbMinHash over weighted word shingles."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import columns, components, discard, numbered, place, store

WORDS, THRESHOLD = 5, 0.8
#: Bands of registers; a pair of probability Jaccard 0.8 shares no band with
#: probability (1 - 0.8^6)^40 = 5e-6.
BANDS, ROWS = 40, 6
#: Nodes up to which a bucket's classes are compared as pairs; the nodes of larger
#: buckets make blocks of about ``BLOCK`` nodes and ``CHARACTERS`` of text, and
#: each two blocks that meet in a bucket are compared at once.
PAIRWISE, BLOCK, CHARACTERS = 24, 256, 8 << 20
#: Hashes of texts that a task remembers to have signed; beyond it it starts anew.
SEEN = 1 << 18
#: Bytes of text worked on at a time.
BATCH = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = np.array([0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_IN_WORD[95] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        one = np.ones(1, np.uint64)
        _POWERS[size] = tuple(np.concatenate([one, np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, _INVERSE))
    return _POWERS[size]


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted shingles as (text number, hash, count), sorted by the first two.

    Words are runs of ASCII letters, digits, ``_`` and any other non-ASCII bytes,
    ASCII lower-cased. A text of fewer than five words has one shingle of all.
    """
    raw = [t.encode("utf-8", "replace") + b" " for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    b = np.frombuffer(b"".join(raw), np.uint8)
    inside = _IN_WORD[b]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(len(b))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[b].astype(np.uint64) + _U(1)) * up[: len(b)])])
    word = _mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
    doc = np.searchsorted(np.cumsum(size), start, "right")
    n = np.bincount(doc, minlength=len(texts))
    at = np.arange(len(word))
    full = at[: max(0, len(word) - WORDS + 1)]
    full = full[doc[full] == doc[full + WORDS - 1]] if len(full) else full
    h = np.zeros(len(full), np.uint64)
    for k in range(WORDS):
        h += word[full + k] * _ODD[k]
    owner = doc[full]
    few = np.flatnonzero((n > 0) & (n < WORDS))
    if len(few):
        first = np.cumsum(n) - n
        own = np.zeros(len(few), np.uint64)
        for k in range(WORDS - 1):
            there = n[few] > k
            own[there] += word[first[few[there]] + k] * _ODD[k]
        owner, h = np.concatenate([owner, few]), np.concatenate([h, own])
    h = _mix(h)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], h[first], np.diff(np.append(first, len(h)))


def registers(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash registers (docs x m): the element of the first arrival in each.

    Every element has a Poisson process of arrivals at the rate of its weight,
    seeded by its hash, each arrival at a register drawn at random. Elements
    of all texts advance by one arrival a round and drop out once they are
    later than their text's latest register, which ends the work early.
    """
    first, who = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)
    n = np.bincount(doc, minlength=docs)
    alone = n[doc] == 1
    who.reshape(docs, m)[doc[alone]] = h[alone][:, None]
    doc, h, rate = doc[~alone], h[~alone], 1.0 / weight[~alone]
    x, latest, step = np.zeros(len(h)), np.full(docs, np.inf), 0
    while len(h):
        step += 1
        r = _mix(h + _U((step * _BASE) & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log(((r >> _U(11)).astype(float) + 0.5) * 2.0**-53) * rate
        keep = x < latest[doc]
        doc, h, rate, x, r = doc[keep], h[keep], rate[keep], x[keep], r[keep]
        if not len(h):
            break
        slot = ((_mix(r ^ _ODD[0]) >> _U(32)) * _U(m)) >> _U(32)
        flat = doc * m + slot.astype(np.int64)
        np.minimum.at(first, flat, x)
        won = first[flat] == x
        who[flat[won]] = h[won]
        some = doc[np.flatnonzero(np.diff(doc, prepend=-1))]
        latest[some] = first.reshape(docs, m)[some].max(1)
    return who.reshape(docs, m)


def bands(who: np.ndarray) -> np.ndarray:
    """One key per text and band."""
    parts = who.reshape(len(who), BANDS, ROWS)
    key = (np.arange(BANDS, dtype=np.uint64) * _ODD[7])[None, :] + np.zeros((len(who), 1), np.uint64)
    for k in range(ROWS):
        key = _mix(key + parts[:, :, k] * _ODD[k])
    return key.view(np.int64)


def similarity(ha, wa, hb, wb) -> float:
    """Probability Jaccard of two weighted sets (sorted hashes and weights): over
    shared elements d, the sum of 1 / sum over e of max(a_e / a_d, b_e / b_d)."""
    shared, ia, ib = np.intersect1d(ha, hb, True, True)
    if not len(shared):
        return 0.0
    xa, xb = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = wa.sum() - xa.sum(), wb.sum() - xb.sum()
    ratios, which = np.unique(xa / xb, return_inverse=True)
    mass = np.bincount(which, xa)
    return float(sum(m / (only_a + r * only_b + np.maximum(xa, r * xb).sum()) for r, m in zip(ratios, mass)))


def _slices(texts: list[str]):
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size < BATCH):
            size += len(texts[stop])
            stop += 1
        yield start, stop
        start = stop


def _sign(batches):
    """Adds the band keys of each text, once per task for equal texts."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        h1, h2, fresh = b.column(1).to_pylist(), b.column(2).to_pylist(), []
        for k in zip(h1, h2):
            fresh.append(k not in seen)
            seen.add(k)
        if len(seen) > SEEN:
            seen.clear()
        new = pa.array(fresh, pa.bool_())
        old = b.filter(pc.invert(new))
        yield pa.RecordBatch.from_arrays([*old.columns[:3], pa.nulls(old.num_rows, pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "keys"])
        b = b.filter(new)
        for start, stop in _slices(texts := b.column(3).to_pylist()):
            part = texts[start:stop]
            doc, h, w = shingles(part)
            n = np.bincount(doc, minlength=len(part))
            keys = bands(registers(doc, h, w, len(part)))
            keys = keys[n > 0].ravel()
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))
            yield pa.RecordBatch.from_arrays([b.column(k).slice(start, stop - start) for k in range(3)] + [lists], names=["doc_id", "h1", "h2", "keys"])


def _verify(batches):
    for b in batches:
        a, c, ta, tc = (b.column(k) for k in range(4))
        ids = [a.to_pylist(), c.to_pylist()]
        seen: dict[int, tuple] = {}
        size, out = 0, []
        for i in range(b.num_rows):
            two = []
            for side, column in ((0, ta), (1, tc)):
                k = ids[side][i]
                if k not in seen:
                    text = column[i].as_py()
                    size += len(text)
                    seen[k] = shingles([text])[1:]
                two += seen[k]
            out.append(similarity(*two) >= THRESHOLD)
            if size > 8 * BATCH:
                seen, size = {}, 0
        yield pa.RecordBatch.from_arrays([a, c], names=["u", "v"]).filter(pa.array(out, pa.bool_()))


def _overlaps(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """For each two texts (row, column): the row's weight on shingles of the column."""
    out = np.zeros((docs, docs), np.float32)
    kinds, which, n = np.unique(h, return_inverse=True, return_counts=True)
    often = np.flatnonzero(n > 1)
    place = np.full(len(kinds), -1)
    place[often] = np.arange(len(often))
    at = place[which]
    for start in range(0, len(often), 8192):
        mine = (at >= start) & (at < start + 8192)
        has = np.zeros((docs, min(8192, len(often) - start)), np.float32)
        has[doc[mine], at[mine] - start] = 1
        heavy = has
        if (weight[mine] > 1).any():
            heavy = has.copy()
            heavy[doc[mine], at[mine] - start] = weight[mine]
        out += heavy @ has.T
    return out


class Block:
    """Nodes with their classes and weighted shingles, as one row to send."""

    def __init__(self, node: np.ndarray, group: np.ndarray, texts: list[str]):
        self.node, self.group = node, group
        self.doc, self.h, self.w = (np.concatenate(c) for c in zip(*self._shingled(texts)))
        self.w = self.w.astype(np.int32)
        self.doc = self.doc.astype(np.int32)

    @staticmethod
    def _shingled(texts: list[str]):
        yield np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for start, stop in _slices(texts):
            doc, h, w = shingles(texts[start:stop])
            yield doc + start, h, w

    @staticmethod
    def both(a: Block, b: Block | None) -> tuple[np.ndarray, ...]:
        """side, node, group, doc, h, w of one block or of two."""
        if b is None:
            return np.zeros(len(a.node), np.int64), a.node, a.group, a.doc.astype(np.int64), a.h, a.w.astype(np.int64)
        join = lambda x, y: np.concatenate([x, y])
        doc = join(a.doc.astype(np.int64), b.doc.astype(np.int64) + len(a.node))
        return join(np.zeros(len(a.node), np.int64), np.ones(len(b.node), np.int64)), join(a.node, b.node), join(a.group, b.group), doc, join(a.h, b.h), join(a.w, b.w).astype(np.int64)


def _compare(a: Block, b: Block | None) -> list[tuple[int, int]]:
    """Similar nodes of different classes within one block or between two: as many
    pairs as join all classes that any similar pair joins."""
    side, node, group, doc, h, w = Block.both(a, b)
    docs = len(node)
    n = np.bincount(doc, w, docs)
    shared = _overlaps(doc, h, w, docs)
    sets = np.bincount(doc, w > 1, docs) == 0
    ask = group[:, None] != group[None, :]
    ask &= np.triu(np.ones_like(ask), 1) if b is None else side[:, None] < side[None, :]
    least = THRESHOLD - 1e-5
    ask &= (shared >= least * n[:, None]) & (shared.T >= least * n[None, :])  # what any such similarity needs
    plain = sets[:, None] & sets[None, :]
    ask &= ~plain | (shared >= THRESHOLD * (n[:, None] + n[None, :] - shared) - 1e-6)
    start = np.searchsorted(doc, np.arange(docs + 1))
    up: dict[int, int] = {}

    def root(c):
        while (d := up.setdefault(c, c)) != c:
            c = d
        return c

    out = []
    for i, j in zip(*np.nonzero(ask)):
        p, q = root(int(group[i])), root(int(group[j]))
        if p != q:
            x, y = slice(start[i], start[i + 1]), slice(start[j], start[j + 1])
            if similarity(h[x], w[x], h[y], w[y]) >= THRESHOLD:
                up[max(p, q)] = min(p, q)
                out.append((int(node[i]), int(node[j])))
    return out


def _pack(group: pa.Table) -> pa.Table:
    node, classes_ = group.column("node").to_numpy(), group.column("class").to_numpy()
    body = pickle.dumps(Block(node, classes_, group.column("text").to_pylist()))
    return pa.table({"block": group.column("block").slice(0, 1), "body": pa.array([body], pa.binary())})


def _block_pair(group: pa.Table) -> pa.Table:
    bodies = [pickle.loads(b.as_py()) for b in group.column("body")]
    found = _compare(bodies[0], bodies[1] if len(bodies) > 1 else None)
    return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough, as (u, v)."""
    p = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    p = p.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return p.select("a", "b", "ta", "tb").mapInArrow(_verify, "u long, v long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 (hash of the text), class_id and kept for each row of ``docs``
    (doc_id, text): see ``near_duplicates``."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    signed = store(d.filter("text is not null").mapInArrow(_sign, "doc_id long, h1 long, h2 long, keys array<long>"), "signed")
    nodes = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.any_value("keys", True).alias("keys"))
    nodes = store(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    every = nodes.select(F.explode("keys").alias("key"), "node")
    buckets = store(every.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    bucketed = store(every.join(buckets, "key").select("key", "node", "lead", "n"), "members")
    star = store(bucketed.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "star")
    near = nodes.join(bucketed.select("node").distinct(), "node", "left_semi").select("node", "rep", "h1", "h2")
    near = near.withColumnsRenamed({"h1": "n1", "h2": "n2"})
    texts = d.join(near, F.expr("h1 = n1 and h2 = n2 and doc_id <=> rep"))
    texts = store(texts.select("node", "text"), "texts")
    first = store(_links(star, texts), "links")

    joined = store(components(first), "classes")
    member = bucketed.join(joined, "node", "left").select("key", "node", "lead", "n", F.coalesce("component", "node").alias("class"))
    classed = store(member, "members")
    mixed = store(classed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("key"), "mixed")
    member = store(classed.join(mixed, "key", "left_semi"), "mixed-members")
    discard(buckets, bucketed, joined, classed)
    few = member.filter(F.col("n") <= PAIRWISE).select("key", "node", "class")
    other = few.select("key", F.col("node").alias("b"), F.col("class").alias("class_b"))
    pairs = few.withColumnRenamed("node", "a").join(other, "key").filter("class < class_b").select("a", "b")
    done = star.select("a", "b").unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = pairs.distinct().join(done, ["a", "b"], "left_anti")
    second = store(_links(store(pairs, "pairs"), texts), "links")
    third = _in_blocks(member.filter(F.col("n") > PAIRWISE), texts)
    discard(texts, member, star)

    joined = components(first.unionByName(second).unionByName(third))
    known = nodes.select("node", "h1", "h2", "rep").join(joined, "node", "left")
    known = store(known.withColumn("component", F.coalesce("component", "node")), "known")
    best = store(known.groupBy("component").agg(F.min("rep").alias("class_id"), F.min_by("node", "rep").alias("best"), F.min("node").alias("any")), "best")
    known = known.join(best, "component").select(F.col("h1").alias("n1"), F.col("h2").alias("n2"), "class_id", (F.col("node") == F.coalesce("best", "any")).alias("leads"))
    known = store(known, "known")
    rows = signed.select("doc_id", "h1", "h2").join(known, F.expr("h1 = n1 and h2 = n2"))
    rows = rows.select("doc_id", "h1", "h2", "class_id", (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))
    rest = d.filter("text is null").select("doc_id", "h1", "h2", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return rows.unionByName(rest)


def _in_blocks(member: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) between classes within large buckets.

    Nodes that large buckets hold together, directly or by others, are a family,
    which is cut by hash into blocks of bounded size. A block is made once, for
    all bands, with the shingles of its texts, and sent as one row to each pair
    of blocks that meet in a bucket; a pair sends back at most one link per
    class it holds. So a family of n nodes whose members mostly aren't similar
    enough takes (n / ``BLOCK``)^2 / 2 pairs of blocks.
    """
    family = components(member.select(F.col("lead").alias("u"), F.col("node").alias("v")))
    node = member.select("node", "class").distinct().join(family, "node").join(texts, "node")
    sizes = node.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("size"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / CHARACTERS))
    sizes = store(sizes.select(F.col("component").alias("f"), blocks.cast("int").alias("blocks")), "families")
    placed = member.select("node").distinct().join(family, "node").join(sizes, F.col("component") == F.col("f"))
    placed = store(placed.select("node", F.xxhash64("component", F.pmod(F.xxhash64("node"), "blocks")).alias("block")), "placed")
    packed = member.select("node", "class").distinct().join(placed, "node").join(texts, "node")
    packed = store(packed.select("block", "node", "class", "text").groupBy("block").applyInArrow(_pack, "block long, body binary"), "blocks")
    at = store(member.select("key", "node").join(placed, "node").select("key", "block").distinct(), "places")
    pairs = at.withColumnRenamed("block", "i").join(at.withColumnRenamed("block", "j"), "key").filter("i <= j").select("i", "j").distinct()
    pairs = store(pairs, "block-pairs")
    sent = pairs.select(F.col("i").alias("block"), "i", "j").unionByName(pairs.filter("i < j").select(F.col("j").alias("block"), "i", "j"))
    out = store(packed.join(sent, "block").select("i", "j", "body").groupBy("i", "j").applyInArrow(_block_pair, "u long, v long"), "links")
    discard(sizes, placed, packed, at, pairs)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and kept of every row: classes of texts linked by a
    probability Jaccard of 0.8 or more over weighted five-word shingles.

    Equal texts are one node. A node's ProbMinHash registers make 40 band keys.
    Nodes of a bucket are first compared with its smallest node, which joins
    near copies by as many comparisons as there are copies; then, in buckets
    that still hold several classes, the nodes of different classes: as pairs
    in buckets of up to ``PAIRWISE`` nodes, block by block in larger ones,
    where shared weight sorts out most pairs at once. Every link rests on the
    exact similarity of whole texts, and no two nodes of a bucket stay
    uncompared unless they are in one class already. Connected components
    are the classes.

    class_id is the smallest doc_id of the class, kept marks that document. A
    null text: its own id, kept. Texts without words are equal only to the same
    text. Texts of fewer than five words have one shingle. Rows that agree in
    id and text get equal rows; a null id takes part, and is kept only in a
    class without other ids. Other columns are ignored, whatever their names;
    an empty table gives no rows.
    """
    return classes(columns(docs, "doc_id", "text")).select("doc_id", "class_id", "kept")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, all columns as given, whatever their
    names; rows with null text stay."""
    d, own, text, key = numbered(docs), [f"c{i}" for i in range(len(docs.columns))], place(docs, "text"), place(docs, "doc_id")
    kept = classes(columns(docs, "doc_id", "text").filter("text is not null")).filter("kept")
    kept = store(kept.select("doc_id", "h1", "h2").distinct(), "kept")
    some = d.filter(f"{text} is not null").withColumns({"x1": F.xxhash64(text), "x2": F.xxhash64(F.lit(1), text)})
    some = some.join(kept, F.expr(f"x1 = h1 and x2 = h2 and cast({key} as bigint) <=> doc_id"))
    nth = F.row_number().over(Window.partitionBy("x1", "x2").orderBy(key))
    some = some.withColumn("nth", nth).filter("nth = 1").select(*own)
    return some.unionByName(d.filter(f"{text} is null")).toDF(*docs.columns)
