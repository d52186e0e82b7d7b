"""Embedding near-dedup by dual traversal of cover trees."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import columns, components, store
from tidelog.llm.vectors import lists, matrices, matrix

#: Vectors a tree; at most so many pivots, in whose cells the trees stand; bytes
#: of trees in a group, about, and groups at least (of a tree's size or more).
PER_TREE, PIVOTS, GROUP, GROUPS = 2048, 1024, 32 << 20, 8
#: Nodes of so few vectors aren't split.
LEAF = 16


def _net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """A greedy net: centres more than ``radius`` apart, and each row's first centre within it."""
    own, centres = np.full(len(x), -1), np.empty(0, np.int64)
    least = 1 - radius**2 / 2  # as an inner product of unit vectors
    for i in range(0, len(x), 256):
        part = np.arange(i, min(i + 256, len(x)))
        if len(centres):
            near = x[part] @ x[centres].T >= least
            hit = near.any(1)
            own[part[hit]] = near[hit].argmax(1)
            part = part[~hit]
        inside = x[part] @ x[part].T >= least
        for k in range(len(part)):
            if own[part[k]] < 0:
                mine = part[k:][inside[k, k:] & (own[part[k:]] < 0)]
                own[mine] = len(centres)
                own[part[k]] = len(centres)
                centres = np.append(centres, part[k])
    return centres, own


class CoverTree:
    """Nested nets of unit vectors with halving radii 1, 1/2, 1/4, ...

    Node n holds the rows first[n] .. last[n] of x (reordered so that this
    works) around row centre[n], all within radius[n]; its children are the
    nodes child[n] .. child[n] + kids[n].
    """

    def __init__(self, ids: np.ndarray, weight: np.ndarray, x: np.ndarray):
        order = np.arange(len(x))
        self.first, self.last, self.centre, self.radius, self.child, self.kids = [0], [len(x)], [0], [2.0], [0], [0]
        todo = [(0, 1.0)]
        while todo:
            node, r = todo.pop()
            a, b = self.first[node], self.last[node]
            if b - a <= LEAF or r < 2**-20:
                continue
            rows = order[a:b]
            centres, own = _net(x[rows], r)
            if len(centres) == 1:
                todo.append((node, r / 2))
                self.centre[node], self.radius[node] = a + int(centres[0]), r
                continue
            by = np.argsort(own, kind="stable")
            order[a:b] = rows[by]
            n = np.bincount(own)
            ends = a + np.cumsum(n)
            self.child[node], self.kids[node] = len(self.first), len(n)
            for e, k in zip(ends.tolist(), n.tolist()):
                if k > LEAF:
                    todo.append((len(self.first), r / 2))
                self.first.append(e - k)
                self.last.append(e)
                self.centre.append(e - k)  # the net takes a centre before the rows it covers
                self.radius.append(r if k > 1 else 0.0)
                self.child.append(0)
                self.kids.append(0)
        self.ids, self.weight, self.x = ids[order], weight[order], x[order]
        for name in ("first", "last", "centre", "radius", "child", "kids"):
            setattr(self, name, np.array(getattr(self, name)))
        for n in range(len(self.first)):  # radii as they are, not as they may be
            if self.radius[n]:
                c = self.x[self.centre[n]]
                self.radius[n] = np.sqrt(((self.x[self.first[n] : self.last[n]] - c) ** 2).sum(1).max())


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def near_cells(t: CoverTree, reach: np.ndarray, far: float) -> list[tuple[int, int, float]]:
    """Dual traversal of the tree of pivots, the upper levels above all trees: pairs
    (ids[i], ids[j], d - far) of cells whose vectors may be ``far`` or less apart,
    by the distance d of the pivots and the cells' ``reach`` (by row) around them."""
    n = len(t.first)
    span = np.array([(_distance(t.x[[t.centre[k]]], t.x[t.first[k] : t.last[k]])[0] + reach[t.first[k] : t.last[k]]).max() for k in range(n)])
    centre, span = np.concatenate([t.centre, np.arange(len(t.x))]), np.concatenate([span, reach])

    def opened(k: int) -> np.ndarray:  # numbers from n on are rows
        if k >= n:
            return np.array([k])
        return np.arange(t.child[k], t.child[k] + t.kids[k]) if t.kids[k] else n + np.arange(t.first[k], t.last[k])

    todo, out = [(0, 0)], []
    while todo:
        p, q = (opened(k) for k in todo.pop())
        d = _distance(t.x[centre[p]], t.x[centre[q]])
        i, j = np.nonzero(d <= span[p][:, None] + span[q][None, :] + far + 1e-7)
        for u, v, w in zip(p[i].tolist(), q[j].tolist(), d[i, j].tolist()):
            if u >= n and v >= n:
                out.append((int(t.ids[u - n]), int(t.ids[v - n]), w - far - 1e-7))
            else:
                todo.append((u, v))
    return out


class Links:
    """Link counts of two trees' rows, and what joins them, without all pairs."""

    def __init__(self, a: CoverTree, b: CoverTree):
        self.a, self.b, self.same = a, b, a is b
        self.n = [np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)]
        self.shift = 0 if self.same else len(a.ids)
        self.up = np.arange(len(a.ids) + (0 if self.same else len(b.ids)))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j + self.shift)
        self.up[max(i, j)] = min(i, j)

    def exact(self, ra: np.ndarray, rb: np.ndarray, least: float, once: bool) -> None:
        """All pairs of two lists of rows, a bounded block at a time, in double
        precision; ``once``: both lists are the same and a pair counts once."""
        for i in range(0, len(ra), 1024):
            p = ra[i : i + 1024]
            for j in range(0, len(rb), 1024):
                q = rb[j : j + 1024]
                if once and p[0] > q[-1]:
                    continue
                hit = self.a.x[p] @ self.b.x[q].T >= least
                if once:
                    hit &= p[:, None] < q[None, :]
                if hit.any():
                    self._count(hit, p, q)

    def _count(self, hit: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        """Adds a block's links, and joins along a spanning part of them."""
        self.n[0][p] += hit @ self.b.weight[q]
        self.n[1][q] += self.a.weight[p] @ hit
        rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        for r, c in zip(rows, hit[rows].argmax(1)):
            self.join(p[r], q[c])
        for c, r in zip(columns, hit[:, columns].argmax(0)):
            self.join(p[r], q[c])
        left = np.array([self.root(r) for r in p[rows]])
        right = np.array([self.root(c + self.shift) for c in q[columns]])
        apart = hit[np.ix_(rows, columns)] & (left[:, None] != right[None, :])
        for r, c in zip(*np.nonzero(apart)):
            self.join(p[rows[r]], q[columns[c]])

    @staticmethod
    def _parts(t: CoverTree, node: int) -> tuple[np.ndarray, np.ndarray]:
        """A node's children that are split further, and the rows of all others."""
        c = np.arange(t.child[node], t.child[node] + t.kids[node]) if t.kids[node] else np.array([node])
        inner = c[t.kids[c] > 0]
        flat = c[t.kids[c] == 0]
        size = t.last[flat] - t.first[flat]
        ends = np.cumsum(size)
        rows = np.arange(ends[-1] if len(ends) else 0) + np.repeat(t.first[flat] - (ends - size), size)
        return inner, rows

    def visit(self, threshold: float) -> None:
        """Traverse both trees together from their roots. Rows under unsplit nodes
        of one pair are compared at once; a pair with a split node is dropped if
        it is too far apart, counted if all of it is linked, else opened."""
        a, b = self.a, self.b
        far = np.sqrt(2 - 2 * threshold)
        apart = _distance(a.x[[a.centre[0]]], b.x[[b.centre[0]]])[0, 0]
        todo = [(0, 0)] if apart <= far + a.radius[0] + b.radius[0] + 1e-7 else []
        while todo:
            p, q = todo.pop()
            once = self.same and p == q
            (ia, ra), (ib, rb) = self._parts(a, p), self._parts(b, q)
            self.exact(ra, rb, threshold, once)
            for u in ia:  # split nodes against split nodes
                if not len(ib):
                    break
                v = ib[ib >= u] if once else ib
                d = _distance(a.x[[a.centre[u]]], b.x[b.centre[v]])[0]
                for k in np.flatnonzero(d <= far + a.radius[u] + b.radius[v] + 1e-7):
                    self._pair(int(u), int(v[k]), d[k], far, todo)
            self._mixed(a, ia, b, rb, threshold, False)
            if not once:
                self._mixed(b, ib, a, ra, threshold, True)

    def _mixed(self, t: CoverTree, inner: np.ndarray, o: CoverTree, rows: np.ndarray, threshold: float, swap: bool) -> None:
        """Split nodes of one tree against rows of the other."""
        for u in inner:
            if not len(rows):
                return
            d = _distance(t.x[[t.centre[u]]], o.x[rows])[0]
            near = rows[d <= np.sqrt(2 - 2 * threshold) + t.radius[u] + 1e-7]
            own = np.arange(t.first[u], t.last[u])
            if len(near):
                self.exact(near, own, threshold, False) if swap else self.exact(own, near, threshold, False)

    def _pair(self, u: int, v: int, d: float, far: float, todo: list) -> None:
        if (not self.same or u != v) and d + self.a.radius[u] + self.b.radius[v] <= far - 1e-7:
            self.whole(u, v)
        else:
            todo.append((u, v))

    def whole(self, u: int, v: int) -> None:
        """Every row of node u is linked to every row of node v."""
        a, b = self.a, self.b
        ra, rb = slice(a.first[u], a.last[u]), slice(b.first[v], b.last[v])
        self.n[0][ra] += b.weight[rb].sum()
        self.n[1][rb] += a.weight[ra].sum()
        for i in range(ra.start, ra.stop):
            self.join(i, rb.start)
        for j in range(rb.start, rb.stop):
            self.join(ra.start, j)

    def found(self):
        ids = self.a.ids if self.same else np.concatenate([self.a.ids, self.b.ids])
        n = self.n[0] + self.n[1] if self.same else np.concatenate(self.n)
        some = np.flatnonzero(n)
        roots = np.array([self.root(i) for i in some], np.int64)
        return ids[some], ids[roots] if len(roots) else ids[:0], n[some]


def _unit(batches):
    """(vec_id, embedding) to (vec_id, x): x has length 1, or is null where the vector
    takes no part."""
    for b in batches:
        rest = np.ones(b.num_rows, bool)
        for rows, x in matrices(b.column(1)):
            top = np.abs(x).max(1)
            rows, x = rows[top > 0], x[top > 0] / top[top > 0, None]  # scaled first: no square over- or underflows
            rest[rows] = False
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), lists(x / np.sqrt((x * x).sum(1))[:, None])], names=["vec_id", "x"])
        ids = b.column(0).filter(pa.array(rest))
        yield pa.RecordBatch.from_arrays([ids, pa.nulls(len(ids), pa.list_(pa.float64()))], names=["vec_id", "x"])


def _place(pivots):
    """Adds the number of each vector's nearest pivot."""

    def run(batches):
        for b in batches:
            near = (matrix(b.column(2)) @ pivots.value.x.T).argmax(1) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=["node", "weight", "x", "cell"])

    return run


def _plant(pivots, per_tree: int, per_group: int):
    """Trees of at most ``per_tree`` rows of one cell each, in groups of about
    ``per_group`` rows, from rows sorted by cell; ``reach`` is how far a tree's
    rows are from the cell's pivot."""

    def run(batches):
        task, made, rows = TaskContext.get().partitionId(), 0, 0

        def trees(waiting, last: bool):
            nonlocal made, rows
            cell, node, weight, x = (np.concatenate(c) for c in zip(*waiting))
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(edges, edges[1:]):
                for i in range(a, b, per_tree):
                    j = min(i + per_tree, b)
                    if j == len(cell) and not last and j - i < per_tree:
                        return [(cell[i:], node[i:], weight[i:], x[i:])]
                    t, reach = CoverTree(node[i:j], weight[i:j], x[i:j]), float(_distance(pivots.value.x[[cell[i]]], x[i:j]).max())
                    out.append((task << 32 | made, task << 16 | rows // (2 * per_group), int(cell[i]), reach, pickle.dumps(t)))  # a task gets about per_group rows
                    made, rows = made + 1, rows + j - i
            return []

        waiting, out = [], []
        names = ["tree", "grp", "cell", "reach", "body"]
        for b in batches:
            if b.num_rows:
                waiting.append((b.column(3).to_numpy(), b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2))))
            if sum(len(w[0]) for w in waiting) >= 2 * per_tree:
                waiting = trees(waiting, False)
            while out:
                yield pa.RecordBatch.from_arrays([pa.array([c]) for c in out.pop(0)], names=names)
        if waiting:
            trees(waiting, True)
        while out:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in out.pop(0)], names=names)

    return run


def _group_pair(threshold: float):
    """Traverses every two trees of a pair of groups, each two once."""

    def run(group: pa.Table) -> pa.Table:
        grp, tree = group.column("grp").to_numpy(), group.column("tree").to_numpy()
        bodies = group.column("body")
        mine = [i for i in range(len(grp)) if grp[i] == grp.min()]
        other = [i for i in range(len(grp)) if grp[i] == grp.max()]
        found = [[], [], []]
        held = {i: pickle.loads(bodies[i].as_py()) for i in other}
        for i in mine:
            t = held[i] if i in held else pickle.loads(bodies[i].as_py())
            for j in other:
                if grp[i] != grp[j] or tree[i] <= tree[j]:
                    links = Links(t, held[j])
                    links.visit(threshold)
                    for k, c in enumerate(links.found()):
                        found[k].append(c)
        return pa.table({name: pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for name, c in zip(("node", "root", "n"), found)})

    return run


def _linked(nodes: DataFrame, dim: int, n: int, threshold: float, per_tree: int) -> DataFrame:
    """(node, root, n) for the ``n`` nodes of one vector length: see ``near_duplicates``."""
    spark = nodes.sparkSession
    mine = nodes.filter(F.size("x") == dim).select("node", "weight", "x")
    sample = mine.orderBy(F.xxhash64("x"), "node").limit(max(1, min(PIVOTS, n // max(1, per_tree // 4)))).select("x").toArrow()
    upper = CoverTree(np.arange(sample.num_rows), np.ones(sample.num_rows, np.int64), matrix(sample.column(0)))
    upper.ids = np.arange(sample.num_rows)  # cells are numbered in the tree's order, so near ones follow each other
    pivots = spark.sparkContext.broadcast(upper)
    per_group = max(per_tree, min(GROUP // (8 * dim), -(-n // GROUPS)))
    parts = -(-n // per_group)
    near = mine.mapInArrow(_place(pivots), "node long, weight long, x array<double>, cell int")
    near = near.repartitionByRange(parts, "cell", F.xxhash64("node")).sortWithinPartitions("cell").select("node", "weight", "x", "cell")
    trees = store(near.mapInArrow(_plant(pivots, per_tree, per_group), "tree long, grp long, cell long, reach double, body binary"), "trees")

    cells = trees.groupBy("grp", "cell").agg(F.max("reach").alias("reach"))
    reach = np.zeros(len(upper.x))
    for r in cells.groupBy("cell").agg(F.max("reach").alias("reach")).collect():  # one number per pivot
        reach[r["cell"]] = r["reach"]
    pairs = near_cells(upper, reach, float(np.sqrt(2 - 2 * threshold)))  # at most one per two pivots
    pairs = spark.createDataFrame(pa.table({"cell": pa.array([p[0] for p in pairs], pa.int64()), "other": pa.array([p[1] for p in pairs], pa.int64()), "gap": pa.array([p[2] for p in pairs], pa.float64())}))
    left = cells.select(F.col("grp").alias("gi"), "cell", F.col("reach").alias("ri")).join(pairs, "cell")
    right = cells.select(F.col("grp").alias("gj"), F.col("cell").alias("other"), F.col("reach").alias("rj"))
    meet = store(left.join(right, "other").filter("gi <= gj and ri + rj >= gap").select("gi", "gj").distinct(), "group-pairs")
    sent = meet.select(F.col("gi").alias("grp"), "gi", "gj").unionByName(meet.filter("gi < gj").select(F.col("gj").alias("grp"), "gi", "gj"))
    both = trees.select("tree", "grp", "body").join(sent, "grp")
    return store(both.groupBy("gi", "gj").applyInArrow(_group_pair(threshold), "node long, root long, n long"), "links")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, per_tree: int = PER_TREE) -> DataFrame:
    """Links of cosine ``threshold`` or more (double precision) between all rows
    of ``vectors`` (vec_id, embedding), and their connected components.

    Equal vectors are one node with a weight. Nodes belong to the cell of their
    nearest of at most ``PIVOTS`` sampled vectors; a cell's nodes make trees of
    at most ``per_tree``, trees in the order of cells make groups. A cover tree
    over the pivots is the upper part of all trees: its dual traversal, with
    radii that cover the cells, leaves the pairs of cells, and so of groups,
    that may hold a link. Each such pair of groups is one task of bounded size,
    to which the trees come by a shuffle; there every two trees are traversed
    together. A pair of tree nodes is dropped when its centres are further
    apart than both radii and the threshold distance, and counted as a whole
    when every pair in it must be linked; so groups of near copies send link
    counts and a spanning forest, never all their pairs. Where vectors are so
    spread that no bound applies, all pairs of groups remain: exact threshold
    pairs of such data take quadratic work by this method.

    Returns vec_id, n_links, component_id, kept, one row per row. Vectors that
    are null, empty or zero or hold null or non-finite components link with
    nothing (0 links, their own component). Vectors of different lengths don't
    link. Rows that repeat an id are vectors of their own, each with its own
    links and component; so are rows with a null id, which take part and get
    the smallest known id of their component, or null, and kept null. Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    d = columns(vectors, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    unit = d.mapInArrow(_unit, "vec_id long, x array<double>").select("vec_id", "x", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2"))
    unit = store(unit, "unit")
    v = unit.filter("x is not null")
    nodes = v.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.any_value("x").alias("x"))
    nodes = store(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    found = None
    for r in nodes.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect():  # one row per vector length
        got = _linked(nodes, r["dim"], r["n"], threshold, per_tree)
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = spark.createDataFrame([], "node long, root long, n long")
    links = found.groupBy("node").agg(F.sum("n").alias("other"))
    joined = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    known = nodes.select("node", "rep", "h1", "h2", "weight").join(links, "node", "left").join(joined, "node", "left")
    known = store(known.withColumn("component", F.coalesce("component", "node")), "known")
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = store(known.join(least, "component").select("h1", "h2", "component_id", (F.col("weight") - 1 + F.coalesce("other", F.lit(0))).alias("n_links")), "known")
    linked = v.select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    rest = unit.filter("x is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
