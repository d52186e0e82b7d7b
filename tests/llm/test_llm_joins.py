"""Line dedup, MinHash, cover tree, top-k: against brute force and on edge cases."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import catalogue, covertree, lines, minhash, topk
from tidelog.llm.common import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = " \t\r\n\f\x0b"
CUT = re.compile(r"\n(?=[^\S\n]*\S)")


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{n % 3}", None if t is None else len(t)) for n, (i, t) in enumerate(zip(ids, texts))], DOC)


def brute_lines(texts, m):
    """All runs of lines of m words or more, longest allowed: a later copy's lines go."""
    seqs = [[(p, x.strip(BLANK)) for p, x in enumerate(CUT.split(t)) if x.strip(BLANK)] for t in texts]
    first, gone = {}, [set() for _ in texts]

    def runs(s):
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                if sum(len(x.split()) for _, x in s[a:b]) >= m:
                    yield a, b

    for d, s in enumerate(seqs):
        for a, b in runs(s):
            first.setdefault(tuple(x for _, x in s[a:b]), (d, a))
    for d, s in enumerate(seqs):
        for a, b in runs(s):
            if first[tuple(x for _, x in s[a:b])] < (d, a):
                gone[d] |= {p for p, _ in s[a:b]}
    return ["\n".join(x for p, x in enumerate(CUT.split(t)) if p not in g) for t, g in zip(texts, gone)]


@pytest.mark.parametrize("m, seed", [(4, 1), (10, 2), (1, 3)])
def test_lines_match_brute_force(spark, m, seed):
    rng = random.Random(seed)
    pool = ["a", "b b", "c c c", "d d d d", "e e e e e", "one two three four five six seven eight nine ten eleven"]
    texts = ["\n".join(rng.choice(pool) + ("\n" if rng.random() < 0.2 else "") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    texts = list(dict.fromkeys(texts))
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, texts), m).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts, m)


def test_lines_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = [long, long, None, "", "  \n \n", f"x\n{long}\ny", f"head\n\n{long}\n\ntail", "short\nshort\nshort"]
    d = docs_of(spark, texts, [5, 5, 1, 2, 3, 6, None, 8]).withColumnsRenamed({"lang": "__nth", "source": "n_lines"}).withColumn("pos", lines.F.lit(1))
    got = lines.dedup_lines(d).collect()
    assert len(got) == 8 and set(got[0].asDict()) == {"doc_id", "text", "__nth", "n_chars", "pos", "n_lines", "n_removed"}
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r["text"])
    assert sorted(by[5]) == ["", long] and by[1] == [None] and by[2] == [""] and by[3] == ["  \n \n"]
    assert by[6] == ["x\ny"] and by[None] == ["head\n\ntail"] and by[8] == ["short\nshort\nshort"]
    assert lines.dedup_lines(d.limit(0)).count() == 0


def test_maximal_runs_far_longer_than_the_floor(spark):
    rng = random.Random(6)
    base = [f"line {i} of many" for i in range(40)]
    seqs = [base, base[3:30], [f"own {i}" for i in range(5)] + base[10:37], base[:9] + ["between"] + base[9:25], ["a"] * 21, ["b", *["a"] * 9]]
    seqs += [[rng.choice("pqr") for _ in range(12)] for _ in range(8)]
    rows = [(d, 0, i, hash(x) % 2**60, len(x), len(x.split())) for d, s in enumerate(seqs) for i, x in enumerate(s)]
    lines_ = spark.createDataFrame(rows, "k1 long, k2 long, pos int, l1 long, l2 long, words int")

    def earlier(d, a, n):
        run = seqs[d][a : a + n]
        return any(seqs[e][b : b + n] == run for e in range(d + 1) for b in range(len(seqs[e]) - n + 1) if (e, b) < (d, a))

    for m in (1, 9):
        want = []
        for d, s in enumerate(seqs):
            last = 0
            for a in range(len(s)):
                n = max((n for n in range(1, len(s) - a + 1) if earlier(d, a, n)), default=0)
                if a + n > last and n and sum(len(x.split()) for x in s[a : a + n]) >= m:
                    want.append((d, a, n))
                last = max(last, a + n)
        assert sorted((r["k1"], r["pos"], r["length"]) for r in lines.repeated_runs(lines_, m).collect()) == want
        assert m > 1 or (4, 1, 20) in want and (1, 0, 27) in want


def test_lines_keep_columns_of_any_name(spark):
    texts = ["a a\nb b", "b b\nc", "b b\nc", None, "x " * 40_000 + "\nb b"]
    d = docs_of(spark, texts)
    clash = ["k1", "h1", "l", "gone", "copy", "nth", "left", "__nth", "__gone", "t0", "pos", "c0", "Text", "DOC_ID", "a`b"]
    for n, c in enumerate(clash):
        d = d.toDF(*[f"own{i}" for i in range(len(d.columns))]).withColumn("new", F.lit(n)).toDF(*d.columns, c)
    got = lines.dedup_lines(d, 1)
    assert got.columns == [*d.columns, "n_lines", "n_removed"]
    want = ["a a\nb b", "c", "", None, "x " * 40_000]
    rows = {r[0]: r for r in got.collect()}
    for i, t in enumerate(want):
        assert rows[i][1] == t and rows[i][2:5] == ("en", f"s{i % 3}", None if texts[i] is None else len(texts[i]))
        assert list(rows[i][5:-2]) == list(range(len(clash)))
    assert [rows[i][-1] for i in range(5)] == [0, 1, 2, 0, 1]


def without_later_copies(texts):
    """Every line at its first place only."""
    seen, out = set(), []
    for t in texts:
        kept = []
        for x in CUT.split(t):
            line = x.strip(BLANK)
            if not line or line not in seen:
                kept.append(x)
            seen.add(line)
        out.append("\n".join(kept))
    return out


def test_lines_of_any_length_go(spark, tmp_path):
    rng = random.Random(4)
    pool = ["a", "b b", "c c c", "All rights reserved.", "one two three four five six seven eight nine", "d " * 12, "e " * 30]
    texts = ["\n".join(rng.choice([*pool, f"own {i} {j}"]) + rng.choice(["", "", "\n", "  "]) for j in range(rng.randrange(1, 9))) for i in range(40)]
    texts += ["\n\na", "a", "a\na\nlast", "c c c\nb b"]
    texts = list(dict.fromkeys(texts))
    want = without_later_copies(texts)
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in catalogue.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert [got[i]["text"] for i in range(len(texts))] == want
    assert sum(r["n_removed"] for r in got.values()) == sum(len(CUT.split(t)) for t in texts) - sum(len(CUT.split(t)) if t else 0 for t in want)
    stage = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs_of(spark, texts), str(tmp_path)).collect()}
    assert [stage[i] for i in range(len(texts))] == want


def weighted(text):
    w = re.findall(r"[A-Za-z0-9_\u0080-\U0010ffff]+", text)
    w = [x.lower() if x.isascii() else x for x in w]
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def probability_jaccard(a, b):
    every = a.keys() | b.keys()
    return sum(1 / sum(max(a[e] / a[k], b[e] / b[k]) for e in every) for k in a.keys() & b.keys())


def test_exact_similarity():
    a, b = "a b c d e f g a b c d e x y", "a b c d e f g a b c d e x z"
    (_, ha, wa), (_, hb, wb) = minhash.shingles([a]), minhash.shingles([b])
    assert minhash.similarity(ha, wa, hb, wb) == pytest.approx(probability_jaccard(weighted(a), weighted(b)))
    assert minhash.similarity(ha, wa, ha, wa) == pytest.approx(1)


def test_registers_estimate_probability_jaccard():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    a = words[:]
    b = words[:300] + [f"v{rng.random()}" for _ in range(100)] + words[100:150]
    doc, h, w = minhash.shingles([" ".join(a), " ".join(b)])
    who = minhash.registers(doc, h, w, 2, 4096)
    assert np.mean(who[0] == who[1]) == pytest.approx(probability_jaccard(weighted(" ".join(a)), weighted(" ".join(b))), abs=0.04)


def near_copies(seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(rng.randrange(1, 9)):
            now = [w if rng.random() > rng.choice([0.0, 0.01, 0.03]) else "edited" for w in base]
            out.append(" ".join(now))
    return out + ["", "", "only three words", "Only three  words!", None, "solo"]


def brute_classes(texts):
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    w = [weighted(t or "") for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is not None and texts[j] is not None and (texts[i] == texts[j] or probability_jaccard(w[i], w[j]) >= 0.8):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("pairwise, block", [(64, 256), (1, 256), (1, 2)])
def test_minhash_matches_brute_force(spark, monkeypatch, pairwise, block):
    monkeypatch.setattr(minhash, "PAIRWISE", pairwise)
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = near_copies()
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    want = brute_classes(texts)
    assert [got[i][0] for i in range(len(texts))] == want
    assert [got[i][1] for i in range(len(texts))] == [i == c for i, c in enumerate(want)]


def test_minhash_in_the_pipeline_keeps_one_of_each(spark):
    texts = near_copies(7)
    kept = minhash.one_of_each(docs_of(spark, texts))
    assert kept.columns == DOC.replace(" long", "").replace(" string", "").split(", ")
    want = sorted({c for c in brute_classes(texts)})
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    twice = docs_of(spark, ["a b c d e f", "a b c d e f", None, None], [4, 4, None, None])
    assert minhash.one_of_each(twice).count() == 3
    assert minhash.one_of_each(twice.limit(0)).count() == 0


@pytest.mark.parametrize("repeat", [False, True])
@pytest.mark.parametrize("two", [False, True])
def test_block_comparison_joins_what_pairs_join(repeat, two):
    texts = [t * 2 if repeat else t for t in near_copies(9) if t]
    texts = texts[::2] + texts[1::2]
    n, half = len(texts), (len(texts) + 1) // 2
    w = [weighted(t) for t in texts]
    block = lambda a, b: minhash.Block(np.arange(a, b), np.arange(a, b), texts[a:b])
    found = minhash._compare(block(0, half), block(half, n)) if two else minhash._compare(block(0, n), None)
    want = {(i, j) for j in range(n) for i in range(j) if (not two or i < half <= j) and probability_jaccard(w[i], w[j]) >= 0.8}
    assert want and set(found) <= want
    roots = []
    for edges in (want, found):
        up = list(range(n))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for u, v in edges:
            u, v = root(u), root(v)
            up[max(u, v)] = min(u, v)
        roots.append([root(i) for i in range(n)])
    assert roots[0] == roots[1]


def test_minhash_edges(spark):
    long = " ".join(f"word{i % 9973}" for i in range(60_000))
    texts = [long, long + " more", long, "a b c d e f", "a b c d e f", None, "", ""]
    d = docs_of(spark, texts, [3, 2, 9, 5, 5, 6, 7, None]).withColumnsRenamed({"lang": "TEXT", "source": "x1"}).withColumn("h1", F.lit(1)).withColumn("__nth", F.lit(2)).withColumn("nth", F.lit(3))
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["kept"]) for r in minhash.near_duplicates(d).collect())
    assert got == [("2", "2", True), ("3", "2", False), ("5", "5", True), ("5", "5", True), ("6", "6", True), ("7", "7", True), ("9", "2", False), ("None", "7", False)]
    one = minhash.one_of_each(d)
    assert one.columns == d.columns
    assert sorted((r[0], r[2], *r[5:]) for r in one.collect()) == [(i, "en", 1, 2, 3) for i in (2, 5, 6, 7)]


def test_minhash_recall_against_all_pairs(spark):
    """Every link of similarity 0.8 or more between documents of the tables is found."""
    from itertools import combinations

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    w = {i: weighted(t or "") for i, t in rows}
    links = [(i, j) for i, j in combinations(w, 2) if len(w[i].keys() & w[j].keys()) * 5 >= 3 * min(len(w[i]), len(w[j])) and probability_jaccard(w[i], w[j]) >= 0.8]
    assert links and all(got[i] == got[j] for i, j in links)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for u, v in edges:
        if u is not None and u != v:
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: root(i) for i in list(up)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


VEC = "vec_id long, embedding array<float>, label int, rank int"


def vectors(seed=1):
    rng = np.random.RandomState(seed)
    base = rng.randn(40, 16)
    rows = [b + 0.15 * rng.randn(16) for b in base for _ in range(rng.randint(1, 6))] + [base[0]] * 3 + [2 * base[1], np.zeros(16)]
    out = [(i, [float(np.float32(x)) for x in r], 0, 1) for i, r in enumerate(rows)]
    return out + [(900, None, 0, 1), (901, [], 0, 1), (902, [1.0, None], 0, 1), (903, [float("nan")] * 16, 0, 1), (904, [float("inf")] * 16, 0, 1), (905, [3.0, 4.0], 0, 1), (906, [6.0, 8.0], 0, 1), (None, [3.0, 4.0], 0, 1)]


def brute_links(rows):
    """(n_links, component_id) of each row, every row a vector of its own."""
    good = {n: np.array(v, float) for n, (i, v, *_) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    up, links = list(range(len(rows))), collections.Counter()

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in good.items():
        for j, y in good.items():
            if i < j and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for n, r in enumerate(rows):
        if r[0] is not None:
            least[root(n)] = min(r[0], least.get(root(n), r[0]))
    return [(links[n], least.get(root(n))) for n in range(len(rows))]


@pytest.mark.parametrize("per_tree, groups", [(2048, 8), (40, 8), (12, 2)])
def test_cover_tree_matches_brute_force(spark, per_tree, groups, monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", 4)
    monkeypatch.setattr(covertree, "GROUPS", groups)
    rows = vectors()
    near = [c + 0.01 for c in rows[3][1]]
    rows += [(3, rows[3][1], 0, 1), (3, rows[9][1], 0, 1), (None, near, 0, 1), (9, near, 0, 1)]  # ids that repeat, and none
    d = spark.createDataFrame(rows, VEC).withColumnRenamed("label", "VEC_ID").withColumnRenamed("rank", "x")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), str(r["kept"])) for r in covertree.near_duplicates(d, per_tree=per_tree).collect())
    want = [(str(i), n, str(c), str(None if i is None or c is None else i == c)) for (i, *_), (n, c) in zip(rows, brute_links(rows))]
    assert got == sorted(want) and sum(w[1] for w in want)
    assert covertree.near_duplicates(spark.createDataFrame([], VEC)).count() == 0


def test_repeated_ids_have_their_own_links(spark):
    x, y = [1.0, 0, 0, 0], [0.0, 1, 0, 0]
    rows = [(5, x, 0, 1), (5, y, 0, 1), (6, [1, 0.01, 0, 0], 0, 1), (7, [1, 0, 0.01, 0], 0, 1), (8, [0, 1, 0.01, 0], 0, 1)]
    got = covertree.near_duplicates(spark.createDataFrame([(i, [float(c) for c in v], a, b) for i, v, a, b in rows], VEC)).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in got) == [(5, 1), (5, 2), (6, 2), (7, 2), (8, 1)]


def test_upper_levels_prune_cells_without_loss():
    rng = np.random.RandomState(2)
    base = rng.randn(6, 8)
    x = np.concatenate([b + 0.05 * rng.randn(30, 8) for b in base])
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = covertree.CoverTree(np.arange(len(x)), np.ones(len(x), int), x)
    reach = rng.rand(len(x)) * 0.1
    got = {(i, j) for i, j, _ in covertree.near_cells(t, reach, 0.3)}
    d = covertree._distance(t.x, t.x)
    want = {(int(t.ids[i]), int(t.ids[j])) for i, j in zip(*np.nonzero(d <= reach[:, None] + reach[None, :] + 0.3))}
    assert want <= got and len(got) < len(x) ** 2 / 3


def test_cover_tree_counts_whole_nodes():
    rng = np.random.RandomState(0)
    x = np.concatenate([np.eye(8)[:1] + 0.01 * rng.randn(300, 8), rng.randn(300, 8)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    w = rng.randint(1, 4, 600)
    t = covertree.CoverTree(np.arange(600), w, x)
    links = covertree.Links(t, t)
    links.visit(0.9)
    ids, _, n = links.found()
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    want = hit @ w
    assert dict(zip(ids.tolist(), n.tolist())) == {i: int(c) for i, c in enumerate(want) if c}


@pytest.mark.parametrize("block", [32 << 20, 1600])
def test_topk_matches_brute_force(spark, block):
    rng = np.random.RandomState(5)
    rows = [(i, [float(v) for v in np.float32(rng.randn(20))], 0, 1) for i in range(300)]
    rows += [(i, rows[7][1], 0, 1) for i in range(300, 303)] + [(50 * 9, None, 0, 1), (50 * 10, [1.0, None], 0, 1), (50 * 11, [1.0, 2.0], 0, 1), (50 * 12, [], 0, 1)]
    rows += [(None, rows[0][1], 0, 1), (100, rows[8][1], 0, 1), (150, rows[150][1], 0, 1), (None, [1.0, 1.0], 0, 1)]  # ids that repeat, and none
    d = spark.createDataFrame(rows, VEC).withColumnRenamed("label", "VEC_ID").withColumnRenamed("rank", "at")
    x = topk.quantised(d)
    got = sorted(tuple(map(str, r)) for r in topk.search(x, x.filter("vec_id % 50 = 0"), block=block).collect())
    q = [(i, np.floor(256 * np.array(v, float))) for i, v, *_ in rows if v and None not in v]
    want = []
    for n, (i, x) in enumerate(q):
        if i is not None and i % 50 == 0:
            scores = sorted((-int(x @ y), j is None, j or 0) for m, (j, y) in enumerate(q) if m != n and len(y) == len(x))[:5]
            want += [(str(i), str(r + 1), str(None if null else j), str(-s)) for r, (s, null, j) in enumerate(scores)]
    assert got == sorted(want)
    assert topk.topk(spark.createDataFrame([], VEC)).count() == 0


def test_topk_scores_are_exact_longs(spark):
    big = [float(2**24 + i) for i in range(70)]
    rows = [(0, big, 0, 1), (1, [c + 1 for c in big], 0, 1), (2, [-c for c in big], 0, 1), (3, [1e30] * 70, 0, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rank int")
    got = {r["vec_id"]: r["score"] for r in topk.topk(d, k=5).collect()}
    q = [[256 * int(c) for c in v] for _, v, *_ in rows]
    want = {i: max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(q[0], q[i])))) for i in (1, 2, 3)}
    assert got == want and want[1] > 2**53 and want[3] == 2**63 - 1


def test_topk_levels_prune_without_loss():
    rng = np.random.RandomState(1)
    centres = np.floor(256 * rng.randn(30, 64))
    x = np.concatenate([c + np.floor(10 * rng.randn(100, 64)) for c in centres])
    s = topk.Search(np.arange(10), x[:10], 5)
    for i in range(0, len(x), 512):
        at = np.arange(i, min(i + 512, len(x)))
        s.offer(at, at, np.zeros(len(at), bool), x[i : i + 512])
    full = x[:10] @ x.T
    for i in range(10):
        full[i, i] = -np.inf
        order = np.lexsort((np.arange(len(x)), -full[i]))[:5]
        assert s.key[i].tolist() == order.tolist()
    assert s.exact < 10 * len(x) / 4
