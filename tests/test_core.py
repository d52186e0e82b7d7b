"""Expectations on record sets small enough to read."""

import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog import config, model
from tidelog.engine import Engine, RateLimited
from tidelog.functions import codec, hashing, text
from tidelog.functions.lru import Lru
from tidelog.operators import integrity, lsm, scans, sketches
from tidelog.plans import snapshot
from tidelog.sources import log as source
from tidelog.streaming import buckets, ingest


def log_of(spark, ops):
    """ops: (key, value or None for a delete), in order of arrival."""
    return spark.createDataFrame([(k, None if v is None else bytearray(v.encode()), v is None, 7, i) for i, (k, v) in enumerate(ops)], model.RECORD)


def state(df):
    return {r["key"]: bytes(r["value"]).decode() for r in df.collect()}


def keys(df):
    return [r["key"] for r in df.collect()]


def test_newest_version_and_tombstones(spark):
    old = [(f"key_{i:03d}", f"v3_{i:03d}") for i in range(15)]
    mid = [(f"key_{i:03d}", {3: "middle", 5: None, 7: None}.get(i, f"v2_{i:03d}")) for i in range(15)] + [("key_016", "m")]
    new = [("key_001", "v1"), ("key_002", "newest"), ("key_004", None), ("key_020", "n")]
    got = state(snapshot.live(log_of(spark, old + mid + new)))
    assert not {"key_004", "key_005", "key_007"} & set(got)
    assert got["key_003"] == "middle" and got["key_002"] == "newest" and {"key_006", "key_016", "key_020"} <= set(got)


def test_a_value_filter_above_the_snapshot_resurrects_nothing(spark):
    log = log_of(spark, [("a", "1"), ("a", None)])
    assert snapshot.live(log.filter(F.col("key") == "a")).count() == 0
    assert scans.get(log, "a").count() == 0 and scans.prefix_scan(log, "a").count() == 0


def test_pages(spark):
    log = log_of(spark, [(f"item_{i:03d}", "x") for i in range(20)])
    assert keys(scans.range_scan(log, "item_005", "item_015", 5, 0)) == [f"item_{i:03d}" for i in range(5, 10)]
    assert keys(scans.range_scan(log, "item_005", "item_015", 5, 1)) == [f"item_{i:03d}" for i in range(10, 15)]
    assert keys(scans.range_scan(log, "item_005", "item_015", 5, 9)) == []
    assert len(keys(scans.prefix_scan(log, "item_", -3, -1))) == 5
    assert keys(scans.range_scan(log, "b", "a")) == [] and keys(scans.prefix_scan(log, "item_019")) == ["item_019"]
    assert keys(scans.prefix_after(log, "item_", "item_017", 5)) == ["item_018", "item_019"]


def test_iteration(spark):
    log = log_of(spark, [(f"user_{i:03d}", "x") for i in range(10)])
    cursor, seen = "user_000", []
    while r := scans.range_iterate(log, "user_000", "user_009", cursor).first():
        cursor = r["key"]
        seen.append(cursor)
    assert seen == [f"user_{i:03d}" for i in range(1, 10)]
    assert scans.range_iterate(log, "user_003", "user_005", "a").first()["key"] == "user_003"
    assert scans.prefix_iterate(log, "user", "user1").first()["key"] == "user_000"


@pytest.mark.parametrize("word, below", [("b", "a"), ("", ""), ("\x00", ""), ("a\x00", "`\U0010ffff")])
def test_predecessor(word, below):
    assert scans.predecessor(word) == below


def test_simhash_known_values(spark):
    rows = [(1, "hello world hello"), (2, "apple banana apple apple"), (3, "go go go go go"), (4, ""), (5, None)]
    got = {r[0]: r[1] for r in sketches.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "e3e1efd54283d94f7081314b599d31b3", 2: "32def085b783d94f708144a8363d0e8f", 3: "0880953fc0ab1be95aa0733055b380bb", 4: "f" * 32, 5: None}


def test_hamming_and_pairs(spark):
    prints = spark.createDataFrame([("0" * 32,), ("0" * 31 + "7",), ("f" * 32,), ("0" * 32,)], "fingerprint string")
    assert [tuple(r) for r in sketches.fingerprint_pairs(prints).collect()] == [("0" * 32, "0" * 31 + "7", 3)]
    d = spark.createDataFrame([("0" * 32, "f" * 32)], "a string, b string").select(hashing.hamming(F.col("a"), F.col("b"))).first()[0]
    assert d == 128


@pytest.mark.parametrize("prints, blocks, bands", [(100, 8, 8), (10**6, 9, 36), (10**10, 10, 120)])
def test_bands_of_fingerprints_hold_every_near_pair(spark, monkeypatch, prints, blocks, bands):
    cut, chosen = sketches._bands(7, prints)
    assert len(cut) == blocks and len(chosen) == bands and sum(n for _, n in cut) == 128
    rng = random.Random(blocks)
    base = [rng.getrandbits(128) for _ in range(6)]
    every = sorted({b ^ sum(1 << i for i in rng.sample(range(128), n)) for b in base for n in (0, 3, 7, 7, 9)})
    monkeypatch.setattr(sketches, "_bands", lambda most, n: (cut, chosen))
    d = spark.createDataFrame([(f"{p:032x}",) for p in every] + [(f"{every[0]:032x}",), (None,)], "fingerprint string")
    got = {(r["a"], r["b"]): r["distance"] for r in sketches.fingerprint_pairs(d).collect()}
    assert got == {(f"{a:032x}", f"{b:032x}"): (a ^ b).bit_count() for a in every for b in every if a < b and (a ^ b).bit_count() <= 7}


def test_tokens_of_all_characters_in_time(spark):
    ranges = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower("t"), "'", ""), "[^A-Za-z0-9_\\t\\n\\f\\r ]", ""), "[\\t\\n\\f\\r ]+"), lambda w: w != "")
    points = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    rows = ["".join(f"a{c}b {c} " for c in points[i : i + 1000]) for i in range(0, len(points), 1000)] + ["", " ", None, "it's\tan_id\x0b x\u00a0y\u212a"]
    d = spark.createDataFrame([(r,) for r in rows], "t string")
    assert d.select(text.tokens(F.col("t"))).collect() == d.select(ranges).collect()
    many = spark.range(400).select(F.repeat(F.lit("Some words, not so many; of a text. "), 400).alias("t")).localCheckpoint()

    def seconds(tokens):
        began = time.time()
        many.select(F.sum(F.size(tokens))).collect()
        return time.time() - began

    assert 3 * min(seconds(text.tokens(F.col("t"))) for _ in range(3)) < min(seconds(ranges) for _ in range(3))


def near_pairs(prints, most=7):
    return {(f"{a:032x}", f"{b:032x}"): (a ^ b).bit_count() for a in prints for b in prints if a < b and (a ^ b).bit_count() <= most}


def test_pairs_of_close_fingerprints_come_in_time(spark):
    rng = random.Random(3)
    base = rng.getrandbits(128)
    every = sorted({base ^ sum(1 << i for i in rng.sample(range(128), 4)) for _ in range(6000)})
    d = spark.createDataFrame([(f"{p:032x}",) for p in every], "fingerprint string")
    began = time.time()
    got = sketches.fingerprint_pairs(d).groupBy("distance").count().collect()
    assert time.time() - began < 45  # by bands alone, whose candidates' digits were read each time, minutes
    raw = np.frombuffer(b"".join(p.to_bytes(16, "big") for p in every), ">u8").reshape(-1, 2).astype(np.uint64)
    far = sum(np.bitwise_count(raw[:, None, k] ^ raw[None, :, k]) for k in (0, 1))
    assert dict(map(tuple, got)) == {n: int((far == n).sum()) // 2 for n in range(1, 8) if (far == n).any()}


@pytest.mark.parametrize("dense", [0, 1e18])
@pytest.mark.parametrize("size", [1, 7, 1000])
def test_pairs_by_bands_and_by_blocks(spark, monkeypatch, dense, size):
    monkeypatch.setattr(sketches, "_DENSE", dense)
    monkeypatch.setattr(sketches, "_blocks", lambda n: F.ceil(n / size).cast("int"))
    rng = random.Random(size)
    base = [rng.getrandbits(128) for _ in range(2)]
    every = sorted({b ^ sum(1 << i for i in rng.sample(range(128), n)) for b in base for n in (0, 1, 2, 3, 3, 4, 4, 4, 5, 7, 7, 8)})
    d = spark.createDataFrame([(f"{p:032x}",) for p in [*every, every[0]]] + [(None,)], "fingerprint string")
    got = [tuple(r) for r in sketches.fingerprint_pairs(d).select("a", "b", "distance").collect()]
    assert sorted(got) == sorted((*k, v) for k, v in near_pairs(every).items())
    assert sketches.fingerprint_pairs(d.limit(0)).count() == 0


def test_blocks_of_large_groups(spark):
    sizes = {0: 1, 1: 1, 1024: 1, 1025: 2, 40_000: 32, 32 * 4096 + 1: 33, 10**7: 2442}
    d = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", sketches._blocks(F.col("n")))
    assert dict(map(tuple, d.collect())) == sizes


def test_codecs_round_trip(spark):
    log = log_of(spark, [("a", "x" * 9000), ("ključ", None), ("b", ""), ("c", "y" * 4033), ("d", "y" * 4050)])
    d = log.withColumn("raw", codec.plain()).withColumn("frames", codec.frames(F.col("raw"))).withColumn("short", codec.compressed(F.col("seq") + 1))
    for r in d.withColumn("back", codec.from_plain(codec.joined(F.col("frames")))).withColumn("known", codec.from_compressed(F.col("short"))).collect():
        value = bytes(r["value"]) if r["value"] else None
        assert (r["back"]["key"], r["back"]["tombstone"], r["back"]["timestamp"], r["back"]["value"] and bytes(r["back"]["value"])) == (r["key"], r["tombstone"], 7, value)
        assert (r["known"]["key_id"], r["known"]["tombstone"], r["known"]["timestamp"], r["known"]["value"] and bytes(r["known"]["value"])) == (r["seq"] + 1, r["tombstone"], 7, value)
        assert len(r["short"]) == (17 if r["tombstone"] else 25 + len(value or b""))
        kinds = [f[8] for f in r["frames"]]
        assert kinds == ([4] if len(r["raw"]) <= 4075 else [1] + [2] * (len(kinds) - 2) + [3]) and all(len(f) + 4 <= 4096 for f in r["frames"])


def test_tokens(spark):
    got = spark.createDataFrame([("Don't STOP, the_1 café...\n\nend.",)], "t string").select(text.tokens(F.col("t"))).first()[0]
    assert got == ["dont", "stop", "the_1", "caf", "end"]


def test_merkle_known_roots(spark):
    want = {4: "52b6ec49b1ed0eed625adcef9073f0c2", 3: "ac491d1ea728dc2fb488cf3bc8b3a898", 2: "423a3d793bb8c91da536a90361dc09ff", 1: "9dd085e96a8813854138d29b8a6fdf58"}
    for n, root in want.items():
        leaf = integrity.leaves_of(spark.createDataFrame([(i, f"block{i + 1}") for i in range(n)], "i long, v string"), "i", "v")
        assert integrity.roots(leaf).first()["root"] == root
        assert integrity.tree(leaf).count() == {4: 7, 3: 6, 2: 3, 1: 1}[n]
    four = integrity.leaves_of(spark.createDataFrame([(i, f"block{i + 1}") for i in range(4)], "i long, v string"), "i", "v")
    diff = integrity.differing(four, four.filter("pos < 3")).collect()
    assert len(diff) == 1 and diff[0]["pos"] == 3 and diff[0]["found"] == "0" * 32


def test_record_bytes_and_checksum(spark):
    log = spark.createDataFrame([("k", bytearray(b"vv"), False, 258, 0)], model.RECORD)
    raw = bytes(log.select(codec.plain()).first()[0])
    assert raw == (258).to_bytes(8, "little") + b"\0" + (1).to_bytes(8, "little") + (2).to_bytes(8, "little") + b"kvv"
    assert integrity.checksums(log).first()["crc"] == zlib.crc32(raw) and log.select(lsm.plain_size()).first()[0] == len(raw)


def test_bloom(spark):
    assert sketches.bloom_size(100, 0.01) == (959, 7)
    m, k = sketches.bloom_size(100, 0.01)
    items = spark.createDataFrame([(f"k{i}",) for i in range(100)], "key string")
    bits = sketches.bloom_bits(items, "key", m, k)
    assert sketches.bloom_test(bits, items, "key", m, k).filter("not maybe").count() == 0
    other = spark.createDataFrame([(f"x{i}",) for i in range(1000)], "key string")
    assert sketches.bloom_test(bits, other, "key", m, k).filter("maybe").count() < 50
    prefix = sketches.prefix_bloom_bits(items, "key", m * 11, k)
    asked = spark.createDataFrame([("k",), ("k9",), ("zz",)], "key string")
    assert {r["key"]: r["maybe"] for r in sketches.prefix_bloom_test(prefix, asked, "key", m * 11, k).collect()} == {"k": True, "k9": True, "zz": False}


def test_count_min_and_hyperloglog(spark):
    assert sketches.cms_size(0.01, 0.01) == (272, 6) and sketches.cms_size(0.01, 0.99)[1] == 2
    items = spark.createDataFrame([("a",)] * 1000 + [("b",)] * 3, "x string")
    m, k = sketches.cms_size(0.01, 0.99)
    probes = spark.createDataFrame([("a",), ("b",), ("none",)], "x string")
    got = {r["x"]: r["estimate"] for r in sketches.cms_query(sketches.cms_cells(items, "x", m, k), probes, "x", m, k).collect()}
    assert 1000 <= got["a"] <= 1050 and got["b"] >= 3
    for p, n in ((10, 7), (12, 10), (12, 5000), (16, 20000)):
        values = spark.range(n).select(F.concat(F.lit("n"), "id").alias("x"))
        assert abs(sketches.hll_estimate(sketches.hll_registers(values, "x", p), p).first()[0] - n) <= 0.1 * n
    assert sketches.hll_estimate(sketches.hll_registers(items.limit(0), "x", 10), 10).first()[0] == 0
    with pytest.raises(ValueError):
        sketches.hll_registers(items, "x", 3)


def test_sketch_registry(spark, tmp_path):
    r = sketches.Registry(spark, str(tmp_path))
    for part in (["a"], ["a", "b"]):
        r.add("cms", "c", sketches.cms_cells(spark.createDataFrame([(x,) for x in part], "x string"), "x", 100, 3))
    probes = spark.createDataFrame([("a",)], "x string")
    assert sketches.cms_query(r.load("cms", "c"), probes, "x", 100, 3).first()["estimate"] == 2
    assert r.drop("cms", "c")
    with pytest.raises(KeyError):
        r.load("cms", "c")


def test_token_bucket():
    b, state, out = config.Bucket(), (0, 10), []
    for t in [0] * 11 + [25, 25]:
        last, tokens, ok = buckets.step(*state, t, b)
        state = (last, tokens)
        out.append(ok)
    assert out == [True] * 10 + [False, True, False] and state == (20, 0)


def test_token_bucket_batch_forms_agree(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.randrange(4000), i) for i in range(300)]
    d = spark.createDataFrame(rows, "b long, t long, o long")
    b = config.Bucket(tokens=3, refill_amount=2, refill_seconds=70)
    one = {(r["b"], r["o"]): r["allowed"] for r in buckets.decide(d, "b", "t", "o", b).collect()}
    two = {(r["b"], r["o"]): r["allowed"] for r in buckets.decide_large(d, "b", "t", "o", b).collect()}
    assert one == two and len(one) == 300 and not all(one.values())


def test_wal_sizes(spark):
    got = [r[0] for r in spark.createDataFrame([(4075,), (4076,), (8150,), (8151,)], "n long").select(lsm.fragments(F.col("n"), 4096)).collect()]
    assert got == [1, 2, 2, 3]


def test_value_tags(spark):
    d = spark.createDataFrame([("\x00hi",), ("\x03img",), ("\x0bsnd",), ("\x15doc",), ("",)], "v string")
    assert [tuple(r) for r in d.select(text.value_kind(F.col("v")), text.untag_value(F.col("v"))).collect()] == [("text", "hi"), ("image", "img"), ("audio", "snd"), ("document", "doc"), (None, "")]


def test_lru():
    c = Lru(2)
    c.put("a", 1)
    c.put("b", 2)
    assert c.get("a") == 1 and c.peek("b") == 2
    c.put("c", 3)
    assert "b" not in c and len(c) == 2 and c.get("b", 9) == 9
    c.resize(1)
    assert "c" in c and c.remove("c") and not c.remove("c")
    with pytest.raises(ValueError):
        c.resize(-1)


def test_settings(tmp_path):
    s = config.from_json('{"memtable": {"capacity": 5}}')
    assert s.memtable.capacity == 5 and s.tree.max_levels == 7
    config.save(s, str(tmp_path / "c.json"))
    assert config.load(str(tmp_path / "c.json")) == s and config.load(str(tmp_path / "none")) == config.Settings()
    for bad in ('{"memtable": {"capacity": 0}}', '{"bloom": {"false_positive_rate": 1.5}}', '{"tree": {"compaction": "x"}}', '{"nope": {}}'):
        with pytest.raises(ValueError):
            config.from_json(bad)


@pytest.mark.parametrize("strategy", ["size", "level"])
def test_compaction_leaves_the_snapshot_unchanged(spark, tmp_path, strategy):
    settings_ = config.from_json('{"tree": {"max_tables_per_level": 2, "max_levels": 3, "compaction": "%s"}}' % strategy)
    runs, rng, ops, dict_ = lsm.RunStore(spark, str(tmp_path), settings_), random.Random(5), [], {}
    for i in range(60):
        k, v = f"k{rng.randrange(12):02d}", None if rng.random() < 0.3 else str(i)
        ops.append((k, v))
        dict_[k] = v
    want = {k: v for k, v in dict_.items() if v is not None}
    log = log_of(spark, ops)
    for i in range(0, 60, 10):
        runs.flush(log.filter(F.col("seq").between(i, i + 9)))
        runs.compact()
    assert state(snapshot.live(runs.log())) == want
    m = runs.manifest().collect()
    assert all(sum(r["level"] == lv for r in m) <= 2 for lv in range(2)) and not runs.data_lost()


def test_layers_and_counts(spark):
    ops = [("a", "1"), ("b", "1"), ("a", None), ("c", "1")]
    log = log_of(spark, ops)
    assert state(snapshot.layered(log.filter("seq < 2"), log.filter("seq >= 2"))) == {"b": "1", "c": "1"}
    assert tuple(snapshot.counts(log).first()) == (3, 2, 4)
    assert [tuple(r) for r in scans.key_dictionary(log).orderBy("id").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    assert [r["existed"] for r in snapshot.delete_effects(log_of(spark, [("x", None), ("x", "1"), ("x", None), ("x", None)])).orderBy("seq").collect()] == [False, True, False]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.one_of(st.none(), st.text("xyz", min_size=1, max_size=3))), min_size=1, max_size=30))
def test_snapshot_is_a_dictionary_replay(spark, ops):
    want = {}
    for k, v in ops:
        want[k] = v
    assert state(snapshot.live(log_of(spark, ops))) == {k: v for k, v in want.items() if v is not None}


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.put("a1", b"x")
    e.put("a2", b"y")
    assert e.get("a1")["value"] == b"x" and e.delete("a1") and not e.delete("a1") and e.get("a1") is None
    assert e.flush() == 0 and e.flush() is None and e.levels()[0] == [0]
    e.put("a3", b"z")
    assert e.prefix_scan("a") == ["a2", "a3"] and e.range_scan("a2", "a2") == ["a2"] and e.prefix_iterate("a", "a2")["key"] == "a3"
    e.seal(0)
    assert e.check(0)["passed"] and e.has_data() and not e.is_data_lost() and e.statistics()["runs"] == 1
    with pytest.raises(ValueError):
        e.put("", b"x")
    again = Engine(spark, str(tmp_path))
    assert again.prefix_scan("a") == ["a2", "a3"] and again._seq == e._seq
    assert all(e.allow() for _ in range(10)) and not e.allow()


def records(spark, rows):
    """rows: (key, value or None, seq)."""
    return spark.createDataFrame([(k, None if v is None else bytearray(v.encode()), v is None, 7, q) for k, v, q in rows], model.RECORD)


def test_stream_to_runs_keeps_late_files(spark, tmp_path):
    path, at = str(tmp_path / "log"), str(tmp_path / "cp")
    runs = lsm.RunStore(spark, str(tmp_path / "runs"), config.from_json('{"tree": {"max_tables_per_level": 1, "max_levels": 3}}'))
    parts = [[("a", "1", 1), ("b", "1", 2), ("x", None, 500)], [("c", "1", 3), ("x", "late", 4)], [("d", "1", 5), ("e", "1", 600), ("a", "2", 7)]]
    for part in parts:
        source.append(records(spark, part), path)
        ingest.to_runs(source.stream(spark, path), runs, at).awaitTermination(120)
    assert state(snapshot.live(runs.log())) == {"a": "2", "b": "1", "c": "1", "d": "1", "e": "1"}
    (query,) = runs.batches()
    assert runs.batches()[query] == 2
    with pytest.raises(ValueError):
        source.append(log_of(spark, [("", "1")]), path)


def test_stream_to_runs_skips_a_replayed_batch(spark, tmp_path):
    path, at = str(tmp_path / "log"), tmp_path / "cp"
    runs = lsm.RunStore(spark, str(tmp_path / "runs"), config.Settings())
    for part in ([("a", "1", 1)], [("b", "1", 2)]):
        source.append(records(spark, part), path)
        ingest.to_runs(source.stream(spark, path), runs, str(at)).awaitTermination(120)
    for f in (at / "commits").glob("*1*"):  # as if the driver had died after the manifest, before the stream's own commit
        f.unlink()
    ingest.to_runs(source.stream(spark, path), runs, str(at)).awaitTermination(120)
    assert runs.manifest().count() == 2 and state(runs.log()) == {"a": "1", "b": "1"}


def stream_rows(spark, path, df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streaming_aggregates(spark, tmp_path):
    path, rng = str(tmp_path / "log"), random.Random(3)
    ops = [(f"k{rng.randrange(20)}", None if rng.random() < 0.2 else str(i)) for i in range(120)]
    log = log_of(spark, ops)
    for i in range(0, 120, 40):
        source.append(log.filter(F.col("seq").between(i, i + 39)), path)
    stream = lambda: source.stream(spark, path, 1)
    got = stream_rows(spark, tmp_path, ingest.latest(stream()), "complete", "latest").select("key", "value", "tombstone", "seq")
    assert sorted(map(str, got.collect())) == sorted(map(str, snapshot.newest(log).select("key", "value", "tombstone", "seq").collect()))
    pairs = [
        (ingest.sketch_cells(stream(), "key", 50, 3), sketches.cms_cells(log, "key", 50, 3), "cells"),
        (ingest.sketch_registers(stream(), "key", 6), sketches.hll_registers(log, "key", 6), "registers"),
        (ingest.sketch_bits(stream(), "key", 100, 3).select("bit"), sketches.bloom_bits(log, "key", 100, 3), "bits"),
    ]
    for streamed, batch, name in pairs:
        assert sorted(map(tuple, stream_rows(spark, tmp_path, streamed, "complete", name).collect())) == sorted(map(tuple, batch.collect()))
    assert [r["seq"] for r in source.replay(spark, path, 100).collect()] == list(range(101, 120))
    assert abs(sketches.native_distinct(log, "key").first()[0] - len({k for k, _ in ops})) <= 2


def test_log_segments_go_below_the_watermark(spark, tmp_path):
    path = str(tmp_path / "log")
    assert source.low_watermark(spark, path) is None and source.retain(spark, path, 9) == 0
    for part in ([("a", "1", 0), ("b", "1", 1)], [("c", "1", 2), ("d", "1", 9)], [("e", "1", 3)]):
        source.append(records(spark, part).coalesce(1), path)
    assert source.low_watermark(spark, path) == 0
    assert source.retain(spark, path, 3) == 2  # a segment with a later record stays whole
    assert keys(source.read(spark, path).orderBy("key")) == ["c", "d"] and source.low_watermark(spark, path) == 2


def test_media_as_tagged_values(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.png").write_bytes(b"\x89PNG")
    r = source.media(spark, str(tmp_path / "m"), text.FILE_TYPES["png"]).first()
    assert bytes(r["value"]) == b"\x01\x89PNG" and r["key"].endswith("a.png") and r["timestamp"] > 0


def test_buckets_of_null_and_of_large_numbers(spark, tmp_path):
    b = config.Bucket(tokens=2, refill_amount=1, refill_seconds=100)
    big = 2**60
    rows = [(None, i, i) for i in range(4)] + [(big, i, 10 + i) for i in range(3)] + [(big + 1, 0, 20)]
    d = spark.createDataFrame(rows, "b long, t long, o long")
    want = sorted([("None", o, o < 2) for o in range(4)] + [(str(big), o, o < 12) for o in (10, 11, 12)] + [(str(big + 1), 20, True)])
    for f in (buckets.decide, buckets.decide_large):
        assert sorted((str(r["b"]), r["o"], r["allowed"]) for r in f(d, "b", "t", "o", b).collect()) == want
    small = d.filter("b is null or b < 0").unionByName(spark.createDataFrame([(5, 0, 30), (5, 1, 31), (5, 2, 32)], "b long, t long, o long"))
    for i in range(2):  # two files, so that state goes from batch to batch
        small.filter(F.pmod("o", F.lit(2)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "r"))
    got = stream_rows(spark, tmp_path, buckets.decide_stream(stream, "b", "t", "o", b), "append", "decided").collect()
    assert sum(r["allowed"] for r in got if r["b"] is None) == 2 and sum(r["allowed"] for r in got if r["b"] == 5) == 2 and len(got) == 7


def test_engine_flushes_at_capacity(spark, tmp_path):
    e = Engine(spark, str(tmp_path), config.from_json('{"memtable": {"capacity": 2}, "tree": {"max_memtables": 2}}'))
    for i in range(9):
        e.put(f"k{i}", b"v")
    assert e.statistics()["runs"] == 2 and [r["key"] for r in e.items()] == [f"k{i}" for i in range(9)]
    assert [r["key"] for r in e.runs.iterate(0)] == ["k0", "k1", "k2", "k3"] and len(source.segments(spark, f"{tmp_path}/log")) == 1
    assert keys(e.runs.summary(0)) == ["k0"]


def test_two_engines_keep_every_record(spark, tmp_path):
    one, two = Engine(spark, str(tmp_path)), Engine(spark, str(tmp_path))
    one.put("a", b"1")
    two.put("b", b"1")
    two.put("a", b"2")
    assert one.flush() == 0
    one.put("c", b"1")
    two.put("a", b"3")
    assert one.get("a")["value"] == b"3" and two.prefix_scan("") == ["a", "b", "c"]
    two.flush()
    assert one.flush() is None and one.prefix_scan("") == ["a", "b", "c"] and Engine(spark, str(tmp_path)).get("a")["value"] == b"3"


def test_engine_bucket_outlives_it(spark, tmp_path):
    s = config.from_json('{"bucket": {"tokens": 2, "refill_seconds": 100000}}')
    e = Engine(spark, str(tmp_path), s, limited=True)
    e.put("a", b"1")
    assert e.execute(e.get, "a")["value"] == b"1" and e.bucket_status()["tokens"] == 0
    again = Engine(spark, str(tmp_path), s, limited=True)
    for call in (lambda: again.put("b", b"1"), lambda: again.delete("a"), lambda: again.execute(again.get, "a")):
        with pytest.raises(RateLimited):
            call()
    assert again.get("b") is None
    again.reset_bucket()
    assert again.bucket_status()["tokens"] == 2 and e.allow()


def test_key_dictionary_stays(spark, tmp_path):
    d = scans.KeyDictionary(spark, str(tmp_path / "d"))
    assert d.id_of("a") is None and d.add(log_of(spark, [("b", "1"), ("a", "1"), ("b", "2")])) == 2
    assert (d.id_of("b"), d.id_of("a"), d.key_of(2), d.key_of(3)) == (1, 2, "a", None)
    again = scans.KeyDictionary(spark, str(tmp_path / "d"))
    assert again.add(log_of(spark, [("c", "1"), ("a", "1")])) == 1 and again.add_key("c") == 3 and again.add_key("e") == 4
    assert {r["key"]: r["key_id"] for r in again.encode(spark.createDataFrame([("a",), ("z",)], "key string")).collect()} == {"a": 2, "z": None}


def test_named_sketches_know_their_sizes(spark, tmp_path):
    r = sketches.Registry(spark, str(tmp_path))
    items = spark.createDataFrame([("a",), ("a",), ("b",)], "x string")
    probes = spark.createDataFrame([("a",), ("zz",)], "y string")
    r.create("bloom", "s", items=100, rate=0.01)
    r.create("cms", "s", epsilon=0.01, delta=0.01)
    r.create("hll", "s", precision=10)
    assert r.empty_registers("s") == 1024 and r.estimate("s") == 0 and r.sizes("bloom", "s")["m"] == 959
    for kind in ("bloom", "cms", "hll"):
        r.add_items(kind, "s", items, "x", part="first")
        r.add_items(kind, "s", items, "x", part="first")  # a retry counts once
        r.add_items(kind, "s", items, "x")
        with pytest.raises(ValueError):
            r.create(kind, "s", items=1, rate=0.1, epsilon=0.1, delta=0.1, precision=10)
        with pytest.raises(KeyError):
            r.add_items(kind, "none", items, "x")
    assert {x["y"]: x["maybe"] for x in r.test("s", probes, "y").collect()} == {"a": True, "zz": False}
    assert {x["y"]: x["estimate"] for x in r.count("s", probes, "y").collect()} == {"a": 4, "zz": 0}
    assert round(r.estimate("s")) == 2 and r.empty_registers("s") == 1022
    with pytest.raises(ValueError):
        r.create("hll", "t", precision=3)
    a = r.save_fingerprint("one", "hello world hello")
    r.save_fingerprint("two", "apple banana apple apple")
    assert a == "e3e1efd54283d94f7081314b599d31b3" and r.compare("one", "one") == {"distance": 0, "band": "Identical", "similarity": 100}
    assert r.compare("one", "two") == sketches.compare_documents(spark, "hello world hello", "apple banana apple apple")
    with pytest.raises(Exception, match="32 hex digits"):
        sketches.compare(spark, a, a[:-1])
    assert [x[0] for x in spark.createDataFrame([("0" * 32,), (a,)], "f string").select(hashing.is_zero(F.col("f"))).collect()] == [True, False]


def test_fnv_and_simhash_of_batches():
    def fnv(word):
        h = 0x6C62272E07BB014262B821756295C58D
        for c in word.encode():
            h = (h ^ c) * ((1 << 88) + 0x13B) % 2**128
        return h.to_bytes(16, "big")

    rng = random.Random(1)
    words = ["", "a", "ključ", "x" * 300, *("".join(chr(rng.randrange(32, 1000)) for _ in range(rng.randrange(20))) for _ in range(200))]
    assert [bytes(h) for h in hashing.fnv128(words)] == [fnv(w) for w in words]
    texts = [rng.choices(words, k=rng.randrange(30)) for _ in range(20)] + [None, []]
    for t, got in zip(texts, hashing.simhashes(texts)):
        if not t:
            assert got == (None if t is None else "f" * 32)
            continue
        votes = [sum(1 if int.from_bytes(fnv(w), "big") >> (127 - i) & 1 else -1 for w in t) for i in range(128)]
        assert got == f"{int(''.join('1' if v >= 0 else '0' for v in votes), 2):032x}"


def test_positions_in_many_ranges(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(run, f"{rng.choice(['user_', 'üser_', ''])}{i}", rng.randrange(9)) for run in (1, 2) for i in rng.sample(range(10_000), 900)]
    d = spark.createDataFrame(rows, "run_id long, key string, size long")
    want = []
    for run in (1, 2):
        at = 0
        for n, (_, k, z) in enumerate(sorted((r for r in rows if r[0] == run), key=lambda r: r[1].encode())):
            want.append((run, k, n, at))
            at += z
    for size in (1 << 16, 50):
        monkeypatch.setattr(lsm, "RANGE", size)
        got = lsm.positions(d, "size")
        assert sorted((r["run_id"], r["key"], r["position"], r["offset"]) for r in got.collect()) == sorted(want)
    assert lsm.positions(d.limit(0)).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(run_id" in plan and "range" in plan


def test_merkle_visits_and_bytes(spark):
    leaf = integrity.leaves_of(spark.createDataFrame([(i, f"block{i + 1}") for i in range(5)], "i long, v string"), "i", "v")
    other = leaf.filter("pos < 2").withColumn("run_id", F.lit(1).cast("long"))
    nodes = integrity.tree(leaf.unionByName(other))
    got = [(r["height"], r["pos"]) for r in integrity.depth_first(nodes).filter("run_id = 0").orderBy("number").collect()]
    assert got == [(3, 0), (2, 0), (1, 0), (0, 0), (0, 1), (1, 1), (0, 2), (0, 3), (2, 1), (1, 2), (0, 4)]
    assert [(r["height"], r["pos"]) for r in integrity.depth_first(nodes).filter("run_id = 1").orderBy("number").collect()] == [(1, 0), (0, 0), (0, 1)]
    again = integrity.deserialised(integrity.serialised(nodes)).select(*nodes.columns)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, nodes.collect()))
    assert (integrity.height(5), integrity.most_leaves(3), integrity.most_nodes(3)) == (3, 8, 15)


def test_blocks_with_checksums(spark):
    rng = random.Random(4)
    raws = [rng.randbytes(n) for n in (0, 1, 60, 61, 500)]
    d = spark.createDataFrame([(bytearray(r),) for r in raws], "raw binary").withColumn("blocks", codec.sealed(F.col("raw"), 64))
    d = d.withColumn("back", codec.unsealed(F.col("blocks"), F.octet_length("raw")))
    for r in d.withColumn("whole", F.forall("blocks", codec.intact)).collect():
        raw = bytes(r["raw"])
        parts = [raw[i : i + 60].ljust(60, b"\0") for i in range(0, len(raw), 60)]
        assert [bytes(b) for b in r["blocks"]] == [zlib.crc32(p).to_bytes(4, "little") + p for p in parts] and bytes(r["back"]) == raw and r["whole"]
    bad = spark.createDataFrame([(bytearray(b"\0" * 4 + b"ab"),), (bytearray(b"ab"),)], "b binary")
    assert [r[0] for r in bad.select(codec.intact(F.col("b"))).collect()] == [False, False]
    assert bad.limit(1).select(codec.intact(codec.resealed(F.col("b")))).first()[0]


def test_file_types_of_values(spark):
    d = spark.createDataFrame([("x", "PNG"), ("x", "md"), ("x", "exe"), ("x", "")], "v string, t string").select(text.tag_typed(F.col("v"), F.col("t")).alias("v"))
    assert [tuple(r) for r in d.select(text.value_type(F.col("v")), text.value_kind(F.col("v")), text.untag_value(F.col("v"))).collect()] == [("png", "image", "x"), ("md", "document", "x"), ("", "text", "x"), ("", "text", "x")]


def test_scan_plan_pushes_down(spark, tmp_path):
    source.append(log_of(spark, [("a", "1")]), str(tmp_path / "l"))
    plan = scans.prefix_scan(source.read(spark, str(tmp_path / "l")), "a")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,a)" in plan and "TakeOrderedAndProject" in plan
