"""The registered queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import model
from tidelog.config import Bucket, Memtable, Settings, Tree
from tidelog.engine import Engine
from tidelog.functions import codec, hashing, text
from tidelog.operators import integrity, lsm, scans, sketches
from tidelog.plans import snapshot
from tidelog.sources import log as source
from tidelog.streaming import buckets, ingest

CAPACITY, MOST, STEP, AS_OF = 1000, 4, 10, 5000
BLOOM = sketches.bloom_size(1000, 0.01)
PREFIX_BLOOM = sketches.bloom_size(11_000, 0.01)
CMS = sketches.cms_size(0.01, 0.01)
PRECISION = 10
BUCKET = Bucket(tokens=10, refill_amount=1, refill_seconds=20_000)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.events_log(_table(spark, sf_dir, "events"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.orders_log(_table(spark, sf_dir, "orders"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.part_log(_table(spark, sf_dir, "part"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.flush(lsm.with_runs(_events(spark, sf_dir), CAPACITY))


E = """e as (select 'user_' || lpad(user_id::VARCHAR, 6, '0') as key, case when event_type <> 'error' then props end as value,
  event_type = 'error' as tombstone, epoch_us(ts) // 1000000 as timestamp, event_id as seq from events)"""
O = """o as (select 'cust_' || lpad(o_custkey::VARCHAR, 8, '0') || '/' || lpad(o_orderkey::VARCHAR, 10, '0') as key,
  case when o_orderstatus <> 'F' then o_orderpriority end as value, o_orderstatus = 'F' as tombstone,
  epoch_us(o_orderdate) // 1000000 as timestamp, o_orderkey as seq from orders)"""
P = "p as (select p_name || '#' || lpad(p_partkey::VARCHAR, 8, '0') as key, p_type as value, p_partkey as seq from part)"


def _newest(source: str, by: str = "key", where: str = "") -> str:
    return f"(select * from (select *, row_number() over (partition by {by} order by seq desc) as rn from {source} {where}) where rn = 1)"


RUNS = f"r as (select seq // {CAPACITY} as run_id, * exclude (rn) from (select *, row_number() over (partition by seq // {CAPACITY}, key order by seq desc) as rn from e) where rn = 1)"


# --- snapshots and scans ---------------------------------------------------------


@query(f"with {E} select key, value, timestamp, seq from {_newest('e')} where not tombstone")
def kv_snapshot(spark, sf_dir):
    return snapshot.live(_events(spark, sf_dir)).select("key", "value", "timestamp", "seq")


@query(f"with {E} select key, value, timestamp, seq from {_newest('e', where=f'where seq <= {AS_OF}')} where not tombstone")
def kv_state_as_of(spark, sf_dir):
    return snapshot.state_as_of(_events(spark, sf_dir), AS_OF).select("key", "value", "timestamp", "seq")


@query(f"with {E} select key, value, timestamp, tombstone as deleted from {_newest('e')} where not tombstone and key = 'user_000042'")
def kv_get(spark, sf_dir):
    return scans.get(_events(spark, sf_dir), "user_000042")


@query(f"with {E}, c as (select distinct 'user_' || lpad(c_custkey::VARCHAR, 6, '0') as key from customer) select key, value, timestamp, seq from {_newest('e')} where not tombstone and key in (select key from c)")
def kv_get_many(spark, sf_dir):
    keys = _table(spark, sf_dir, "customer").select(F.concat(F.lit("user_"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))
    return scans.get_many(_events(spark, sf_dir), keys).select("key", "value", "timestamp", "seq")


@query(f"with {E}, l as (select key, seq, tombstone, lag(tombstone) over (partition by key order by seq) as b from e) select key, seq, coalesce(not b, false) as existed from l where tombstone")
def kv_delete_effect(spark, sf_dir):
    return snapshot.delete_effects(_events(spark, sf_dir))


@query(f"with {E} select key from {_newest('e')} where not tombstone and starts_with(key, 'user_000') order by key limit 10")
def kv_prefix_scan(spark, sf_dir):
    return scans.prefix_scan(_events(spark, sf_dir), "user_000", 10)


@query(f"with {E} select key from {_newest('e')} where not tombstone and starts_with(key, 'user_000') order by key limit 10 offset 20")
def kv_prefix_scan_page2(spark, sf_dir):
    return scans.prefix_scan(_events(spark, sf_dir), "user_000", 10, 2)


@query(f"with {P} select key, value from p where starts_with(key, 'blue ') order by key limit 25")
def kv_prefix_scan_text(spark, sf_dir):
    return scans.prefix_scan(_parts(spark, sf_dir), "blue ", 25, keys_only=False).select("key", "value")


@query(f"with {O} select key from {_newest('o')} where not tombstone and key between 'cust_00000010' and 'cust_00000500' order by key limit 20")
def kv_range_scan(spark, sf_dir):
    return scans.range_scan(_orders(spark, sf_dir), "cust_00000010", "cust_00000500", 20)


@query(f"with {O} select key from {_newest('o')} where not tombstone and key between 'cust_00000010' and 'cust_00000500' order by key limit 20 offset 40")
def kv_range_scan_page2(spark, sf_dir):
    return scans.range_scan(_orders(spark, sf_dir), "cust_00000010", "cust_00000500", 20, 2)


@query(f"with {O} select key, value, seq from {_newest('o')} where not tombstone and starts_with(key, 'cust_') and key > 'cust_00000300' order by key limit 20")
def kv_prefix_after(spark, sf_dir):
    return scans.prefix_after(_orders(spark, sf_dir), "cust_", "cust_00000300", 20).select("key", "value", "seq")


@query(f"with {E} select key, value, seq from {_newest('e')} where not tombstone and starts_with(key, 'user_') and key > 'user_000077' order by key limit 1")
def kv_prefix_iterate(spark, sf_dir):
    return scans.prefix_iterate(_events(spark, sf_dir), "user_", "user_000077").select("key", "value", "seq")


@query(f"with {O} select key, value, seq from {_newest('o')} where not tombstone and key between 'cust_00000200' and 'cust_00000900' and key > 'cust_00000100' order by key limit 1")
def kv_range_iterate(spark, sf_dir):
    return scans.range_iterate(_orders(spark, sf_dir), "cust_00000200", "cust_00000900", "cust_00000100").select("key", "value", "seq")


@query(f"with {E} select (select count(*) from {_newest('e')}) as total_keys, (select count(*) from {_newest('e')} where not tombstone) as active_keys, (select count(*) from e) as versions")
def kv_counts(spark, sf_dir):
    return snapshot.counts(_events(spark, sf_dir))


@query(f"with {E}, f as (select key, min(seq) as s from e group by key) select row_number() over (order by s, key) as id, key from f")
def kv_key_dictionary(spark, sf_dir):
    return scans.key_dictionary(_events(spark, sf_dir))


@query(f"with {E} select key, seq, 25 + octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0) as plain, case when tombstone then 17 else 25 + coalesce(octet_length(encode(value)), 0) end as compressed from e")
def kv_record_sizes(spark, sf_dir):
    return _events(spark, sf_dir).select("key", "seq", lsm.plain_size().alias("plain"), lsm.compressed_size().alias("compressed"))


@query("""with s as (select doc_id, 25 + octet_length(encode(doc_id::VARCHAR)) + octet_length(encode(text)) as size from documents)
select doc_id, case when size + 21 <= 4096 then 1 else ceil(size / 4075.0)::BIGINT end as fragments from s""")
def wal_fragments(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value"))
    return docs.select("doc_id", lsm.fragments(lsm.plain_size(), 4096).alias("fragments"))


@query(f"with {E} select key, value, tombstone, timestamp, seq from e")
def record_round_trip(spark, sf_dir):
    """Records to their plain binary form and back."""
    d = _events(spark, sf_dir).select("seq", codec.from_plain(codec.plain()).alias("r"))
    return d.select("r.key", F.decode("r.value", "UTF-8").alias("value"), "r.tombstone", "r.timestamp", "seq")


@query(f"with {E}, f as (select key, min(seq) as s from e group by key), k as (select row_number() over (order by s, key) as key_id, key from f) select key_id, value, tombstone, timestamp, seq from e join k using (key)")
def record_round_trip_compressed(spark, sf_dir):
    """The same with numbers of the key dictionary in place of keys."""
    log = _events(spark, sf_dir)
    d = log.join(scans.key_dictionary(log), "key").select("seq", codec.from_compressed(codec.compressed(F.col("id"))).alias("r"))
    return d.select("r.key_id", F.decode("r.value", "UTF-8").alias("value"), "r.tombstone", "r.timestamp", "seq")


@query("""with s as (select doc_id, 25 + octet_length(encode(doc_id::VARCHAR)) + coalesce(octet_length(encode(text)), 0) as size from documents),
n as (select doc_id, size, ceil(size / 4075.0)::BIGINT as n from s), i as (select *, unnest(range(0, n)) as frame from n)
select doc_id, frame, case when n = 1 then 4 when frame = 0 then 1 when frame = n - 1 then 3 else 2 end as kind, least(4075, size - 4075 * frame) as payload from i""")
def wal_frames(spark, sf_dir):
    """The log frames of a record for each document."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value"), F.lit(False).alias("tombstone"), F.lit(0).alias("timestamp"))
    d = d.select("doc_id", F.posexplode(codec.frames(codec.plain())).alias("frame", "raw"))
    return d.select("doc_id", F.col("frame").cast("long").alias("frame"), codec.frame_kind(F.col("raw")).alias("kind"), codec.whole(F.col("raw"), 1).alias("payload"))


@query("select case when event_type in ('click', 'view') then 'text' else 'image' end as kind, event_type || ':' || props as value, count(*) as n from events group by all")
def kv_value_tags(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    tagged = F.when(F.col("event_type").isin("click", "view"), text.tag_value(F.concat("event_type", F.lit(":"), "props"), 0)).otherwise(text.tag_value(F.concat("event_type", F.lit(":"), "props"), 3))
    e = e.select(tagged.alias("v"))
    return e.groupBy(text.value_kind(F.col("v")).alias("kind"), text.untag_value(F.col("v")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


# --- runs and compaction ---------------------------------------------------------


@query(f"with {E}, {RUNS} select run_id, key, value, tombstone, timestamp, seq from r")
def lsm_flush_runs(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_id", "key", "value", "tombstone", "timestamp", "seq")


BOUNDS = "b as (select run_id, min(key) as min_key, max(key) as max_key, count(*) as records, count(*) filter (where tombstone) as tombstones, max(seq) as max_seq from r group by run_id)"
LEVELS = f"m as (select case when run_id % 3 = 0 then 0 else 1 end as level, row_number() over (partition by case when run_id % 3 = 0 then 0 else 1 end order by max_seq)::INTEGER - 1 as pos, * from b)"


@query(f"with {E}, {RUNS}, {BOUNDS} select * from b")
def lsm_boundaries(spark, sf_dir):
    return lsm.boundaries(_runs(spark, sf_dir))


def _manifest(spark, sf_dir):
    from pyspark.sql import Window

    b = lsm.boundaries(_runs(spark, sf_dir)).withColumn("level", F.when(F.col("run_id") % 3 == 0, 0).otherwise(1))
    return b.withColumn("pos", F.row_number().over(Window.partitionBy("level").orderBy("max_seq")) - 1)


@query(f"with {E}, {RUNS}, {BOUNDS}, {LEVELS} select level, count(*) as runs, sum(records)::BIGINT as records, sum(tombstones)::BIGINT as tombstones, min(min_key) as min_key, max(max_key) as max_key from m group by level")
def lsm_level_stats(spark, sf_dir):
    return lsm.level_statistics(_manifest(spark, sf_dir))


@query(f"with {E}, {RUNS}, {BOUNDS}, {LEVELS} select level, string_agg(run_id::VARCHAR, ',' order by pos) as runs from m group by level")
def lsm_levels(spark, sf_dir):
    return lsm.level_lists(_manifest(spark, sf_dir)).select("level", F.concat_ws(",", F.transform("runs", lambda r: r.cast("string"))).alias("runs"))


@query(f"with {E}, {RUNS}, {BOUNDS}, {LEVELS}, c as (select level, count(*) as n from m group by level) select count(*) as levels, sum(n)::BIGINT as runs, max(n) as most_in_a_level from c")
def lsm_totals(spark, sf_dir):
    return lsm.totals(_manifest(spark, sf_dir))


@query(f"with {E}, {RUNS}, {BOUNDS} select max(run_id) + 1 as next_run from b")
def lsm_next_run(spark, sf_dir):
    return lsm.with_runs(_events(spark, sf_dir), CAPACITY).agg(F.coalesce(F.max("run_id") + 1, F.lit(0)).alias("next_run"))


@query(f"with {E}, {RUNS}, s as (select run_id, row_number() over (partition by run_id order by key) - 1 as position, key from r) select * from s where position % {STEP} = 0")
def lsm_sparse_summary(spark, sf_dir):
    return lsm.sparse_summary(_runs(spark, sf_dir), STEP)


@query(f"with {E}, {RUNS} select run_id, min(key) as key from r where key > 'user_000050' group by run_id")
def lsm_lower_bound(spark, sf_dir):
    return lsm.lower_bound(_runs(spark, sf_dir), "user_000050")


@query(f"with {E}, {RUNS} select run_id, key, (coalesce(sum(25 + octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)) over (partition by run_id order by key rows between unbounded preceding and 1 preceding), 0))::BIGINT as \"offset\" from r")
def lsm_index_offsets(spark, sf_dir):
    return lsm.offsets(_runs(spark, sf_dir))


@query(f"with {E}, {RUNS}, {BOUNDS}, {LEVELS}, a as (select * from m where level = 0 order by pos limit 1) select a.run_id as run, m.run_id as overlaps from m join a on m.min_key <= a.max_key and m.max_key >= a.min_key where m.level = 1")
def lsm_overlaps(spark, sf_dir):
    return lsm.overlapping(_manifest(spark, sf_dir), 0)


@query(f"with {E}, {RUNS}, x as (select * from r where run_id < {MOST}) select key, value, tombstone, timestamp, seq from {_newest('x')}")
def lsm_compact_size(spark, sf_dir):
    """The oldest runs of a level, merged into the next: tombstones stay for what lies below."""
    return lsm.compact(_runs(spark, sf_dir).filter(F.col("run_id") < MOST), bottom=False).select("key", "value", "tombstone", "timestamp", "seq")


@query(f"with {E}, {RUNS}, x as (select * from r where run_id = 0 or run_id % 3 <> 0) select key, value, tombstone, timestamp, seq from {_newest('x')} where not tombstone")
def lsm_compact_level(spark, sf_dir):
    """The oldest run of level 0 with the runs of level 1, the bottom, that it overlaps."""
    runs = _runs(spark, sf_dir).filter((F.col("run_id") == 0) | (F.col("run_id") % 3 != 0))
    return lsm.compact(runs, bottom=True).select("key", "value", "tombstone", "timestamp", "seq")


@query(f"with {E} select key, value, timestamp, seq from {_newest('e')} where not tombstone")
def lsm_layered_merge(spark, sf_dir):
    log = _events(spark, sf_dir)
    layers = [log.filter(F.pmod("seq", F.lit(3)) == k) for k in range(3)]
    return snapshot.layered(*layers).select("key", "value", "timestamp", "seq")


# --- sketches --------------------------------------------------------------------


def _seeded(item: str, seed: str, m: int) -> str:
    return f"((('0x' || substr(md5({item} || unhex(lpad(hex({seed}), 16, '0'))), 1, 16))::UBIGINT) % {m})::INTEGER"


def _bits(rows: str, m: int, k: int) -> str:
    return f"(select distinct {_seeded('raw', 'i', m)} as bit from {rows}, (select unnest(range(0, {k})) as i))"


@query(f"with {E} select bit from {_bits('(select distinct encode(key) as raw from e)', *BLOOM)}")
def bloom_bits(spark, sf_dir):
    return sketches.bloom_bits(_events(spark, sf_dir), "key", *BLOOM)


@query(f"""with {E}, b as {_bits('(select distinct encode(key) as raw from e)', *BLOOM)},
p as (select distinct 'user_' || lpad(o_custkey::VARCHAR, 6, '0') as key from orders),
h as (select key, {_seeded('encode(key)', 'i', BLOOM[0])} as bit from p, (select unnest(range(0, {BLOOM[1]})) as i))
select key, count(b.bit) = {BLOOM[1]} as maybe from h left join b on h.bit = b.bit group by key""")
def bloom_test(spark, sf_dir):
    bits = sketches.bloom_bits(_events(spark, sf_dir), "key", *BLOOM)
    probes = _table(spark, sf_dir, "orders").select(F.concat(F.lit("user_"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("key"))
    return sketches.bloom_test(bits, probes, "key", *BLOOM)


PREFIXES = """x as (select encode(key) as raw from e union select unhex('000102') union
  select unhex('000102' || substr(hex(encode(key)), 1, 2 * n::BIGINT)) from e, (select unnest(range(1, 11)) as n) where n <= octet_length(encode(key)))"""


@query(f"with {E}, {PREFIXES} select bit from {_bits('x', *PREFIX_BLOOM)}")
def prefix_bloom_bits(spark, sf_dir):
    return sketches.prefix_bloom_bits(_events(spark, sf_dir), "key", *PREFIX_BLOOM)


@query(f"""with {E}, {PREFIXES}, b as {_bits('x', *PREFIX_BLOOM)}, p as (select distinct left('user_' || lpad(o_custkey::VARCHAR, 6, '0'), 9) as key from orders),
h as (select key, {_seeded("unhex('000102' || substr(hex(encode(key)), 1, 20))", 'i', PREFIX_BLOOM[0])} as bit from p, (select unnest(range(0, {PREFIX_BLOOM[1]})) as i))
select key, count(b.bit) = {PREFIX_BLOOM[1]} as maybe from h left join b on h.bit = b.bit group by key""")
def prefix_bloom_test(spark, sf_dir):
    bits = sketches.prefix_bloom_bits(_events(spark, sf_dir), "key", *PREFIX_BLOOM)
    probes = _table(spark, sf_dir, "orders").select(F.substring(F.concat(F.lit("user_"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")), 1, 9).alias("key"))
    return sketches.prefix_bloom_test(bits, probes, "key", *PREFIX_BLOOM)


def _cells(rows: str) -> str:
    return f"(select i::INTEGER as row, {_seeded('encode(x)', 'i', CMS[0])} as col, count(*) as cnt from {rows}, (select unnest(range(0, {CMS[1]})) as i) group by all)"


@query(f"select * from {_cells('(select user_id::VARCHAR as x from events)')}")
def cms_cells(spark, sf_dir):
    return sketches.cms_cells(_table(spark, sf_dir, "events"), "user_id", *CMS)


@query(f"""with c as {_cells('(select user_id::VARCHAR as x from events)')},
h as (select o_custkey, i::INTEGER as row, {_seeded('encode(o_custkey::VARCHAR)', 'i', CMS[0])} as col from (select distinct o_custkey from orders), (select unnest(range(0, {CMS[1]})) as i))
select o_custkey, min(coalesce(cnt, 0)) as estimate from h left join c on h.row = c.row and h.col = c.col group by o_custkey""")
def cms_query(spark, sf_dir):
    cells = sketches.cms_cells(_table(spark, sf_dir, "events"), "user_id", *CMS)
    return sketches.cms_query(cells, _table(spark, sf_dir, "orders"), "o_custkey", *CMS)


HLL = f"""h as (select ('0x' || substr(sha256(user_id::VARCHAR), 1, 16))::UBIGINT as h from events),
g as (select (h >> {64 - PRECISION})::INTEGER as bucket, max(case when h = 0 then 65 else bit_count(xor(h, h - 1)) end)::INTEGER as rank from h group by 1)"""


@query(f"with {HLL} select * from g")
def hll_registers(spark, sf_dir):
    return sketches.hll_registers(_table(spark, sf_dir, "events"), "user_id", PRECISION)


@query(f"""with {HLL}, s as (select count(*) as used, sum(pow(2.0, -rank)) as part from g),
e as (select used, {0.7213 / (1 + 1.079 / 1024) * 1024 * 1024!r}::DOUBLE / (part + (1024 - used)) as e from s)
select round(case when e <= 2560 and used < 1024 then 1024 * ln(1024.0 / (1024 - used)) when e > 143165576.5 then -4294967296.0 * ln(1 - e / 4294967296.0) else e end, 6) as estimate from e""")
def hll_estimate(spark, sf_dir):
    registers = sketches.hll_registers(_table(spark, sf_dir, "events"), "user_id", PRECISION)
    return sketches.hll_estimate(registers, PRECISION).select(F.round("estimate", 6).alias("estimate"))


TOKENS = r"""list_filter(regexp_split_to_array(regexp_replace(replace(lower(text), '''', ''), '[^A-Za-z0-9_\t\n\f\r ]', '', 'g'), '[\t\n\f\r ]+'), lambda w: w <> '')"""


@query(f"with t as (select unnest({TOKENS}) as token from documents) select token, count(*) as n from t group by token")
def token_frequency(spark, sf_dir):
    return sketches.token_frequency(_table(spark, sf_dir, "documents"))


@query(f"with t as (select doc_id, unnest({TOKENS}) as token from documents) select doc_id, token, count(*) as n from t group by all")
def word_frequency(spark, sf_dir):
    return sketches.word_frequency(_table(spark, sf_dir, "documents"), "doc_id")


# FNV-1a in halves of 64 bits, a byte at a time; a bit of a fingerprint is the sign of its words' votes
_HALF = 1 << 64
SIMHASH = f"""w as (select doc_id, unnest({TOKENS}) as word from documents),
n as (select doc_id, word, count(*) as n from w group by all),
b as (select word, list_transform(range(0, octet_length(encode(word))), lambda i: {{'h': 0::HUGEINT, 'l': ('0x' || substr(hex(encode(word)), 2 * i::BIGINT + 1, 2))::HUGEINT}}) as b from (select distinct word from n)),
f as (select word, list_reduce(list_concat([{{'h': {0x6C62272E07BB0142}::HUGEINT, 'l': {0x62B821756295C58D}::HUGEINT}}], b), lambda s, x:
  {{'h': (s.h * 315 + (xor(s.l, x.l) * 315) // {_HALF} + (xor(s.l, x.l) % {1 << 40}) * {1 << 24}) % {_HALF}, 'l': (xor(s.l, x.l) * 315) % {_HALF}}}) as f from b),
v as (select doc_id, i, sum(case when (case when i < 64 then f.f.h else f.f.l end // (1::HUGEINT << (63 - i % 64))) % 2 = 1 then n else -n end) as v
  from n join f using (word), (select unnest(range(0, 128))::INTEGER as i) group by doc_id, i),
p as (select doc_id, lower(hex(unbin(string_agg(case when v >= 0 then '1' else '0' end, '' order by i)))) as fingerprint from v group by doc_id),
fp as (select doc_id, case when text is not null then coalesce(fingerprint, repeat('f', 32)) end as fingerprint from documents left join p using (doc_id))"""


@query(f"with {SIMHASH} select doc_id, fingerprint from fp")
def simhash_fingerprint(spark, sf_dir):
    return sketches.fingerprints(_table(spark, sf_dir, "documents"))


SIMILARITY = """case when distance = 0 then 'Identical' when distance <= 3 then 'Very Similar' when distance <= 6 then 'Similar' when distance <= 12 then 'Somewhat Similar' when distance <= 20 then 'Slightly Similar' when distance <= 30 then 'Different' else 'Very Different' end as band,
case when distance = 0 then 100 when distance <= 3 then 98 when distance <= 6 then 90 when distance <= 12 then 75 when distance <= 20 then 50 when distance <= 30 then 25 else 5 end as similarity"""


@query(f"""with {SIMHASH}, d as (select distinct fingerprint as f, ('0x' || substr(fingerprint, 1, 16))::UBIGINT as h, ('0x' || substr(fingerprint, 17))::UBIGINT as l from fp where fingerprint is not null),
x as (select a.f as a, b.f as b, (bit_count(xor(a.h, b.h)) + bit_count(xor(a.l, b.l)))::INTEGER as distance from d a join d b on a.f < b.f)
select a, b, distance, {SIMILARITY} from x where distance <= 7""")
def simhash_pairs(spark, sf_dir):
    return sketches.bands_of(sketches.fingerprint_pairs(sketches.fingerprints(_table(spark, sf_dir, "documents"))))


@query("""with h as (select item_id, md5(text) as a, md5(text || '!') as b from benchmark),
d as (select item_id, bit_count(xor(('0x' || substr(a, 1, 16))::UBIGINT, ('0x' || substr(b, 1, 16))::UBIGINT)) + bit_count(xor(('0x' || substr(a, 17, 16))::UBIGINT, ('0x' || substr(b, 17, 16))::UBIGINT)) - 45 as x from h),
c as (select item_id, greatest(0, x)::INTEGER as distance from d)
select item_id, distance, """ + SIMILARITY + " from c")
def similarity_band(spark, sf_dir):
    """Bands over distances spread by hashing; 45 bits less, so that all bands occur."""
    b = _table(spark, sf_dir, "benchmark")
    distance = F.greatest(F.lit(0), hashing.hamming(F.md5("text"), F.md5(F.concat("text", F.lit("!")))) - 45).cast("int")
    return sketches.bands_of(b.select("item_id", distance.alias("distance")))


# --- integrity -------------------------------------------------------------------


def _le(n: str) -> str:
    h = f"lpad(hex({n}), 16, '0')"
    return " || ".join(f"substr({h}, {i}, 2)" for i in range(15, 0, -2))


def _record(key: str = "key", value: str = "value") -> str:
    size = lambda c: f"(coalesce(octet_length(encode({c})), 0))::BIGINT"
    return f"unhex({_le('timestamp')} || case when tombstone then '01' else '00' end || {_le(size(key))} || {_le(size(value))}) || encode({key}) || coalesce(encode({value}), ''::BLOB)"


LEAVES = f"lv as (select run_id, row_number() over (partition by run_id order by key) - 1 as pos, md5({_record()}) as hash from r)"


@query(f"with {E}, {RUNS}, {LEAVES} select run_id, pos, hash from lv")
def merkle_leaves(spark, sf_dir):
    return integrity.leaves(_runs(spark, sf_dir)).select("run_id", "pos", "hash")


TREE = f"""t(height, run_id, pos, hash, n) as (
  select 0, run_id, pos, hash, count(*) over (partition by run_id) from lv
  union all
  select height + 1, run_id, pos // 2, md5(unhex(max(hash) filter (where pos % 2 = 0)) || unhex(coalesce(max(hash) filter (where pos % 2 = 1), repeat('0', 32)))), (n + 1) // 2
  from t where n > 1 group by height, run_id, pos // 2, n)"""


@query(f"with recursive {E}, {RUNS}, {LEAVES}, {TREE} select run_id, hash as root from t where n = 1")
def merkle_root(spark, sf_dir):
    return integrity.roots(integrity.leaves(_runs(spark, sf_dir)))


def _damaged(spark, sf_dir):
    return _runs(spark, sf_dir).withColumn("value", F.when(F.col("seq") % 97 == 0, F.lit("damaged")).otherwise(F.col("value")))


DAMAGED = f"dv as (select run_id, row_number() over (partition by run_id order by key) - 1 as pos, md5({_record()}) as hash from (select * replace (case when seq % 97 = 0 then 'damaged' else value end as value) from r))"


@query(f"with {E}, {RUNS}, {LEAVES}, {DAMAGED} select lv.run_id, lv.pos, lv.hash as stored, dv.hash as found from lv join dv on lv.run_id = dv.run_id and lv.pos = dv.pos where lv.hash <> dv.hash")
def merkle_diff(spark, sf_dir):
    return integrity.differing(integrity.leaves(_runs(spark, sf_dir)), integrity.leaves(_damaged(spark, sf_dir)))


@query(f"with {E}, {RUNS}, {LEAVES}, {DAMAGED} select lv.run_id, count(*) filter (where lv.hash <> dv.hash) = 0 as passed, count(*) filter (where lv.hash <> dv.hash) as corrupt_records from lv join dv on lv.run_id = dv.run_id and lv.pos = dv.pos group by lv.run_id")
def check_integrity(spark, sf_dir):
    return integrity.check(integrity.leaves(_runs(spark, sf_dir)), integrity.leaves(_damaged(spark, sf_dir)))


CRC = f"""tab as (select list(c order by i) as t from (select i, list_reduce(list_concat([i], repeat([0], 8)), lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c from (select unnest(range(0, 256)) as i))),
x as (select key, seq, hex({_record()}) as x from e),
y as (select key, seq, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i::BIGINT + 1, 2))::BIGINT) as y from x)"""


@query(f"with {E}, {CRC} select key, seq, xor(list_reduce(list_concat([4294967295], y), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) as crc from y, tab")
def record_checksums(spark, sf_dir):
    return integrity.checksums(_events(spark, sf_dir))


# --- rate limiting ---------------------------------------------------------------


@query(f"""with recursive q as (select user_id, event_id, epoch_us(ts) // 1000000 as t, row_number() over (partition by user_id order by epoch_us(ts) // 1000000, event_id) as rn from events),
s(user_id, rn, last, tokens, event_id, allowed) as (
  select user_id, rn, t, {BUCKET.tokens - 1}::BIGINT, event_id, true from q where rn = 1
  union all
  select q.user_id, q.rn, s.last + ((q.t - s.last) // {BUCKET.refill_seconds}) * {BUCKET.refill_seconds},
    greatest(0, least({BUCKET.tokens}, s.tokens + ((q.t - s.last) // {BUCKET.refill_seconds}) * {BUCKET.refill_amount}) - 1), q.event_id,
    least({BUCKET.tokens}, s.tokens + ((q.t - s.last) // {BUCKET.refill_seconds}) * {BUCKET.refill_amount}) > 0
  from s join q on q.user_id = s.user_id and q.rn = s.rn + 1)
select user_id, event_id, allowed from s""")
def token_bucket_decisions(spark, sf_dir):
    """A bucket per user; large buckets are folded from sorted rows."""
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", model.epoch_seconds(F.col("ts")).alias("t"))
    return buckets.decide_large(e, "user_id", "t", "event_id", BUCKET)


# --- what is kept on disk --------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share; on this machine where none is set and
    everything runs here."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{top.rstrip('/')}/tidelog-catalogue/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


_ENGINES: dict[tuple[str, str], Engine] = {}


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The events written to a store in four parts, flushed and compacted as it fills."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _ENGINES:
        log = _events(spark, sf_dir)
        n = log.count()
        e = Engine(spark, _folder(spark), Settings(memtable=Memtable(capacity=max(1, n // 8)), tree=Tree(max_tables_per_level=1, max_memtables=1)))
        for k in range(4):
            since, until = n * k // 4, n * (k + 1) // 4
            e.put_all(log.filter((F.col("seq") >= since) & (F.col("seq") < until)).select("key", "value", "tombstone", (F.col("seq") - since).alias("seq")))
        _ENGINES[at] = e
    return _ENGINES[at]


def _as_text(d: DataFrame, *names: str) -> DataFrame:
    return d.select("key", F.decode("value", "UTF-8").alias("value"), *names)


@query(f"with {E} select key, value, seq from {_newest('e')} where not tombstone")
def engine_snapshot(spark, sf_dir):
    return _as_text(_engine(spark, sf_dir).snapshot(), "seq")


@query(f"with {E} select key, value, tombstone as deleted from {_newest('e')} where not tombstone and key = 'user_000042'")
def engine_get(spark, sf_dir):
    return _as_text(scans.get(_engine(spark, sf_dir).log(), "user_000042"), "deleted")


@query(f"with {E} select key from {_newest('e')} where not tombstone and starts_with(key, 'user_000') order by key limit 10 offset 20")
def engine_prefix_scan(spark, sf_dir):
    return scans.prefix_scan(_engine(spark, sf_dir).log(), "user_000", 10, 2)


@query(f"with {E} select key from {_newest('e')} where not tombstone and key between 'user_000010' and 'user_000090' order by key limit 20")
def engine_range_scan(spark, sf_dir):
    return scans.range_scan(_engine(spark, sf_dir).log(), "user_000010", "user_000090", 20)


@query(f"with {E} select key, value, seq from {_newest('e')} where not tombstone and starts_with(key, 'user_') and key > 'user_000077' order by key limit 1")
def engine_prefix_iterate(spark, sf_dir):
    return _as_text(scans.prefix_iterate(_engine(spark, sf_dir).log(), "user_", "user_000077"), "seq")


@query("select false as data_lost, true as has_data, 0 as waiting, true as all_runs_pass")
def engine_status(spark, sf_dir):
    """Nothing is lost, and every run has the leaf hashes that it was sealed with."""
    e = _engine(spark, sf_dir)
    e.flush()
    runs = [r["run_id"] for r in e.runs.manifest().select("run_id").collect()]
    for r in runs:
        e.seal(r)
    row = (e.is_data_lost(), e.has_data(), len(e._waiting()), all(e.check(r)["passed"] for r in runs))
    return spark.createDataFrame([row], "data_lost boolean, has_data boolean, waiting int, all_runs_pass boolean")


@query(f"with {E} select key, value, tombstone, timestamp, seq from e where seq > {AS_OF // 10}")
def wal_replay(spark, sf_dir):
    at = _folder(spark)
    source.append(_events(spark, sf_dir), at)
    return _as_text(source.replay(spark, at, AS_OF // 10), "tombstone", "timestamp", "seq")


@query(f"with {E} select key, value, timestamp, seq from {_newest('e')} where not tombstone")
def stream_to_runs(spark, sf_dir):
    """Events that come as a stream of files in an order other than that of ``seq``."""
    at, log = _folder(spark), _events(spark, sf_dir)
    for k in (2, 0, 1):
        source.append(log.filter(F.pmod("seq", F.lit(3)) == k).coalesce(1), f"{at}/log")
    runs = lsm.RunStore(spark, f"{at}/runs", Settings(tree=Tree(max_tables_per_level=1)))
    ingest.to_runs(source.stream(spark, f"{at}/log", 1), runs, f"{at}/checkpoint").awaitTermination()
    return _as_text(snapshot.live(runs.log()), "timestamp", "seq")


def _halves(d: DataFrame, column: str) -> list[DataFrame]:
    return [d.filter(F.pmod(F.xxhash64(column), F.lit(2)) == k) for k in (0, 1)]


@query(ORACLE["cms_query"])
def cms_named(spark, sf_dir):
    r = sketches.Registry(spark, _folder(spark))
    r.create("cms", "users", epsilon=0.01, delta=0.01)
    for part in _halves(_table(spark, sf_dir, "events"), "event_id"):
        r.add_items("cms", "users", part, "user_id")
    return r.count("users", _table(spark, sf_dir, "orders"), "o_custkey")


@query(ORACLE["bloom_test"])
def bloom_named(spark, sf_dir):
    r = sketches.Registry(spark, _folder(spark))
    r.create("bloom", "users", items=1000, rate=0.01)
    for part in _halves(_events(spark, sf_dir), "seq"):
        r.add_items("bloom", "users", part, "key")
    probes = _table(spark, sf_dir, "orders").select(F.concat(F.lit("user_"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("key"))
    return r.test("users", probes, "key")


@query(ORACLE["hll_estimate"])
def hll_named(spark, sf_dir):
    r = sketches.Registry(spark, _folder(spark))
    r.create("hll", "users", precision=PRECISION)
    for part in _halves(_table(spark, sf_dir, "events"), "event_id"):
        r.add_items("hll", "users", part, "user_id")
    return spark.createDataFrame([(r.estimate("users"),)], "estimate double").select(F.round("estimate", 6).alias("estimate"))


@query(ORACLE["kv_key_dictionary"])
def key_dictionary_kept(spark, sf_dir):
    """Numbers given in two parts; the second keeps what the first gave."""
    d, log = scans.KeyDictionary(spark, _folder(spark)), _events(spark, sf_dir)
    for part in (log.filter(F.col("seq") < 500), log):
        d.add(part)
    return d.entries()


@query(f"with recursive {E}, {RUNS}, {LEAVES}, {TREE} select height, run_id, pos, hash from t")
def merkle_tree(spark, sf_dir):
    nodes = integrity.tree(integrity.leaves(_runs(spark, sf_dir)))
    return integrity.depth_first(integrity.deserialised(integrity.serialised(nodes))).select("height", "run_id", "pos", "hash")


@query("select doc_id, ceil(octet_length(encode(text)) / 4092.0)::BIGINT as blocks, true as intact, md5(text) as hash from documents where text is not null")
def blocks_sealed(spark, sf_dir):
    """Texts as blocks with checksums, checked and read back."""
    d = _table(spark, sf_dir, "documents").filter("text is not null").withColumn("raw", F.col("text").cast("binary"))
    d = d.withColumn("b", codec.sealed(F.col("raw")))
    back = F.md5(codec.unsealed(F.col("b"), F.octet_length("raw")))
    return d.select("doc_id", F.size("b").cast("long").alias("blocks"), F.forall("b", codec.intact).alias("intact"), back.alias("hash"))
