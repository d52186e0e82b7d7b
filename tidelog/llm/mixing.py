"""Mixing sources to target weights by Sainte-Lague apportionment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import columns, numbered, place, store

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources the block table is broadcast; else it is joined by source.
SOURCES = 10_000


def words(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009..U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets from (source, source_size): ``share`` of all sizes dealt by weight,
    at most ``cap`` times a source's size, the excess dealt again.

    Sources in code point order, null last, get ``weights`` in turn. Dealing the
    excess again until no target is above its cap ends in
    ``least(cap * size, level * weight)``; the level follows from sorting by
    ``cap * size / weight``. One row per source, so one task sorts them.
    """
    ring = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", F.element_at(ring, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("of", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("lev", F.col("left") / F.col("of"))
    s = s.withColumn("level", F.max(F.when(F.col("lev") * F.col("weight") <= F.col("most"), F.col("lev"))).over(everything))
    free = F.col("level").isNotNull() & (F.col("level") * F.col("weight") < F.col("most"))
    s = s.withColumn("saturated", ~free)
    return s.select("source", "source_size", "total", "saturated", F.when(free, F.col("level") * F.col("weight")).otherwise(F.col("most")).alias("target"))


def seats(claims: DataFrame, group: str, name: str) -> DataFrame:
    """(group, name, won) by Sainte-Lague: in each ``group`` (of equal ``seats``)
    the seats go to the highest quotients ``share / (2k + 1)``, at most ``most``
    a claim.

    Shares sum to the seats but for rounding and none is above its ``most``. So
    a claim wins its share give or take half of the largest share's ratio to
    the mean, and rounding: only quotients in there are compared.
    """
    whole = Window.partitionBy(group)
    ratio = F.max("share").over(whole) / F.greatest(F.avg("share").over(whole), F.lit(1e-300))
    c = claims.withColumn("near", F.ceil(ratio).cast("long") + 3).withColumn("whole", F.floor("share"))
    c = c.withColumn("sure", F.greatest(F.lit(0).cast("long"), F.col("whole") - F.col("near")))
    c = c.withColumn("due", F.col("seats") - F.sum("sure").over(whole))
    upto = F.least(F.col("most").cast("long"), F.col("whole") + F.col("near") + 1) - 1
    k = c.filter(F.col("most") > F.col("sure")).withColumn("k", F.explode(F.sequence(F.col("sure"), upto)))
    best = whole.orderBy((F.col("share") / (2 * F.col("k") + 1)).desc(), F.col(name).asc_nulls_last(), "k")
    more = k.withColumn("r", F.row_number().over(best)).filter("r <= due").groupBy(group, name).agg(F.count(F.lit(1)).alias("more"))
    on = F.expr(f"c.{group} <=> m.{group} and c.{name} <=> m.{name}")
    return c.alias("c").join(more.alias("m"), on, "left").selectExpr(f"c.{group}", f"c.{name}", "c.sure + coalesce(m.more, 0) as won")


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2, blocks: int = 16384, shards: int = 16, buckets: int = 1024, seed: int = 17) -> DataFrame:
    """Take words of every document so that each source comes near its target.

    ``docs`` needs doc_id, text and source; other columns are ignored. Each
    source's words are laid end to end: ``buckets`` parts by a seeded hash, each
    part in seeded order, so that a source of any size is dealt over many tasks.
    Words are the seats: a source whose target is its cap gets every word
    ``cap`` times, the others get words by highest quotients
    ``target / (2k + 1)``. What a source's quota leaves over whole copies of its
    line is dealt to its ``shards`` in the same way. The line is cut into blocks
    of ``total target / blocks`` words; each shard takes its quota from blocks
    in seeded order, and of the last of them only the words still due, so the
    blocks' size has no part in a source's quota and no word is taken over
    ``cap`` times. The block table has at most ``blocks`` rows and one for each
    source, and is broadcast up to ``SOURCES`` sources; no document is gathered
    anywhere.

    Returns doc_id, source, size, source_size, target, taken, one row per row.
    Null or empty text: size 0, taken 0. Null source: a source of its own, last
    in order. Null or repeated ids and repeated rows: each row is laid out and
    taken for itself. Empty table: no rows. Other columns are ignored, whatever
    their names. Reruns give the same rows.
    """
    d = columns(docs, "doc_id", "source", "text").select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"))
    return _mixed(d, weights, share, cap, blocks, shards, buckets, seed).drop("hash")


def _mixed(d: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2, blocks: int = 16384, shards: int = 16, buckets: int = 1024, seed: int = 17) -> DataFrame:
    """``mix`` for rows of (doc_id, source, size, hash of the text)."""
    d = store(d.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(buckets))), "sized")
    parts = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = store(source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, float(cap)), "targets")
    totals = targets.agg(F.count(F.lit(1)).alias("sources"), F.max("total").alias("total"), F.sum(F.when(~F.col("saturated"), F.col("target"))).alias("open")).first()
    b = max(1, -int(-(totals["total"] or 0) // blocks))

    open_ = targets.filter("not saturated").select("source", F.lit(0).alias("all"), F.col("target").alias("share"), (F.col("source_size") * cap).alias("most"))
    won = seats(open_.withColumn("seats", F.lit(int(round(totals["open"] or 0)))), "all", "source")
    s = targets.alias("s").join(won.alias("q"), F.expr("s.source <=> q.source"), "left").selectExpr("s.*", f"case when s.saturated then s.source_size * {cap} else q.won end as quota")
    s = s.withColumn("n", F.ceil(F.col("source_size") / F.lit(b)).cast("long")).withColumn("base", F.expr("quota div greatest(source_size, 1)"))
    s = store(s.withColumn("rest", F.col("quota") - F.col("base") * F.col("source_size")), "quotas")

    block = s.filter("rest > 0").select("source", "source_size", "n", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    block = block.withColumn("shard", F.floor(F.col("block") * shards / F.col("n")).cast("int")).withColumn("length", F.least(F.lit(b), F.col("source_size") - F.col("block") * b))
    own = block.groupBy("source", "shard", "source_size", "rest").agg(F.sum("length").alias("most"))
    share = F.col("rest").cast("double") * F.col("most") / F.col("source_size")
    dealt = seats(own.select("source", "shard", share.alias("share"), "most", F.col("rest").alias("seats")), "source", "shard")

    drawn = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    block = block.withColumn("drawn", F.coalesce(F.sum("length").over(drawn), F.lit(0)))
    block = block.alias("b").join(dealt.alias("q"), F.expr("b.source <=> q.source and b.shard = q.shard")).selectExpr("b.source", "b.block", "greatest(0, least(b.length, q.won - b.drawn)) as extra")
    run = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block = block.withColumn("before", F.coalesce(F.sum("extra").over(run), F.lit(0)))
    plan = block.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("block", "extra", "before"))).alias("plan"))
    plan = s.alias("s").join(plan.alias("p"), F.expr("p.source <=> s.source"), "left").selectExpr("s.source as plan_source", "source_size", "target", "base", "plan")

    first = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = store(parts.withColumn("offset", F.coalesce(F.sum("words").over(first), F.lit(0))).select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), "offset"), "offsets")
    inside = Window.partitionBy("source", "bucket").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id"), "doc_id", "size", "hash").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("run", F.sum("size").over(inside))
    d = d.join(parts, F.expr("source <=> o_source and bucket = o_bucket"))
    few = totals["sources"] <= SOURCES
    d = d.join(F.broadcast(plan) if few else plan, F.expr("source <=> plan_source"))
    d = d.withColumn("until", F.col("offset") + F.col("run")).withColumn("since", F.col("until") - F.col("size"))
    at = f"plan[cast(least({{0}} div {b}, size(plan) - 1) as int)]"
    upto = f"({at}.before + least({at}.extra, {{0}} - {at}.block * {b}))"
    extra = F.expr(f"case when plan is null then 0 else {upto.format('until')} - {upto.format('since')} end")
    return d.select("doc_id", "source", "size", "hash", "source_size", "target", (F.col("base") * F.col("size") + extra).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row of ``docs`` as often as its words are taken.

    A part of a copy becomes a whole one with that part as its probability, by
    seeded hash, so sources keep their shares; rows of which none are taken go,
    so null and empty texts do. Rows that agree in id, source and text share
    out what is taken of them, row by row with the same probability. Null ids
    and null sources are joined as such. All columns come back as given,
    whatever their names; an empty table gives no rows.
    """
    d, own = numbered(docs), [f"c{i}" for i in range(len(docs.columns))]
    text = F.col(place(docs, "text"))
    d = d.withColumns({"d_id": F.col(place(docs, "doc_id")), "d_source": F.col(place(docs, "source")), "d_size": words(text), "d_hash": F.xxhash64(text)})
    keys = d.select(F.col("d_id").alias("doc_id"), F.col("d_source").alias("source"), F.col("d_size").alias("size"), F.col("d_hash").alias("hash"))
    dither = F.pmod(F.xxhash64(F.lit("copies"), "doc_id", "size"), F.lit(1 << 20)) / (1 << 20)
    taken = _mixed(keys, **options).withColumn("copies", F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + dither).cast("long"))
    taken = taken.groupBy("doc_id", "source", "size", "hash").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0")
    d = d.withColumn("row", F.monotonically_increasing_id()).join(taken, F.expr("d_id <=> doc_id and d_source <=> source and d_size = size and d_hash = hash"))
    more = F.when(F.pmod(F.xxhash64(F.lit("more"), "row"), F.col("rows")) < F.col("copies") % F.col("rows"), 1).otherwise(0)
    d = d.withColumn("times", (F.expr("copies div rows") + more).cast("int")).filter("times > 0")
    return d.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*own).toDF(*docs.columns)
