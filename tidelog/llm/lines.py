"""Line dedup by a suffix array over line sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import discard, numbered, place, store

#: A line starts at a line feed that more than white space follows on the same
#: line, so blank lines belong to the line before them.
_CUT = r"\n(?=[^\S\n]*\S)"
_BLANK = " \t\r\n\f\x0b"
HERE = ("k1", "k2", "pos")
#: Bits that a rank takes: 33 for the row of a task, the others for the task.
_RANK = 57


def _sequences(docs: DataFrame) -> DataFrame:
    """(k1, k2, h1, h2, lines) of each text: its lines that aren't blank, as
    (pos, l1, l2, words), by two hashes each."""
    d = docs.select("k1", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.split("text", _CUT).alias("l"))
    d = d.withColumn("l", F.transform("l", lambda p: F.btrim(p, F.lit(_BLANK))))
    each = "transform(l, (t, i) -> named_struct('pos', i, 'l1', xxhash64(t), 'l2', xxhash64(1, t), 'words', if(t = '', 0, size(split(t, '\\\\s+')))))"
    return d.select("k1", F.col("h1").alias("k2"), "h1", "h2", F.expr(f"filter({each}, x -> x.words > 0)").alias("lines"))


def _ranked(names: DataFrame, *keys: str) -> DataFrame:
    """Numbers for distinct names, in their order: a rank of the suffix array is
    the same for all suffixes that begin alike."""
    return store(names.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _groups(suffixes: DataFrame, *keys: str) -> DataFrame:
    """(k1, k2, pos, rank, first) of the suffixes whose ``keys`` another one has too:
    an interval of the suffix array has one rank, ``first`` is its first place."""
    names = suffixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*HERE)).alias("first")).filter("n > 1").drop("n")
    names = _ranked(names, *keys)
    out = store(suffixes.join(names, list(keys)).select(*HERE, "rank", "first"), "intervals")
    discard(names)
    return out


def _intervals(lines: DataFrame) -> list[DataFrame]:
    """The intervals of common prefixes of 1, 2, 4, ... lines, until no two suffixes
    share a rank. A suffix that is unique drops out."""
    found = [_groups(lines, "l1", "l2")]
    while True:
        step = 1 << (len(found) - 1)
        beyond = Window.partitionBy("k1", "k2").orderBy("pos").rangeBetween(step, step)
        pairs = found[-1].select(*HERE, F.col("rank").alias("rank1"), F.first("rank").over(beyond).alias("rank2"))
        pairs = store(pairs.filter("rank2 is not null"), "pairs")
        now = _groups(pairs, "rank1", "rank2")
        discard(pairs)
        if now.isEmpty():
            return found
        found.append(now)


def _longest(found: list[DataFrame]) -> DataFrame:
    """(k1, k2, pos, length): for each suffix that begins like an earlier one, the
    longest prefix that occurs earlier.

    The deepest interval whose first place is earlier gives the length up to a
    factor of 2; then one bit of the length is settled at a time. A prefix of
    2^k < m < 2^(k+1) lines is named by the ranks of two overlapping prefixes of
    2^k lines, so each question splits an interval by a second rank; it is put
    once for all suffixes of the interval that ask for the same m.
    """
    whole = store(reduce(DataFrame.unionByName, [f.withColumn("level", F.lit(k)) for k, f in enumerate(found)]), "members")
    discard(*found)
    later = whole.filter(F.col("first") < F.struct(*HERE)).withColumn("both", F.expr(f"shiftleft(cast(level as bigint), {_RANK}) + rank"))
    deepest = later.groupBy(*HERE).agg(F.max("both").alias("both")).withColumn("level", F.expr(f"cast(shiftright(both, {_RANK}) as int)"))
    state = store(deepest.select(*HERE, "level", F.expr(f"both - shiftleft(cast(level as bigint), {_RANK})").alias("rank"), F.expr("shiftleft(1, level)").alias("length")), "state")
    members = whole.select("level", "rank", *HERE)
    second = members.select("level", "k1", "k2", F.col("pos").alias("at"), F.col("rank").alias("rank2"))
    for j in range(len(found) - 2, -1, -1):
        asking = state.filter(F.col("level") > j).withColumn("m", F.col("length") + (1 << j))
        asked = asking.select("level", "rank", "m").distinct()
        split = members.filter(F.col("level") > j).join(asked, ["level", "rank"]).withColumn("at", F.expr("pos + m - shiftleft(1, level)"))
        split = store(split.join(second.filter(F.col("level") > j), ["level", "k1", "k2", "at"]).select("level", "rank", "m", "rank2", *HERE), "split")
        first = split.groupBy("level", "rank", "m", "rank2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*HERE)).alias("first")).filter("n > 1").drop("n")
        hit = split.join(first, ["level", "rank", "m", "rank2"]).filter(F.col("first") < F.struct(*HERE)).select(*HERE, "m")
        grown = asking.join(hit.withColumn("hit", F.lit(1)), [*HERE, "m"], "left").withColumn("length", F.when(F.col("hit").isNotNull(), F.col("m")).otherwise(F.col("length")))
        grown = store(state.filter(F.col("level") <= j).unionByName(grown.select(*state.columns)), "state")
        discard(state, split)
        state = grown
    discard(whole)
    return state.select(*HERE, "length")


def repeated_runs(lines: DataFrame, min_words: int = 1) -> DataFrame:
    """(k1, k2, pos, length): the maximal runs of lines, of at least ``min_words``
    words, that occur at an earlier place too.

    ``lines``: (k1, k2, pos, l1, l2, words), one row per line; documents follow
    each other by (k1, k2), their lines by pos, without gaps. A run of a place
    is the longest prefix of its suffix that occurs earlier; it is maximal if
    the run of the place before it ends before it does. Every run of enough
    words that occurs earlier lies within one of these.
    """
    found = _intervals(lines)
    runs = _longest(found).withColumn("until", F.col("pos") + F.col("length"))
    before = F.max("until").over(Window.partitionBy("k1", "k2").orderBy("pos").rangeBetween(-1, -1))
    runs = store(runs.withColumn("before", before).filter("before is null or before < until").select(*HERE, "length"), "runs")
    if min_words > 1:  # else every run has enough
        upto = F.sum("words").over(Window.partitionBy("k1", "k2").orderBy("pos"))
        sums = lines.select(*HERE, (upto - F.col("words")).alias("since"), upto.alias("until"))
        ends = sums.select("k1", "k2", (F.col("pos") + 1).alias("end"), "until")
        sized = runs.join(sums.drop("until"), list(HERE)).withColumn("end", F.col("pos") + F.col("length")).join(ends, ["k1", "k2", "end"])
        runs = sized.filter(F.col("until") - F.col("since") >= min_words).select(*HERE, "length")
    return runs


def dedup_lines(docs: DataFrame, min_words: int = 10, counts: bool = True) -> DataFrame:
    """``docs`` with the later copies of repeated line runs taken out of ``text``,
    and, with ``counts``, the columns n_lines, n_removed.

    Lines are compared without white space at their ends; blank lines go with
    the line before them. A run counts if it has ``min_words`` words or more:
    shorter lines go only as part of one. At 1 word runs of any length count:
    no later copy of a line stays. The copy in the first document by doc_id
    (null last), at its first place, stays; every distinct line is kept at
    least there. A document all of whose lines are later copies keeps an empty
    text, or the blank lines it starts with.

    Of equal texts the first alone takes part in the suffix array: the others
    are copies from end to end. Ranks of suffixes, by prefix doubling, and the
    intervals of their common prefixes then give every maximal repeated run.

    Null text: null, 0 lines. Empty text: unchanged. Rows that agree in doc_id
    and text are copies in some order: one is the first. Rows that share only
    the id are documents of their own. All columns of ``docs`` are returned in
    their order, whatever their names (but n_lines and n_removed, which the
    counts replace); an empty table gives no rows. Each document's lines stay in its
    row; a line found everywhere is aggregated before it is joined.
    """
    names, new_names = docs.columns, ("n_lines", "n_removed") if counts else ()
    text, own = place(docs, "text"), [f"c{i}" for i, n in enumerate(names) if n not in new_names]
    key = F.coalesce(F.col(place(docs, "doc_id")).cast("long"), F.lit((1 << 63) - 1)).alias("k1")
    d = numbered(docs).select(*own, key, F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    sequences = store(_sequences(d.filter(f"{text} is not null").select("k1", F.col(text).alias("text"))), "sequences")
    firsts = sequences.groupBy("h1", "h2").agg(F.min("k1").alias("k1"), F.any_value("lines").alias("lines"))
    lines = store(firsts.select("k1", F.col("h1").alias("k2"), F.explode("lines").alias("x")).select("k1", "k2", "x.*"), "lines")
    runs = repeated_runs(lines, min_words)
    gone = runs.select("k1", F.col("k2").alias("h1"), F.explode(F.expr("sequence(pos, pos + length - 1)")).alias("pos"))
    gone = gone.groupBy("k1", "h1").agg(F.collect_set("pos").alias("gone"))
    texts = sequences.groupBy("h1", "h2").agg(F.min("k1").alias("first"))
    info = sequences.select("k1", "h1", "h2").distinct().join(texts, ["h1", "h2"]).join(gone, ["k1", "h1"], "left")
    info = info.select(F.col("k1").alias("t0"), F.col("h1").alias("t1"), F.col("h2").alias("t2"), (F.col("k1") > F.col("first")).alias("copy"), "gone")
    info = store(info.filter("copy or gone is not null"), "gone")
    discard(lines, runs)

    rest = d.filter(f"{text} is null").select(*own, F.lit(0).alias("n_lines"), F.lit(0).alias("n_removed"))
    d = d.filter(f"{text} is not null").join(info, F.expr("k1 = t0 and h1 = t1 and h2 = t2"), "left")
    nth = F.row_number().over(Window.partitionBy("k1", "h1", "h2").orderBy(F.lit(1)))
    d = d.withColumn("nth", nth).withColumn("l", F.split(text, _CUT))
    enough = F.size(F.split(F.btrim(text, F.lit(_BLANK)), r"\s+", min_words + 1)) >= min_words
    blank = F.filter("l", lambda p: F.btrim(p, F.lit(_BLANK)) == "")
    kept = F.expr("transform(array_except(sequence(0, size(l) - 1), gone), i -> l[i])")
    left = F.when(((F.col("nth") > 1) | F.col("copy")) & enough, blank).when(F.col("gone").isNotNull(), kept).otherwise(F.col("l"))
    d = d.withColumn("left", left)
    new = F.when(F.size("left") < F.size("l"), F.concat_ws("\n", "left")).otherwise(F.col(text))
    n = F.when(F.btrim(text, F.lit(_BLANK)) == "", 0).otherwise(F.size("l"))
    out = d.select(*[new.alias(c) if c == text else F.col(c) for c in own], n.alias("n_lines"), (F.size("l") - F.size("left")).alias("n_removed")).unionByName(rest)
    return out.select(*own, *new_names).toDF(*[names[int(c[1:])] for c in own], *new_names)
