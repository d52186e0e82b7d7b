"""Token buckets: a batch fold per bucket, and a stateful stream operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.config import Bucket


def step(last: int, tokens: int, now: int, b: Bucket) -> tuple[int, int, bool]:
    """State after a request at second ``now``: whole intervals since ``last`` add
    tokens up to the capacity, and a token, if there is one, is taken."""
    whole = max(0, now - last) // b.refill_seconds
    tokens = min(b.tokens, tokens + whole * b.refill_amount)
    last += whole * b.refill_seconds
    return (last, tokens - 1, True) if tokens > 0 else (last, tokens, False)


def decide(requests: DataFrame, bucket: str, at: str, order: str, b: Bucket) -> DataFrame:
    """(bucket, order, allowed) for each request; a bucket starts full at its first.

    The decision of a request depends on all before it in its bucket, so one
    bucket is folded in order in one task, as (second, order) pairs. ``at`` are
    whole seconds.
    """
    r = requests.groupBy(bucket).agg(F.sort_array(F.collect_list(F.struct(F.col(at).cast("long").alias("t"), F.col(order).alias("o")))).alias("r"))
    whole = f"greatest(0L, x.t - s.last) div {b.refill_seconds}"
    tokens = f"least({b.tokens}L, s.tokens + ({whole}) * {b.refill_amount})"
    fold = f"""aggregate(r, named_struct('last', r[0].t, 'tokens', {b.tokens}L, 'out', cast(array() as array<boolean>)),
        (s, x) -> named_struct('last', s.last + ({whole}) * {b.refill_seconds}, 'tokens', greatest(0L, {tokens} - 1), 'out', concat(s.out, array({tokens} > 0))), s -> s.out)"""
    d = r.select(bucket, F.explode(F.expr(f"zip_with(r, {fold}, (x, y) -> named_struct('o', x.o, 'allowed', y))")).alias("x"))
    return d.select(bucket, F.col("x.o").alias(order), F.col("x.allowed").alias("allowed"))


def decide_large(requests: DataFrame, bucket: str, at: str, order: str, b: Bucket) -> DataFrame:
    """``decide`` for buckets of any size: rows arrive sorted and are folded batch by
    batch, with one pair of numbers per bucket as state. A null bucket is one too."""
    kind = dict(requests.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, state = object(), (0, b.tokens)
        for p in batches:
            out = []
            for k, t in zip(p.column(0).to_pylist(), p.column(1).to_pylist()):
                if k != who:
                    who, state = k, (t, b.tokens)
                last, tokens, ok = step(*state, t, b)
                state = (last, tokens)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(2), pa.array(out, pa.bool_())], names=[bucket, order, "allowed"])

    d = requests.select(F.col(bucket).alias("b"), F.col(at).cast("long").alias("t"), F.col(order).alias("o"))
    d = d.repartition("b").sortWithinPartitions("b", "t", "o")
    return d.mapInArrow(run, f"`{bucket}` {kind[bucket]}, `{order}` {kind[order]}, allowed boolean")


def decide_stream(requests: DataFrame, bucket: str, at: str, order: str, b: Bucket) -> DataFrame:
    """The same on a stream: state per bucket, requests of a micro-batch in order of
    (``at``, ``order``)."""
    kind = dict(requests.dtypes)

    def run(key, batches, state: GroupState):
        p = pd.concat(list(batches), ignore_index=True).sort_values([at, order])
        last, tokens = state.get if state.exists else (int(p[at].iloc[0]), b.tokens)
        out = []
        for t in p[at]:
            last, tokens, ok = step(last, tokens, int(t), b)
            out.append(ok)
        state.update((last, tokens))
        yield pd.DataFrame({bucket: p[bucket], order: p[order], "allowed": out})

    return requests.groupBy(bucket).applyInPandasWithState(run, f"`{bucket}` {kind[bucket]}, `{order}` {kind[order]}, allowed boolean", "last long, tokens long", "append", GroupStateTimeout.NoTimeout)
