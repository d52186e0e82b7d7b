"""What the operators of this subpackage share: reading columns by name,
intermediate tables that all executors can read, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STORED = "tidelog-stored"
_made: list[str] = []  # paths of stored tables, in order


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session. Where that is unset, a local folder if everything runs on this
    machine (``local[...]``), else an error: executors could not see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def store(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read from there:
    its lineage is cut, and a lost executor costs no earlier stage again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_STORED}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    _made.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``store`` returned and that nothing reads any more."""
    for f in frames:
        if path := f.__dict__.get("_stored_at"):
            _delete(f.sparkSession, path)


def stored() -> int:
    """How many tables were stored so far: a mark for ``discard_since``."""
    return len(_made)


def discard_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete the tables stored since ``mark`` but ``keep``, when what reads them is
    stored itself."""
    kept = {f.__dict__.get("_stored_at") for f in keep}
    for path in _made[mark:]:
        if path not in kept:
            _delete(spark, path)
    _made[mark:] = [p for p in _made[mark:] if p in kept]


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once the results that read
    them are written."""
    _delete(spark, f"{shared_dir(spark)}/{_STORED}/{spark.sparkContext.applicationId}")
    _made.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1, ... by place, so that no name of the
    caller's can clash with one of an operator's own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str:
    """What ``numbered`` calls the (first) column of exactly this name."""
    return f"c{df.columns.index(name)}"


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever the others are called."""
    return numbered(df).select(*[F.col(place(df, n)).alias(n) for n in names])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (u, v, both long).

    Returns (node, component) for every node of an edge; component is the
    smallest node reachable. Alternates the large-star and small-star steps,
    each an aggregated minimum per node joined back to the edges, until the
    edges no longer change; a hub's edges are split by the skew join, never
    gathered in one task. Null ends and self-loops are ignored.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    e = e.filter("u is not null and v is not null and u <> v")
    e = store(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.filter("v > u").join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        wide = store(large.filter("u <> v").distinct(), "large")
        second = store(wide.groupBy("u").agg(F.min("v").alias("m")), "low")
        joined = wide.join(second, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = store(small.unionByName(second.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(e, first, wide, second)
        e = now
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
