"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import covertree, language, lines, minhash, mixing, pieces, sharding, topk, toxicity, urls
from tidelog.llm.common import table

SHARD_BYTES = 1 << 20
#: The vocabulary file of operators 6 and 9, on the driver.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"), min_words=1).select("doc_id", "text", "n_lines", "n_removed")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk(table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), PIECES)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), PIECES)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) as x from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (
  select q.n, q.vec_id as query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT as score
  from v q join v on q.n <> v.n and len(q.x) = len(v.x) where q.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by n order by score desc, vec_id nulls last)::INTEGER as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

OP8_SQL = """
with recursive v as (select row_number() over () as n, vec_id, embedding::DOUBLE[] as x from embeddings),
u as (
  select n, x, sqrt(list_inner_product(x, x)) as norm from v
  where len(x) > 0 and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0 and list_inner_product(x, x) > 0),
l as (
  select a.n as i, b.n as j from u a join u b on a.n <> b.n and len(a.x) = len(b.x)
  where list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.9),
r(n, m) as (select n, n from v union select r.n, l.j from r join l on r.m = l.i),
c as (select r.n, min(v.vec_id) as component_id from r join v on v.n = r.m group by r.n),
k as (select i as n, count(*) as n_links from l group by i)
select v.vec_id, coalesce(k.n_links, 0)::BIGINT as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join c using (n) left join k using (n)
"""

OP7_SQL = f"""
with d as (
  select doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT as bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))), 1, 16))::UBIGINT as h
  from documents),
levels as (
  select doc_id, bytes, h, depth, case when depth = 0 then 0::UBIGINT else h >> (64 - depth) end as prefix
  from d, (select unnest(range(0, 33))::INTEGER as depth) k),
fits as (
  select depth, prefix from levels group by depth, prefix having sum(bytes) <= {SHARD_BYTES} or count(*) <= 1),
leaf as (
  select l.doc_id, l.bytes, l.h, min(l.depth) as depth
  from levels l join fits f on l.depth = f.depth and l.prefix = f.prefix group by all)
select doc_id, bytes, substr(lpad(bin(h), 64, '0'), 1, depth) as shard, depth from leaf
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_topk": op2_topk,
    "op3_mixing": op3_mixing,
    "op4_url_filters": op4_url_filters,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_sharding": op7_sharding,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_minhash": op10_minhash,
}
ORACLE: dict[str, str] = {"op2_topk": OP2_SQL, "op7_sharding": OP7_SQL, "op8_embedding_near_dedup": OP8_SQL}
