"""The corpus pipeline: from raw documents to token ids.

Each stage works on all rows that its predecessor kept, and returns the columns
of ``documents`` except the last, which returns token ids. Stages handle null
and empty texts, repeated rows and empty tables as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import lines, minhash, mixing, pieces, toxicity
from tidelog.llm.catalogue import PIECES
from tidelog.llm.common import discard, discard_since, numbered, place, store, stored, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; learned from ``labels`` of the documents given."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs of any length go from the texts; n_chars follows."""
    kept = numbered(lines.dedup_lines(docs, min_words=1, counts=False))
    text, size = place(docs, "text"), place(docs, "n_chars")
    now = F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col(size)).cast(dict(kept.dtypes)[size])
    return kept.withColumn(size, now).toDF(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return pieces.encode(docs, PIECES, ("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", one_of_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]

#: No SQL: a classifier and seeded hashes decide. Tests hold the stages against brute force
#: (line dedup, near copies, targets of the mix), held-out labels and round trips.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        mark = stored()
        docs, before = store(stage(spark, docs, sf_dir), name.split()[0]), docs
        discard_since(spark, mark, docs)
        discard(before)
    return docs
