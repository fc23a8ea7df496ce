"""A training corpus from raw documents: five stages, each one an operator of tidewater.llm.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as the docs of the
next one. Null texts and ids, repeated rows, other columns and empty tables go through as the operators say: a null or
empty text is neither toxic nor a leak, and all texts without words are one group of near-duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontamination, minhash, mixing, sharding, toxicity
from tidewater.llm.common import materialize, release, release_since, scratch_mark

#: SQL cannot express the language model, the join by MinHash or the retrieval.
ORACLE_SQL = None
SHARDS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models predict to be toxic go."""
    return toxicity.kept(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest doc_id stays."""
    return minhash.first_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat as often as their source's weight asks for; copies stand as rows of their own."""
    mixed = mixing.mix(docs)
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard, of nearly equal bytes, and its slot there."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder, and a stage's scratch goes when its result stands."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark, before = scratch_mark(), docs
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release_since(mark, docs)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
