"""Documents to shards: language, near duplicates, benchmark leaks, mixing weights, shards.

Each stage takes what the one before has kept.  Null or empty texts go in the first stage (they
have no language); ids, sources and languages may be null; an empty table passes all stages.  Of rows
alike in id and text one stays; of near duplicates the smallest id stays, rows without an id always
do.  Very long texts are read whole by every stage.  Columns of any other names travel along; the last
stage's results (``virtual_slot``, ``shard``, ``map_version``) take the place of columns of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamwatch.llm import decontaminate, langid, mixing, neardup, sharding
from seamwatch.llm.common import durable, table

SHARDS = 40
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Hashing, sampling and compression have no SQL counterpart; the tests compare stages with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; ``lang`` is not changed."""
    dictionaries = langid.fit(docs)
    return langid.identify(docs, dictionaries).where("not lang_rejected").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of five-word shingles that are 0.8 alike."""
    return neardup.drop_near_duplicates(docs, 5)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities; sampling is what the stage is for."""
    return mixing.sample(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their virtual slot, shard and map version."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
