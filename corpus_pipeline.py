"""The corpus pipeline: language, near duplicates, benchmark leaks, source weights, shards.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has kept, and is written and read again.
All but the last return the columns they were given, whatever those are called. An empty table stays empty, and a null
in a column that a stage does not read plays no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidecell.functions.stage import discard, discard_but, tracked
from tidecell.llm import decontam, langid, mixing, nearcopies, sharding
from tidecell.llm.common import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is rejected: texts that are null, empty or without letters, and those far from every language. Rows that
    repeat share their fate; a null lang or doc_id is only left out of the learning."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of texts that five-word similarities of 0.8 or more link;
    rows that repeat it stay together, null and empty texts are one group, and null ids stay only where a whole group has
    none, and then those with the text of the least hash."""
    return nearcopies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of benchmark; null and empty texts stay, rows that repeat share their fate."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until each source has its share; a null text or one without words goes, a null
    source is a source, and of rows that repeat (doc_id, source, text) one stands for all, as often as all are taken."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds slot and shard by doc_id; a null doc_id is placed by its text. Rows that repeat share a shard."""
    return sharding.assign(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: No stage but the last can be put in SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with tracked() as written:
            kept = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard_but(written, kept)  # what the stage wrote on its way
        discard(docs)
        docs = kept
    return docs
