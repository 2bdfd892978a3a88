"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result as Parquet under the shared scratch folder and hands the
reread table to the next one.  All stages but the last return the columns of
their input; the last adds its assignment.  An empty table passes through all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import decontaminate, mixing, sharding, simhash, toxicity
from cohortlens.llm.common import written
from cohortlens.llm.queries import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the severity model, fitted on the labels of
    this input, rejects.  Null and empty texts stay, repeated rows are judged
    alike; where the labels tell nothing all rows stay."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of linked fingerprints: the least doc_id,
    null last.  Texts without words, null ones too, are one group; of rows equal
    in id and text one stays."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item.  Null and empty texts
    hold none; an empty benchmark keeps every row."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes it.  A null source is a
    source, the last one; documents without words go with their place in it."""
    return mixing.mixed(docs, labels=table(spark, sf_dir, "labels"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its size, shard and slot.  Equal texts share a shard, null
    texts are a group; repeated rows have slots of their own."""
    return sharding.sharded(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("decontamination", drop_leaks),
          ("mixing", mix_sources), ("sharding", shard)]

#: The fitted model, SimHash and the keys of the mix are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
