"""A corpus pipeline of five stages; each takes what the one before kept, written and read again.

Quality rules drop documents that a rule rejects, so null, empty and very short texts end here. Of near copies (five words,
similarity 0.8) the row of the smallest id stays, rows without an id last; of equal ids the text of the smallest digest, and of
rows equal in both one. Documents with a benchmark passage go. The mix repeats or leaves out documents of each source as its
target asks. Sharding adds size, text_crc32, shard and slot; all stages before it return the documents' columns. Other
columns pass through, whatever their names, but for these four. Ids may be null and may repeat. An empty table gives no
rows at every stage, and a table that a stage empties none after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heritree.llm import decontamination, mixing, quality, sharding, simhash
from heritree.llm.common import read, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded_rows(docs)


STAGES = [("quality rules", quality_rules), ("near copies", near_copies), ("benchmark passages", benchmark_passages), ("source mix", source_mix), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
