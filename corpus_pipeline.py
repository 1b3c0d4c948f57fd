"""A training corpus from raw documents: classify, deduplicate, decontaminate, mix, shard.

Each stage takes what its predecessor kept, with the columns of ``documents``; the last deals the mixed rows
into shards and adds their places. ``run`` chains the stages, each written to the shared folder and read
again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import op01_mix, op02_quality, op03_shards, op07_decontaminate, op09_neardup
from rankweave.llm.shared import quoted, stash, table

SHARDS = 40
#: Near copies share 80 % of their 5-word shingles or 85 % of their 3-word ones: the first also finds longer changes
#: at one place, the second more changes of single words.
NEAR = ((3, 85), (5, 80))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from all of ``documents``' labels that aren't held out."""
    return op02_quality.accepted(docs, op02_quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return op09_neardup.deduplicated(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    return op07_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (possibly never)."""
    return op01_mix.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot, in shuffled order; columns of docs that have a name of those added are replaced."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    added = {"size": size, "text_crc32": F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)), "law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}
    dealt = op03_shards.shard(docs, SHARDS, weight=size)
    names = [*added, "shard", "slot"]
    return dealt.withColumns(added).select(*(quoted(c) for c in docs.columns if c.lower() not in names), "size", "text_crc32", "law", "shard", "slot", "grown_shard")


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources", mixing), ("sharding", sharding)]

#: SQL can express neither the learned classifier nor the random draws; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
