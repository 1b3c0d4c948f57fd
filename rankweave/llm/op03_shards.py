"""Sharding by a two-pass external shuffle, in DataFrame functions alone.

Pass one scatters records into memory-sized buckets by a seeded hash of their content. Pass two loads one
bucket at a time, runs Fisher-Yates over it (Spark's seeded ``shuffle``) and deals the shuffled run into
shards: bucket after bucket, records take consecutive places 0, 1, 2, ..., and every shard owns an equal
range of places. So shards differ by one record at most (law ``rows``), slots have no gaps, and a bucket is
written to one shard or two neighbours without another exchange.

Defined cases: a null text has no bytes (size 16, crc32 0); null ids and sources are values like any other;
identical rows are counted before the exchange and numbered, so that copies scatter like distinct records;
an empty table gives an empty result; input columns named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import numbered, packed, small, stash, table, unpacked

#: A bucket holds about so many records, and about so many bytes of them, whichever is fewer records.
BUCKET_ROWS = 1024
BUCKET_BYTES = 8 << 20
#: Buckets that one task of the second pass loads, one after another.
TASK_BUCKETS = 16
#: Buckets whose places are summed together; the running total of such groups is all that one task sees.
GROUP = 1024


def scatter(records: DataFrame, seed: int, weight: Column | None = None) -> tuple[DataFrame, int]:
    """Pass one: ``row`` (a record's columns), its ``copy`` (0, 1, ... among identical ones), ``hash`` and ``bucket``; and the bucket count.

    weight: a record's bytes in memory, where it carries more than a few numbers.
    """
    rows, size = records.agg(F.count(F.lit(1)), F.sum(F.lit(0) if weight is None else weight)).first()
    buckets = max(1, math.ceil(rows / BUCKET_ROWS), math.ceil((size or 0) / BUCKET_BYTES))
    counted = packed(records).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    out = numbered(counted, "n", "copy").select("row", "copy", F.xxhash64(F.lit(seed), "row", "copy").alias("hash"))
    return out.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "hash"), F.lit(buckets))), buckets


def fisher_yates(scattered: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Pass two: ``bucket``, ``at`` (place in the shuffled bucket) and the record's ``row``.

    A bucket is sorted before it is shuffled and the number of partitions is fixed by the number of buckets, so
    a task that runs again after a loss shuffles alike.
    """
    tasks = max(min(buckets, 64), math.ceil(buckets / TASK_BUCKETS))
    return (
        scattered.repartition(tasks, "bucket")
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list(F.struct("hash", "copy", "row"))).alias("all"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle("all", F.lit(seed)).alias("all"))
        .select("bucket", F.posexplode("all").alias("at", "one"))
        .select("bucket", F.col("at").cast("long").alias("at"), F.col("one.row").alias("row"))
    )


def offsets(scattered: DataFrame) -> tuple[DataFrame, int]:
    """The first place of every bucket, and the number of records. Sums run inside groups of buckets, then over groups."""
    sizes = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("_group", F.floor(F.col("bucket") / GROUP))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("_group").agg(F.sum("n").alias("n"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    groups = groups.select("_group", before(Window.orderBy("_group")).alias("_far"))
    near = sizes.withColumn("_near", before(Window.partitionBy("_group").orderBy("bucket")))
    return near.join(groups, "_group").select("bucket", (F.col("_far") + F.col("_near")).alias("first")), total


def shard(records: DataFrame, shards: int, seed: int = 1, weight: Column | None = None) -> DataFrame:
    """records with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... inside the shard), in uniformly random order.

    Written with ``sortWithinPartitions("shard", "slot")`` the rows of a shard are read back in slot order.
    """
    scattered, buckets = scatter(records, seed, weight)
    scattered = stash(scattered, "scattered")
    first, total = offsets(scattered)
    dealt = fisher_yates(scattered, buckets, seed).join(small(first, buckets), "bucket")
    few, more = total // shards, total % shards
    head = more * (few + 1)  # the places of the shards that have one record more
    place = F.col("place")
    of = F.when(place < head, F.floor(place / (few + 1))).otherwise(more + F.floor((place - head) / max(few, 1))).cast("int")
    start = F.col("of") * few + F.least(F.col("of"), F.lit(more))
    dealt = dealt.select("row", (F.col("first") + F.col("at")).alias("place")).withColumn("of", of)
    return unpacked(dealt, records.columns, F.col("of").alias("shard"), (place - start).cast("long").alias("slot"))


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16), the text's unsigned CRC-32, and the columns ``more``."""
    return docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        *more,
    )


def whole(docs: DataFrame, shards: int) -> DataFrame:
    """The documents themselves, texts and all, in shards; a row weighs its text's bytes and 16."""
    return shard(docs, shards, weight=F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16)


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``rows``; size and checksum are taken from the texts that were dealt."""
    dealt = whole(table(spark, sf_dir, "documents"), 40)
    return digest(measured(dealt, "shard", "slot"))


def digest(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
