"""Session plumbing that several operators need: the shared folder, written intermediates, bounded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A side with at most so many rows may be broadcast; it is counted first, and a larger one is shuffled.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session of one machine (tests) uses a temporary folder; on a cluster that is an error, as
    other machines couldn't read it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = os.path.join(tempfile.gettempdir(), f"rankweave-{os.getpid()}")
    return at.rstrip("/")


@contextmanager
def released_shuffles(spark: SparkSession):
    """Within it, Spark deletes the shuffle files of each finished query; what was written stays."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stash(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    with released_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows (counted unless given), else df as it is."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str):
    """A column by its name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of df and then these columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def packed(df: DataFrame, *apart: str) -> DataFrame:
    """``row``, a struct of df's columns, so that no name of theirs meets one that is added; and the columns ``apart``."""
    held = [quoted(c) for c in df.columns if c not in apart]
    return df.select(F.struct(*(held or [F.lit(0).alias("nothing")])).alias("row"), *apart)


def unpacked(df: DataFrame, columns: list[str], *added, apart: tuple[str, ...] = ()) -> DataFrame:
    """The columns that ``packed`` put away (or left apart), then the added ones, which replace columns of their names."""
    taken = {c.lower() for c in df.select(*added).columns} if added else set()
    return df.select(*(quoted(c) if c in apart else F.col("row").getField(c).alias(c) for c in columns if c.lower() not in taken), *added)


def numbered(df: DataFrame, n: str, at: str, block: int = 4096) -> DataFrame:
    """Each row of df ``n`` times, numbered from 0 in the column ``at``; no array holds more than a block of numbers."""
    names = [quoted(c) for c in df.columns]
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / block))).alias("_block")
    rest = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(block).cast("long"), F.col(n) - F.col("_block") * block) - 1)).alias("_in")
    return df.where(F.col(n) > 0).select(*names, first).select(*names, "_block", rest).select(*names, (F.col("_block") * block + F.col("_in")).alias(at))
