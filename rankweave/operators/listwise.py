"""Listwise reranking by windows over a list, and promotion of files that an issue names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["repo", "issue_id"]


def starts(n: Column, window: int, step: int) -> Column:
    """Where the windows over n items begin (from 0), the lowest window first; the last one begins at the top."""
    if window < 2 or not 0 < step <= window:
        raise ValueError("the window needs two items, and the step must be in 1 .. window")
    room = F.greatest(n - window, F.lit(0))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(room / step)), lambda i: F.greatest(room - i * step, F.lit(0)).cast("int"))


def slid(items: Column, window: int, step: int) -> Column:
    """An array after its windows were sorted one after another; windows overlap by ``window - step``."""
    n = F.size(items)
    put = lambda done, lo: F.concat(F.slice(done, F.lit(1), lo), F.array_sort(F.slice(done, lo + 1, F.lit(window))), F.slice(done, lo + window + 1, n))
    return F.aggregate(starts(n, window, step), items, put)


def sliding_rerank(ranked: DataFrame, order: list[Column], window: int, step: int) -> DataFrame:
    """repo, issue_id, path, rank after listwise passes from the bottom of each list to its top.

    ranked: repo, issue_id, path, rank; a window is put in the order of the columns ``order``, equal ones by path. A list
    is one array, as windows depend on each other; lists are short.
    """
    item = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), F.col("path"))
    lists = ranked.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("list"))
    placed = lists.select(*KEY, F.posexplode(slid(F.transform("list", lambda x: x["item"]), window, step)).alias("at", "item"))
    return placed.select(*KEY, F.col("item.path").alias("path"), (F.col("at") + 1).cast("long").alias("rank"))


def _raised(rows: DataFrame, asked: Column, most: int, first: int, last: int) -> DataFrame:
    """rows with ``place`` (from 0) after up to ``most`` of the asked ones moved up, the most relevant first.

    They stand together from place ``first`` on; those for which there is no place up to ``last`` stand at its end, the
    last of them first. All others keep their order around them.
    """
    chosen = Window.partitionBy(*KEY, "_asked").orderBy(F.desc("relevance"), "old")
    rows = rows.withColumn("_asked", asked).withColumn("_k", F.row_number().over(chosen) - 1)
    rows = rows.withColumn("moved", F.col("_asked") & (F.col("_k") < most))
    n = F.sum(F.col("moved").cast("int")).over(Window.partitionBy(*KEY))
    fits = last - first
    block = first + F.when(F.col("_k") < fits, F.col("_k")).otherwise(fits + n - 1 - F.col("_k"))
    other = F.row_number().over(Window.partitionBy(*KEY, "moved").orderBy("place")) - 1
    place = F.when(F.col("moved"), block).otherwise(other + F.when(other >= first, n).otherwise(0))
    return rows.withColumn("_to", place).withColumn("place", F.col("_to")).drop("_asked", "_k", "_to")


def promoted(ranked: DataFrame, original: int, top5: int = 1, top10: int = 2, threshold: float = 0.3) -> DataFrame:
    """repo, issue_id, path, rank with files past the first ``original`` moved up by relevance (of equal ones the earlier).

    Up to ``top5`` of them that reach the threshold go behind the original ones, to the fifth place at the latest; then
    up to ``top10`` others that reach 0.7 of it and stand past the fifth place go to the sixth and the next, to the tenth
    at the latest. ranked: repo, issue_id, path, rank, relevance. Places are keys, so each step is a sort in the list.
    """
    rows = ranked.select(*KEY, "path", "relevance", F.col("rank").alias("old"), (F.row_number().over(Window.partitionBy(*KEY).orderBy("rank")) - 1).alias("place"))
    rows = rows.withColumn("new", F.col("place") >= original)
    rows = _raised(rows, F.col("new") & (F.col("relevance") >= threshold), top5, min(original, 4), 4).withColumnRenamed("moved", "up")
    rows = _raised(rows, F.col("new") & ~F.col("up") & (F.col("relevance") >= threshold * 0.7) & (F.col("place") >= 5), top10, 5, 9)
    return rows.select(*KEY, "path", (F.col("place") + 1).cast("long").alias("rank"))
