"""Rank fusion, score normalisation, boosts and gates over the ranked relation (repo, issue_id, path, rank, score)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("repo", "issue_id")
#: Added before rounding, so that sums that lie exactly half-way round alike in whatever order they were added.
TIE = 1e-9


def lists(*ranked: DataFrame) -> DataFrame:
    """All lists in one relation, ``list`` numbering them from 0."""
    out = None
    for i, r in enumerate(ranked):
        own = r.select(*KEY, "path", "rank", "score", F.lit(i).alias("list"))
        out = own if out is None else out.unionByName(own)
    return out


def rerank(scored: DataFrame, *order: Column) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(*(order or (F.desc("score"),)), "path")))


def weight_of(weights: list[float]) -> Column:
    return F.element_at(F.array(*map(F.lit, weights)), F.col("list") + 1)


def rrf(all_lists: DataFrame, weights: list[float], k: int = 60, origin: int = 1) -> DataFrame:
    """Sum of weight / (k + rank), ranks counted from ``origin``."""
    part = weight_of(weights) / (k + F.col("rank") - 1 + origin)
    return rerank(all_lists.groupBy(*KEY, "path").agg(F.round(F.sum(part) + TIE, 6).alias("score")))


def rrf_of(places: list[Column], weights: list[float], k: int = 60, origin: int = 1) -> Column:
    """``rrf``'s score of a file from its places (from 1; 0: absent) in each list."""
    return F.round(sum(F.when(p > 0, F.lit(w) / (k + p - 1 + origin)).otherwise(0.0) for p, w in zip(places, weights, strict=True)) + TIE, 6)


def minmax_of(scores: list[Column], ends: list[tuple[Column, Column]], weights: list[float]) -> Column:
    """``minmax_fusion``'s score of a file from its scores (null: absent) and each list's least and greatest score."""
    part = lambda s, lo, hi, w: F.coalesce((s - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo) * w, F.lit(0.0))
    return F.round(sum(part(s, lo, hi, w) for s, (lo, hi), w in zip(scores, ends, weights, strict=True)), 6)


def rrf_missing(all_lists: DataFrame, n_lists: int, k: int = 60, penalty: int = 100) -> DataFrame:
    """A list that hasn't an item gives it the rank list length + penalty."""
    items = all_lists.select(*KEY, "path").distinct()
    lengths = all_lists.groupBy(*KEY, "list").agg(F.count(F.lit(1)).alias("n"))
    every = items.crossJoin(F.broadcast(items.sparkSession.range(n_lists).select(F.col("id").cast("int").alias("list"))))
    full = every.join(all_lists.select(*KEY, "path", "list", "rank"), [*KEY, "path", "list"], "left").join(lengths, [*KEY, "list"], "left")
    rank = F.coalesce(F.col("rank") - 1, F.coalesce("n", F.lit(0)) + penalty)
    return rerank(full.groupBy(*KEY, "path").agg(F.round(F.sum(1.0 / (k + rank)), 6).alias("score")))


def vote(all_lists: DataFrame, weights: list[float], top: int = 10) -> DataFrame:
    """Weighted votes of the lists whose top has the item, then the mean rank."""
    voted = all_lists.groupBy(*KEY, "path").agg(F.round(F.sum(F.when(F.col("rank") <= top, weight_of(weights)).otherwise(0.0)), 6).alias("score"), F.round(F.avg("rank"), 6).alias("mean_rank"))
    return rerank(voted, F.desc("score"), F.asc("mean_rank"))


def interleave(all_lists: DataFrame) -> DataFrame:
    """Round robin over the lists; an item stays where it comes first."""
    first = all_lists.groupBy(*KEY, "path").agg(F.min(F.struct("rank", "list")).alias("at"))
    return rerank(first, F.asc("at")).drop("at")


def minmax(c: str = "score", over: tuple[str, ...] = KEY, eps: float = 0.0) -> Column:
    w = Window.partitionBy(*over)
    low, span = F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)
    return (F.col(c) - low) / (span + eps if eps else F.when(span == 0, 1.0).otherwise(span))


def zscore(c: str = "score", over: tuple[str, ...] = KEY) -> Column:
    w = Window.partitionBy(*over)
    return (F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-9)


def minmax_fusion(all_lists: DataFrame, weights: list[float]) -> DataFrame:
    scaled = all_lists.withColumn("s", minmax(over=(*KEY, "list")) * weight_of(weights))
    return rerank(scaled.groupBy(*KEY, "path").agg(F.round(F.sum("s"), 6).alias("score")))


def both(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Two scorers side by side: score_a, rank_a, score_b, rank_b."""
    side = lambda r, x: r.select(*KEY, "path", F.col("rank").alias(f"rank_{x}"), F.col("score").alias(f"score_{x}"))
    return side(a, "a").join(side(b, "b"), [*KEY, "path"], how)


def gap(ranked: DataFrame) -> DataFrame:
    """repo, issue_id, gap between the two best scores; infinite with fewer than two."""
    top = ranked.where("rank <= 2").groupBy(*KEY).agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("x"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("y"))
    return top.select(*KEY, F.coalesce(F.round(F.col("x") - F.col("y"), 6), F.lit(float("inf"))).alias("gap"))


def gated(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """List a where its gap is over the threshold, else list b."""
    g = gap(a)
    return a.join(g.where(F.col("gap") > threshold).select(*KEY), list(KEY), "left_semi").unionByName(b.join(g.where(F.col("gap") <= threshold).select(*KEY), list(KEY), "left_semi"))


def testpair_boost(ranked: DataFrame, factor: float = 0.5) -> DataFrame:
    """ranked with ``factor`` times the score of a file's test or source in the same list added, if that is positive.

    ``x_test.py`` belongs to ``x.py`` beside it, ``test_x.py`` to ``x.py`` beside it or, failing that, a folder up. A
    file that is a test takes its source's score; one with several tests takes that of the last in the list.
    """
    name, folder = F.substring_index("path", "/", -1), F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    up = F.regexp_extract(folder, "^(.*)/[^/]*$", 1)
    put = lambda d, n: F.when(d == "", n).otherwise(F.concat(d, F.lit("/"), n))
    bare = F.regexp_replace(name, "^test_", "")
    where = F.when(name.contains("_test.py"), F.array(put(folder, F.replace(name, F.lit("_test.py"), F.lit(".py"))))).when(name.startswith("test_"), F.array(put(folder, bare), put(up, bare)))
    asked = ranked.select(*KEY, F.col("path").alias("test"), F.col("rank").alias("at"), F.col("score").alias("test_score"), F.posexplode(where).alias("i", "path"))
    pairs = asked.join(ranked.select(*KEY, "path", "score"), [*KEY, "path"]).groupBy(*KEY, "test", "at", "test_score").agg(F.min(F.struct("i", "path", "score")).alias("source"))
    of_test = pairs.select(*KEY, F.col("test").alias("path"), F.col("source.score").alias("own"))
    of_source = pairs.groupBy(*KEY, F.col("source.path").alias("path")).agg(F.max_by("test_score", "at").alias("other"))
    both_ways = ranked.join(of_test, [*KEY, "path"], "left").join(of_source, [*KEY, "path"], "left")
    pair = F.coalesce("own", "other")
    return both_ways.withColumn("score", F.col("score") + factor * F.when(pair > 0, pair).otherwise(0.0)).select(*ranked.columns)


def rounded(x: np.ndarray) -> np.ndarray:
    """To six places, half away from zero, as SQL rounds doubles."""
    x = x * 1e6
    return np.copysign(np.floor(np.abs(x) + 0.5), x) / 1e6


def best_of_pair(rows: DataFrame, scores: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """name, hits, n of each score of two: how many rows have a true file in first place, of how many.

    rows: a, b (scores) and gt, arrays of an issue's files; of equal scores the earlier file is first. No array is empty.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, n = dict.fromkeys(scores, 0), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch["a"].value_lengths().to_numpy(zero_copy_only=False)
            a, b, gt = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("a", "b", "gt"))
            start, row = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
            n += len(size)
            for name, of in scores.items():
                s = of(a, b)
                top = np.flatnonzero(s == np.maximum.reduceat(s, start)[row])
                hits[name] += int(gt[top[np.append(True, np.diff(row[top]) > 0)]].sum())
        if n:
            yield pa.RecordBatch.from_pydict({"name": list(scores), "hits": list(hits.values()), "n": [n] * len(scores)})

    counted = rows.select("a", "b", "gt").mapInArrow(count, "name string, hits long, n long")
    return counted.groupBy("name").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
