"""Paired statistics over per-issue values, as aggregates; only p-values of finished counts are computed in Python."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def average_rank(c: str) -> Column:
    """Rank with ties at their mean. Meant for per-group tables (one row a repo), as it orders all rows."""
    return F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2.0


def cohens_d(pairs: DataFrame) -> DataFrame:
    """d of va - vb and its label."""
    d = pairs.agg((F.avg(F.col("va") - F.col("vb")) / F.stddev_samp(F.col("va") - F.col("vb"))).alias("x"))
    size = F.when(F.abs("x") < 0.2, "negligible").when(F.abs("x") < 0.5, "small").when(F.abs("x") < 0.8, "medium").otherwise("large")
    return d.select(F.round("x", 5).alias("d"), size.alias("size"))


def mcnemar_p(n10: int, n01: int) -> float:
    """Exact two-sided binomial below 25 discordant pairs, else chi-square with continuity correction."""
    n = n10 + n01
    if not n:
        return 1.0
    if n < 25:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(n10, n01) + 1)) / 2**n)
    return math.erfc(math.sqrt((abs(n10 - n01) - 1) ** 2 / n / 2))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """n11, n10, n01, n00 of boolean a and b, and p. The counts are one row, so p is a scalar function of it."""
    p = F.udf(mcnemar_p, "double")
    counts = pairs.agg(F.count_if(F.expr("a AND b")).alias("n11"), F.count_if(F.expr("a AND NOT b")).alias("n10"), F.count_if(F.expr("NOT a AND b")).alias("n01"), F.count_if(F.expr("NOT a AND NOT b")).alias("n00"))
    return counts.withColumn("p", F.round(p("n10", "n01"), 6))


def wilcoxon(diffs: DataFrame) -> DataFrame:
    """n, w_plus, w_minus, z of signed ranks of the nonzero ``diff`` (one row a group)."""
    x = diffs.select(F.round("diff", 9).alias("diff")).where("diff <> 0").withColumn("a", F.abs("diff"))
    ranked = x.select("diff", average_rank("a").alias("r"))
    w = ranked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("diff") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("diff") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus"))
    mean, var = F.col("n") * (F.col("n") + 1) / 4, F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24
    return w.withColumn("z", F.try_divide(F.col("w_plus") - mean, F.sqrt(var)))


def poisson_cuts() -> list[float]:
    """Upper ends of the probabilities of 0, 1, 2, ... under Poisson(1)."""
    cut, total, k = [], 0.0, 0
    while total < 1 - 1e-9:
        total += math.exp(-1) / math.factorial(k)
        cut.append(total)
        k += 1
    return cut


def bootstrap(values: DataFrame, cluster: str, resamples: int, seed: int = 42) -> DataFrame:
    """n, mean, lo, hi (2.5 % and 97.5 %), p (two-sided, at least 1 / resamples) of resampled means of ``v``.

    Clusters are first summed to (sum, count). Instead of drawing clusters, each gets a Poisson(1) multiplicity in each
    resample from the hash of (seed, cluster, resample), so resamples are plain sums in parallel and reruns agree.
    """
    # (a stated number of parts: few clusters are still much work)
    parts = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), values.sparkSession.sparkContext.defaultParallelism)
    per = values.repartition(parts, cluster).groupBy(cluster).agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    reps = values.sparkSession.range(resamples).withColumnRenamed("id", "b")
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), cluster, "b")), 1, 8), 16, 10).cast("double") / 4294967296
    cut = poisson_cuts()
    times = F.lit(len(cut) - 1)
    for i in range(len(cut) - 2, -1, -1):
        times = F.when(F.col("u") < cut[i], i).otherwise(times)
    drawn = per.crossJoin(F.broadcast(reps)).withColumn("u", u).withColumn("t", times)
    means = drawn.groupBy("b").agg(F.try_divide(F.sum(F.col("t") * F.col("s")), F.sum(F.col("t") * F.col("n"))).alias("m"))
    ends = means.agg(F.percentile("m", [0.025, 0.975]).alias("q"), F.avg((F.col("m") <= 0).cast("int")).alias("below"), F.avg((F.col("m") >= 0).cast("int")).alias("above"))
    point = per.agg(F.sum("n").alias("n"), F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))
    p = F.greatest(F.lit(1 / resamples), F.least(F.lit(1.0), 2 * F.least("below", "above")))
    return point.crossJoin(ends).select("n", F.round("mean", 6).alias("mean"), F.round(F.col("q")[0], 6).alias("lo"), F.round(F.col("q")[1], 6).alias("hi"), F.round(p, 6).alias("p"))
