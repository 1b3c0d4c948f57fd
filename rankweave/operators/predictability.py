"""How well labels follow from features alone: out-of-fold AUC of logistic fits, on columns or on hashed words.

Folds are dealt by a group's hash, so a group is never on both sides. Rows are first counted by (fold, features), as
many candidates look alike; the driver holds weights and sums of folds x buckets only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.sources.scratch import written

from . import learn

#: Scores leave rounded to so many places, so at most a million and one values are ordered.
PLACES = 6


def fold_of(group: Column, folds: int = 5) -> Column:
    """0 to folds - 1 by the group's md5; null counts as an empty name."""
    return (F.conv(F.left(F.md5(F.coalesce(group.cast("string"), F.lit(""))), F.lit(8)), 16, 10).cast("long") % folds).cast("int")


def counted_auc(scored: DataFrame) -> DataFrame:
    """n, n_pos, auc of rows with ``score`` and counts p (label 1) and q (label 0); ties count half. Without both labels auc is null."""
    per = scored.groupBy(F.round("score", PLACES).alias("score")).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    below = F.coalesce(F.sum("q").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = per.withColumn("below", below).agg(F.coalesce(F.sum(F.col("p") + F.col("q")), F.lit(0)).alias("n"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"))
    return total.select("n", "n_pos", F.round(F.try_divide(F.col("u"), F.col("n_pos") * (F.col("n") - F.col("n_pos"))), 4).alias("auc"))


def by_columns(rows: DataFrame, group: str, features: list[str], label: str, folds: int = 5) -> DataFrame:
    """Out-of-fold AUC of plain logistic fits (features standardised, ridge 1) to the other folds; one row. Null labels don't count.

    Rows of one fold, features and label are one row with their number, so the fits' jobs read as many rows as there are
    different ones.
    """
    known = rows.where(F.col(label).isNotNull()).select(fold_of(F.col(group), folds).alias("fold"), *features, F.col(label).cast("int").alias("y"))
    held = written(known.groupBy("fold", *features, "y").agg(F.count(F.lit(1)).alias("times")), "folds")
    scored = learn.leave_out(held, "fold", features, "y", balanced=False, times="times").scored(held, "fold").where("score IS NOT NULL")
    return counted_auc(scored.select("score", (F.col("y") * F.col("times")).alias("p"), ((1 - F.col("y")) * F.col("times")).alias("q")))


# ---- hashed words ------------------------------------------------------------------------------------------


@dataclass
class HashedFits:
    """For each fold left out: inverse document frequencies, weights and (last) intercept over hashed words."""

    idf: np.ndarray
    weights: np.ndarray
    jobs: int

    def scored(self, rows: DataFrame) -> DataFrame:
        """score, p, q of counted rows, by the fit without their fold."""
        idf, weights = self.idf, self.weights

        def score(batches):
            for b in batches:
                fold, own = b.column(0).to_numpy(zero_copy_only=False), _sparse(b.column(1), idf.shape[1])
                out = np.zeros(b.num_rows)
                for k in range(len(idf)):
                    out = np.where(fold == k, _margins(own, idf[k], weights[k], b.num_rows)[1], out)
                yield pa.RecordBatch.from_arrays([pa.array(1 / (1 + np.exp(-out))), b.column(2), b.column(3)], names=["score", "p", "q"])

        return rows.select("fold", "ids", "p", "q").mapInArrow(score, "score double, p long, q long")


def _sparse(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, times) of the buckets of each row."""
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    key, times = np.unique(row * width + lists.flatten().to_numpy(zero_copy_only=False), return_counts=True)
    return key // width, key % width, times


def _margins(own, idf: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, margins): times by frequencies, to length one in each row."""
    row, at, times = own
    value = times * idf[at]
    length = np.sqrt(np.bincount(row, value**2, n))
    value = value / np.where(length == 0, 1, length)[row]
    return value, np.bincount(row, value * weights[at], n) + weights[-1]


def counted(rows: DataFrame, group: str, words: str, label: str, folds: int = 5, width: int = 512) -> DataFrame:
    """fold, ids (buckets of the words, sorted, with repeats), p, q: rows that look alike are one."""
    ids = F.array_sort(F.transform(F.coalesce(F.col(words), F.array().cast("array<string>")), lambda x: F.pmod(F.crc32(x.cast("binary")), F.lit(width)).cast("int")))
    y = F.col(label).cast("long")
    return rows.select(fold_of(F.col(group), folds).alias("fold"), ids.alias("ids"), y.alias("y")).groupBy("fold", "ids").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))


def _sums(rows: DataFrame, shape: tuple[int, ...], add) -> np.ndarray:
    """An array added up over all batches: ``add(out, fold, sparse ids, p, q)``; one aggregate of the tasks' arrays."""

    def per_task(batches):
        out = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                add(out, b.column(0).to_numpy(zero_copy_only=False), b.column(1), *(b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out.reshape(-1)[at])], names=["at", "value"])

    out = np.zeros(int(np.prod(shape)))
    for r in rows.select("fold", "ids", "p", "q").mapInArrow(per_task, "at long, value double").groupBy("at").agg(F.sum("value")).collect():
        out[r[0]] = r[1]
    return out.reshape(shape)


def hashed_fits(rows: DataFrame, folds: int = 5, width: int = 512, tolerance: float = 1e-5, most: int = 150) -> HashedFits:
    """Logistic fits (ridge 1) to the rows outside of each fold, on tf-idf values that are fitted there too.

    rows: ``counted`` and written, as each job reads them. All folds take their L-BFGS steps in the same jobs; a job sums
    losses and gradients by fold. A fold whose step made things worse tries half of it in the next job.
    """

    def frequencies(out, fold, ids, p, q):
        row, at, _ = _sparse(ids, width)
        np.add.at(out, (fold[row], at), (p + q)[row])
        np.add.at(out, (fold, width), p + q)

    df = learn._without(_sums(rows, (folds, width + 1), frequencies))
    n, df = df[:, -1], df[:, :-1]
    idf = np.where(df > 0, np.log((1 + n[:, None]) / (1 + df)) + 1, 0.0)

    def loss(weights):
        def add(out, fold, ids, p, q):
            own = _sparse(ids, width)
            for k in range(folds):
                value, margin = _margins(own, idf[k], weights[k], len(fold))
                slope = np.where(fold == k, 0.0, (p + q) / (1 + np.exp(-margin)) - p)
                out[k, :width] += np.bincount(own[1], value * slope[own[0]], width)
                out[k, width] += slope.sum()
                out[k, width + 1] += np.where(fold == k, 0.0, p * np.logaddexp(0, -margin) + q * np.logaddexp(0, margin)).sum()

        found = _sums(rows, (folds, width + 2), add)
        ridge = weights * np.append(np.ones(width), 0.0)
        return found[:, -1] + (ridge**2).sum(1) / 2, found[:, :-1] + ridge

    at = np.zeros((folds, width + 1))
    value, slope = loss(at)
    past, size, jobs = [[] for _ in range(folds)], np.ones(folds), 2
    while jobs < most and (np.abs(slope).max(1) > tolerance * np.maximum(n, 1)).any():
        way = np.array([_quasi_newton(slope[k], past[k], n[k]) for k in range(folds)])
        trial = at + size[:, None] * way
        new_value, new_slope = loss(trial)
        jobs += 1
        good = new_value <= value + 1e-4 * size * (way * slope).sum(1)
        for k in np.flatnonzero(good):
            moved, turned = trial[k] - at[k], new_slope[k] - slope[k]
            if moved @ turned > 1e-12:
                past[k] = [*past[k], (moved, turned)][-10:]
        at[good], value[good], slope[good] = trial[good], new_value[good], new_slope[good]
        size = np.where(good, 1.0, size / 2)
    return HashedFits(idf, at, jobs)


def _quasi_newton(slope: np.ndarray, past: list, n: float) -> np.ndarray:
    """The way downhill that the last moves suggest; without any, a careful step along the slope."""
    out, shares = -slope, []
    if not past:
        return out / (n / 4 + 1)
    for moved, turned in reversed(past):
        shares.append((moved @ out) / (moved @ turned))
        out = out - shares[-1] * turned
    moved, turned = past[-1]
    out = out * (moved @ turned) / (turned @ turned)
    for (moved, turned), share in zip(past, reversed(shares), strict=True):
        out = out + (share - (turned @ out) / (moved @ turned)) * moved
    return out


def by_words(rows: DataFrame, group: str, words: str, label: str, folds: int = 5, width: int = 512) -> DataFrame:
    """Out-of-fold AUC of logistic fits on hashed tf-idf words; one row. Null labels don't count."""
    held = written(counted(rows.where(F.col(label).isNotNull()), group, words, label, folds, width), "hashed")
    return counted_auc(hashed_fits(held, folds, width).scored(held))
