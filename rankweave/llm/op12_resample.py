"""Importance resampling towards a target: hashed n-gram weights, Gumbel noise, and an exact top draw by merging runs.

Every document's features (its runs of one to three words) are hashed to buckets; a bucket's gain is the log ratio of
its share in the target to that in the documents. A batch's weights are array work: checksums of words, extended to
longer features by the linearity of the checksum, and sums of gains between running totals.

Weights plus noise are the scores. Each partition is written sorted, a run of its own; its eligible rows are dealt to
ranges of the order with about MERGE_ROWS rows each, however many share a score or an id, and a task merges the runs
of one range by a tournament tree. Ranges are counted, so each knows its first rank, those past the draw are never
merged, and the one that holds the last rank stops there. Only rows of drawn ranges are merged, and only their places
and scores move.

Defined cases: null and empty texts have no features and weight 0; a null id counts as empty text in the noise and comes
last in ties; repeated rows are documents of their own, and which of several equal rows comes first is arbitrary; with
no target every gain compares with an even spread; empty tables give no rows; input columns of any name are kept, but for
those that are added.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .shared import packed, stash, table, unpacked

BUCKETS, LONGEST = 10_000, 3
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
#: Rows that a task merges, about; a row is a place, a score and an id.
MERGE_ROWS = 250_000
#: Words of at most so many bytes are hashed a byte of all of them at a time.
SHORT = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _byte_table()


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of checksums, given as its values for each byte of each place."""
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """What checksums become when 0 to 255 bytes follow; and when 2**j bytes follow, for j from 8."""
    steps = [np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(256):
        steps.append(_CRC[steps[-1] & 255] ^ steps[-1] >> 8)
    powers = [steps[256]]
    for _ in range(32):
        powers.append(_apply(powers[-1], powers[-1].reshape(-1)).reshape(4, 256))
    return np.array(steps[:256]), powers


_STEPS, _POWERS = _shifts()


def followed(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The part of a checksum that comes from a beginning with checksum ``crc``, ``by`` bytes before the end."""
    low = by & 255
    out = _STEPS[low, 0, crc & 255] ^ _STEPS[low, 1, crc >> 8 & 255] ^ _STEPS[low, 2, crc >> 16 & 255] ^ _STEPS[low, 3, crc >> 24]
    rest, j = by >> 8, 0
    while rest.any():
        at = np.flatnonzero(rest & 1)
        out[at] = _apply(_POWERS[j], out[at])
        rest, j = rest >> 1, j + 1
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each word."""
    length = ends - starts
    order = np.argsort(length, kind="stable")
    at, size = starts[order], length[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for p in range(min(int(size[-1]), SHORT) if len(size) else 0):
        k = np.searchsorted(size, p, "right")
        crc[k:] = _CRC[(crc[k:] ^ data[at[k:] + p]) & 255] ^ crc[k:] >> 8
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(size, SHORT, "right")), len(size)):
        crc[i] = zlib.crc32(data[at[i] : at[i] + size[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(column, buckets: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, end row, words of each row, [(bucket, row) of all features of a length]) of runs of a text column's rows."""
    for lo, hi, data, offsets in textkit.slices(column):
        starts, ends, begin = textkit.spans(data, offsets, textkit.ALNUM)
        words, row = word_crcs(_LOWER[data], starts, ends), np.repeat(np.arange(hi - lo), np.diff(begin))
        length = ends - starts
        spaced = followed(np.full(len(words), zlib.crc32(b" "), np.uint32), length) ^ words
        found, crc = [(words % buckets, row)], words
        for more in range(1, LONGEST):
            crc = followed(crc[:-1], length[more:] + 1) ^ spaced[more:]
            inside = row[: len(crc)] == row[more:]
            found.append((crc[inside] % buckets, row[: len(crc)][inside]))
        yield lo, hi, np.diff(begin), found


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows' ``text`` by bucket; a task sends one row a bucket at most."""

    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for *_, found in features(b.column(0), buckets):
                for bucket, _ in found:
                    total += np.bincount(bucket, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    n, s_all, t_all = len(source), float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(target[i]) + 1) * s_all / ((float(source[i]) + 1) * t_all))) for i in range(n)], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """Thousandths of a standard Gumbel value that seed and id fix, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """row (docs' columns but id and text), doc_id, _words, n_features, weight, score."""
    rows = packed(docs, "doc_id", "text").select("row", "doc_id", "text")

    def weighed(batches):
        for b in batches:
            n_words, n_features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for lo, hi, words, found in features(b.column("text"), len(gain)):
                n_words[lo:hi] = words
                for bucket, row in found:
                    total, first = np.append(0, np.cumsum(gain[bucket])), np.searchsorted(row, np.arange(hi - lo + 1))
                    n_features[lo:hi] += np.diff(first)
                    weight[lo:hi] += np.diff(total[first])
            score = weight + np.array([noise(d, seed) for d in b.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *(pa.array(x) for x in (n_words, n_features, weight, score))], names=["row", "doc_id", "_words", "n_features", "weight", "score"])

    fields = rows.select("row", "doc_id", *(F.lit(0).cast("long").alias(c) for c in ("_words", "n_features", "weight", "score"))).schema
    return rows.mapInArrow(weighed, fields)


class Tournament:
    """Merges sorted runs: a tree of matches, of which only those on the last winner's way up are played again."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.width = runs, 1 << max(0, len(runs) - 1).bit_length()
        self.heads = [next(r, None) for r in runs] + [None] * (self.width - len(runs))
        self.winner = [0] * self.width + list(range(self.width))
        for match in range(self.width - 1, 0, -1):
            self._play(match)

    def _play(self, match: int) -> None:
        a, b = self.winner[2 * match], self.winner[2 * match + 1]
        x, y = self.heads[a], self.heads[b]
        self.winner[match] = a if y is None or x is not None and x < y else b

    def __iter__(self) -> Iterator[tuple]:
        while True:
            best = self.winner[1]
            if (head := self.heads[best]) is None:
                return
            yield head
            self.heads[best] = next(self.runs[best], None)
            match = self.width + best >> 1
            while match:
                self._play(match)
                match >>= 1


def _merged(t: pa.Table, first: int, most: int) -> pa.Table:
    """Ranks from ``first`` + 1 of the ``most`` best rows of a range; its runs are told by the high bits of ``at``."""
    t = t.take(pa.array(np.argsort(t.column("at").to_numpy(), kind="stable")))
    at, score, ids = (t.column(c).to_pylist() for c in ("at", "score", "doc_id"))
    cuts = [0, *(np.flatnonzero(np.diff(np.array(at, np.int64) >> 33)) + 1).tolist(), len(at)]
    keys = lambda lo, hi: ((-score[i], ids[i] is None, ids[i], at[i]) for i in range(lo, hi))
    won = [key[3] for key, _ in zip(Tournament([keys(lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False)]), range(most), strict=False)]
    return pa.table({"at": pa.array(won, pa.int64()), "rank": pa.array(np.arange(first + 1, first + 1 + len(won)))})


def ranks(runs: DataFrame, most: int) -> DataFrame:
    """at, rank of the first ``most`` rows by falling score and rising doc_id; nulls last, equal rows by their place."""
    rows = runs.select("at", "score", "doc_id")
    n = rows.count()
    most = min(most, n)
    ranges = max(1, math.ceil(n / MERGE_ROWS))
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("at"))
    dealt = stash(rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "ranges")
    first, upto = {}, 0
    for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        if upto < most:
            first[r["part"]] = upto
        upto += r["n"]
    last = max(first, default=-1)

    def merge(key, t):
        begin = first[key[0].as_py()]
        return _merged(t, begin, most - begin)

    return dealt.where(F.col("part") <= last).groupBy("part").applyInArrow(merge, "at long, rank long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """docs but for ``text``, with n_features, weight, score and rank, which is null for what isn't drawn.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred are drawn (rounded down).
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    ordered = _weighed(docs, gain, seed).sortWithinPartitions(F.col("_words") < least_words, F.desc("score"), F.asc_nulls_last("doc_id"))
    runs = stash(ordered.withColumn("at", F.monotonically_increasing_id()), "runs")
    eligible = runs.where(F.col("_words") >= least_words)
    drawn = stash(ranks(eligible, eligible.count() * percent // 100), "ranks")
    kept = [c for c in docs.columns if c.lower() != "text"]
    return unpacked(runs.join(drawn, "at", "left"), kept, "n_features", "weight", "score", "rank", apart=("doc_id",))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampled(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
