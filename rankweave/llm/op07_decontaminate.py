"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are its runs of WINDOW words (an item of fewer words is one window). A window is a set of
SHINGLE-word shingles, all of which a document must have to contain it, so one necessary shingle is enough
as prefix: the rarest, by occurrences counted over all documents. A scan of the documents looks up prefix
shingles only; a hit at some place fixes where the window would have to lie, which is dropped if it would
leave the document (length and positional bounds) and otherwise verified word by word.

Items are taken in blocks of about BLOCK_BYTES, so what every task holds is bounded however many items there
are; block after block adds its hits to the rows that stream by.

Defined cases: null and empty texts have no words and no hits; items without words or without an id are
ignored; repeated items count once and repeated documents are judged alike; no items leave every document clean;
input columns of any name are kept.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .shared import packed, table, unpacked

WINDOW, SHINGLE = 13, 5
BLOCK_BYTES = 8 << 20
FILTER_BITS = 22
_HASH = textkit.Hasher(707, lower=True)
_RUNS, _ITEMS = pa.list_(pa.int64()), pa.list_(pa.string())


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a small column's rows, and each row's first word."""
    data, offsets = textkit.flat(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    starts, ends, begin = textkit.spans(data, offsets, textkit.ALNUM)
    return _HASH.words(data, starts, ends), begin


class Lookup:
    """Finds which of a document batch's values are in a sorted table; a bitmap turns most away first."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in x, their places in the table)."""
        at = np.flatnonzero(self.seen[(x >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        ok = self.values[place] == x[at]
        return at[ok], place[ok]


class Block:
    """The distinct windows of some items, ready to be found in documents."""

    def __init__(self, rows: list):
        words, begin = _words(pa.array([r["text"] for r in rows], pa.large_string()))
        windows: dict[bytes, tuple[np.ndarray, set[str]]] = {}
        for r, lo, hi in zip(rows, begin, begin[1:], strict=False):
            for p in range(lo, max(lo + 1, hi - WINDOW + 1)) if hi > lo else ():
                w = words[p : min(p + WINDOW, hi)]
                windows.setdefault(w.tobytes(), (w, set()))[1].add(r["id"])
        self.words = [w for w, _ in windows.values()]
        self.items = [sorted(i) for _, i in windows.values()]
        self.shingles = [_HASH.windows(w, min(SHINGLE, len(w))) for w in self.words]
        #: shingles are looked up by their width, as short items have short ones
        self.widths = {k: Lookup(np.concatenate([s for s, w in zip(self.shingles, self.words, strict=True) if min(SHINGLE, len(w)) == k])) for k in {min(SHINGLE, len(w)) for w in self.words}}
        self.prefix: dict[int, tuple] = {}

    def choose(self, counts: dict[tuple[int, int], int]) -> None:
        """Fix each window's prefix: its rarest shingle, by (width, hash) counts."""
        by: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for no, (s, w) in enumerate(zip(self.shingles, self.words, strict=True)):
            k = min(SHINGLE, len(w))
            at = min(range(len(s)), key=lambda i: (counts.get((k, int(s[i])), 0), int(s[i]), i))
            by.setdefault(k, {}).setdefault(int(s[at]), []).append((no, at))
        for k, found in by.items():
            look = Lookup(np.array(list(found), np.uint64))
            lists = [found[int(v)] for v in look.values]
            first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            pairs = np.array([p for x in lists for p in x])
            self.prefix[k] = (look, first, pairs[:, 0], pairs[:, 1])
        self.lengths = np.array([len(w) for w in self.words])
        self.start = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        del self.shingles, self.widths

    def occurrences(self, words: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, window) of every place where a window occurs in a batch of documents."""
        out = [np.zeros((3, 0), np.int64)]
        for k, (look, first, window, offset) in self.prefix.items():
            at, place = look.find(_HASH.windows(words, k))
            many = first[place + 1] - first[place]
            at = np.repeat(at, many)
            pair = np.repeat(first[place], many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            p, no = at - offset[pair], window[pair]
            row = np.searchsorted(begin, at, "right") - 1
            ok = (p >= begin[row]) & (p + self.lengths[no] <= begin[row + 1])
            row, p, no = row[ok], p[ok], no[ok]
            for i in range(WINDOW):
                more = i < self.lengths[no]
                same = ~more
                same[more] = words[p[more] + i] == self.flat[self.start[no[more]] + i]
                row, p, no = row[same], p[same], no[same]
            out.append(np.array([row, p, no]))
        return tuple(np.concatenate(out, axis=1))


def _merged(runs: list[int]) -> list[int]:
    """Disjoint runs in order, as start, end, start, end, ..., of any such runs."""
    out: list[int] = []
    for s, e in sorted(zip(runs[::2], runs[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _count(docs: DataFrame, block: Block) -> dict[tuple[int, int], int]:
    """Occurrences over all documents of each of the block's shingles."""

    def counted(batches):
        totals = {k: np.zeros(len(look.values), np.int64) for k, look in block.widths.items()}
        for b in batches:
            for _, _, data, offsets in textkit.slices(b.column(0)):
                starts, ends, begin = textkit.spans(data, offsets, textkit.ALNUM)
                words = _HASH.words(data, starts, ends)
                for k, look in block.widths.items():
                    at, place = look.find(_HASH.windows(words, k))
                    inside = at + k <= begin[np.searchsorted(begin, at, "right")] if len(at) else np.zeros(0, bool)
                    totals[k] += np.bincount(place[inside], minlength=len(look.values))
        for k, total in totals.items():
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), k, np.int32)), pa.array(block.widths[k].values[hit].view(np.int64)), pa.array(total[hit])], names=["k", "shingle", "n"])

    rows = docs.select("text").mapInArrow(counted, "k int, shingle long, n long").groupBy("k", "shingle").agg(F.sum("n").alias("n")).collect()
    return {(r["k"], r["shingle"] % 2**64): r["n"] for r in rows}


def _blocks(items: DataFrame, column: str):
    """Lists of (id, text) rows of about BLOCK_BYTES each, item ids as text."""
    items = items.where(F.col(column).isNotNull() & F.col("text").isNotNull()).select(F.col(column).cast("string").alias("id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for i in range(n):
        yield items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).collect()


def _searched(docs: DataFrame, items: DataFrame, item_id: str) -> DataFrame:
    """``row`` (docs' columns but text), text, ``_n``, ``_runs`` and ``_items``."""
    spark = docs.sparkSession
    out = packed(docs, "text").select("row", "text", F.lit(0).cast("long").alias("_n"), F.array().cast("array<long>").alias("_runs"), F.array().cast("array<string>").alias("_items"))
    schema = out.schema
    for rows in _blocks(items, item_id):
        block = Block(rows)
        block.choose(_count(docs, block) if block.words else {})
        held = spark.sparkContext.broadcast(cloudpickle.dumps(block))

        def found(batches, held=held):
            own = pickle.loads(held.value)
            for b in batches:
                yield _add(b, own)

        out = out.mapInArrow(found, schema)
    return out


def contamination(docs: DataFrame, items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """docs, all columns, with ``_n`` (words), ``_runs`` (hit words as start, end, start, end, ...) and ``_items``, which replace columns of these names."""
    return unpacked(_searched(docs, items, item_id), docs.columns, "_n", "_runs", "_items", apart=("text",))


def _add(b: pa.RecordBatch, block: Block) -> pa.RecordBatch:
    runs, items = b.column("_runs").to_pylist(), b.column("_items").to_pylist()
    n = np.zeros(b.num_rows, np.int64)
    for lo, hi, data, offsets in textkit.slices(b.column("text")):
        starts, ends, begin = textkit.spans(data, offsets, textkit.ALNUM)
        n[lo:hi] = np.diff(begin)
        row, p, no = block.occurrences(_HASH.words(data, starts, ends), begin)
        order = np.lexsort((p, row))
        cut = np.flatnonzero(np.diff(row[order], prepend=-1)).tolist() + [len(order)]
        for i, j in zip(cut, cut[1:], strict=False):
            own = order[i:j]
            r = int(row[own[0]])
            s = p[own] - begin[r]
            runs[lo + r] = _merged(runs[lo + r] + np.array([s, s + block.lengths[no[own]]]).T.reshape(-1).tolist())
            items[lo + r] = sorted({*items[lo + r], *(x for w in np.unique(no[own]).tolist() for x in block.items[w])})
    return pa.RecordBatch.from_arrays([b.column("row"), b.column("text"), pa.array(n), pa.array(runs, _RUNS), pa.array(items, _ITEMS)], names=b.schema.names)


def hit_words():
    """The number of words in ``_runs``."""
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size("_runs") - 1, F.lit(0))), F.lit(0).cast("long"), lambda s, i: s + F.coalesce(F.get("_runs", i) * F.when(i % 2 == 0, -1).otherwise(1), F.lit(0)))


def contaminated():
    return (F.size("_runs") > 0) & (20 * hit_words() >= F.col("_n"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, that aren't contaminated."""
    return unpacked(_searched(docs, items, "item_id").where(~contaminated()), docs.columns, apart=("text",))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        F.col("_n").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH i AS (SELECT item_id::VARCHAR AS item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[p:p + least(len(w), {WINDOW}) - 1], ' ') AS t
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
dw AS (SELECT r, p, k, array_to_string(w[p:p + k - 1], ' ') AS t
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
h AS (SELECT dw.r, dw.p, dw.k, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.t = iw.t),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM h) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)
"""
